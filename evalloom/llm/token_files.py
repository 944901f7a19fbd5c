"""Token ids in binary blocks with Elias-Fano encoded document boundaries.

A block is one byte string:

    magic "EFTK" | version u8 | id width u8 | low bits u8 | 0 u8
    n_docs u64 | n_ids u64 | n_samples u64 | upper bytes u64 | lower bytes u64
    select samples u32[n_samples] | upper bits | lower bits | ids

Boundaries are the n_docs + 1 ascending offsets 0 .. n_ids of the documents in
the concatenated id array. Each offset's low bits are packed; its high part is
written in unary: bit (high + index) of the upper bits is set. Every 64th set
bit's position is a select sample, so that one offset is found without reading
the others. Offsets take about 2 + log2(n_ids / n_docs) bits instead of 64.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.llm.common import drop_shuffles, python_ready, shuffle_partitions

MAGIC, VERSION, SAMPLE = b"EFTK", 2, 64
#: Documents that are read from a block at once.
READ_DOCS = 16 * SAMPLE
HEAD = struct.Struct("<4sBBBBQQQQQ")
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 20
#: Memory for the words that a Python worker has met since it last began anew (those of the time before are kept as long), and what an entry takes beside its word and its ids.
CACHE_BYTES, ENTRY_BYTES = 128_000_000, 180
#: Latin letters and then signs without apostrophe, digit and "<": two runs that are encoded apart.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:;=-@\\[-`{-~]*)")
#: Totals of shards that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000


def pack(offsets: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """A block of documents whose ids lie between consecutive offsets."""
    offsets = offsets.astype(np.int64)
    n, total = len(offsets) - 1, int(offsets[-1])
    low = max(0, (total // max(1, n)).bit_length() - 1)
    spots = (offsets >> low) + np.arange(n + 1)
    upper = np.zeros(int(spots[-1]) + 1, np.uint8)
    upper[spots] = 1
    bits = (offsets[:, None] >> np.arange(low)) & 1
    upper_bytes, lower_bytes = np.packbits(upper, bitorder="little").tobytes(), np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()
    if spots[-1] >= 1 << 32:
        raise ValueError("a block has at most some 2^31 documents")
    samples = spots[::SAMPLE].astype("<u4")
    head = HEAD.pack(MAGIC, VERSION, width, low, 0, n, total, len(samples), len(upper_bytes), len(lower_bytes))
    return b"".join((head, samples.tobytes(), upper_bytes, lower_bytes, ids.astype(f"<u{width}").tobytes()))


class Block:
    """A read view of a packed block."""

    def __init__(self, data: bytes):
        magic, version, self.width, self.low, _, self.n_docs, self.n_ids, n_samples, upper, lower = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        at = HEAD.size
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        self.upper = np.frombuffer(data, np.uint8, upper, at)
        self.lower = np.frombuffer(data, np.uint8, lower, at + upper)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + upper + lower)

    def _low(self, first: int, last: int) -> np.ndarray:
        begin = first * self.low
        bits = np.unpackbits(self.lower[begin // 8 : (last * self.low + 7) // 8], bitorder="little")[begin % 8 :]
        return bits[: (last - first) * self.low].reshape(last - first, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def offset(self, i: int) -> int:
        """Offset i by the select sample before it."""
        start = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, start // 8
        first = int(self.upper[byte]) >> (start % 8) << (start % 8)
        while (ones := first.bit_count()) <= rest:
            rest -= ones
            byte += 1
            first = int(self.upper[byte])
        for _ in range(rest):
            first &= first - 1
        spot = 8 * byte + (first & -first).bit_length() - 1
        return (spot - i << self.low) | int(self._low(i, i + 1)[0])

    def offsets(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Offsets first to last (the end of the block's last document, if none is given): only the upper bits between two samples are unpacked."""
        last = self.n_docs if last is None else last
        start = int(self.samples[first // SAMPLE])
        after = last // SAMPLE + 1
        stop = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :]
        spots = start + np.flatnonzero(bits)[first % SAMPLE : first % SAMPLE + last - first + 1]
        return (spots - np.arange(first, last + 1) << self.low) | self._low(first, last + 1)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offset(i) : self.offset(i + 1)]


class WordEncoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of words.

    The tokenizer has to drop white space, never to join what stands on its two
    sides, and to lower-case and cut letters and signs apart, so that a text's
    ids are those of its words in turn. Files of which that does not hold for
    ``PROBES`` are refused.
    """

    PROBES = ("Hello,  World! (again)\tand\n a-b_c ", "don't it's WE'LL 3x 42nd x7 é À ÑÖ ½ 日本", " \"q\" a.b/c:d;e <s> </s> <|end|> #tag @me $5 100% ~x^y` {z}[w]|v\\u=+*", "Über-naïve Ångström æØ\r\nlast")

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.width = 2 if self.tool.get_vocab_size() <= 1 << 16 else 4
        self.cache: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.held = 0
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.sign = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}  # the byte-level alphabet
        whole = [e.ids for e in self.tool.encode_batch(list(self.PROBES), add_special_tokens=False)]
        if [np.frombuffer(x, f"<u{self.width}").tolist() for x in self.encode([t.encode() for t in self.PROBES])] != whole:
            raise ValueError(f"{path}: the ids of a text are not those of its lower-cased words in turn")

    def _run(self, text: str) -> bytes:
        """Ids of one run of letters or of signs, which the tokenizer splits no further."""
        got = self.runs.get(text)
        if got is None:
            signs = text if text.isascii() else "".join(self.sign[b] for b in text.encode())
            got = self.runs[text] = np.array([t.id for t in self.tool.model.tokenize(signs)], f"<u{self.width}").tobytes()
            self.held += ENTRY_BYTES + 4 * len(text) + len(got)
        return got

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        split = [(t or b"").split() for t in texts]
        if self.held > CACHE_BYTES:
            self.before, self.cache, self.held = self.cache, {}, 0
            self.runs.clear()
        cache, before, other = self.cache, self.before, []
        for w in {w for words in split for w in words if w not in cache}:
            if w in before:
                cache[w] = before[w]
                self.held += ENTRY_BYTES + len(w) + len(cache[w])
                continue
            text = w.decode()
            if m := _PLAIN.fullmatch(text):
                cache[w] = self._run(m[1].lower()) + (self._run(m[2]) if m[2] else b"")
                self.held += ENTRY_BYTES + len(w) + len(cache[w])
            else:
                other.append(w)
        for k in range(0, len(other), 1000):
            part = other[k : k + 1000]
            for w, e in zip(part, self.tool.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, f"<u{self.width}").tobytes()
                self.held += ENTRY_BYTES + len(w) + len(cache[w])
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _blocks(tokenizer: str, end_id: int, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        tool, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{tool.width}").tobytes()
        docs, parts, held, state = [], [], 0, [0, 0]

        def flush():
            lens = np.array([len(p) // tool.width for p in parts], np.int64)
            offsets = np.concatenate([[0], np.cumsum(lens)])
            data = pack(offsets, np.frombuffer(b"".join(parts), f"<u{tool.width}"), tool.width)
            row = {"shard": [shard], "block": [state[0]], "block_start": [state[1]], "n_ids": [int(offsets[-1])], "doc_ids": [docs[:]], "payload": [data]}
            state[0] += 1
            state[1] += int(offsets[-1])
            docs.clear()
            parts.clear()
            return row

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("block_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("payload", pa.binary())])
            for d, e in zip(batch.column("doc_id").to_pylist(), tool.encode(batch.column("_bytes").to_pylist()), strict=True):
                docs.append(d)
                parts.append(e + end)
                held += len(parts[-1]) // tool.width
                if held >= block_ids:
                    yield pa.RecordBatch.from_pydict(flush(), schema)
                    held = 0
        if docs:
            yield pa.RecordBatch.from_pydict(flush(), schema)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text and write blocks in ascending doc_id order (nulls first, equal ids by text) to ``path``.

    One range shuffle sorts the texts; each sorted partition is a shard that
    encodes and writes its own blocks, so that a lost executor repeats its
    shards only. A null text is empty; every document ends in ``end_id``; an
    empty table gives files without blocks. ``path`` must be in a folder that
    the cluster shares, and ``tokenizer`` readable on the executors.
    """
    python_ready(docs.sparkSession, 1024)
    drop_shuffles(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("_bytes"))
    # range borders are sampled by the driver: a prefix orders rows of one id like their texts, which stay out of the sample
    prefix = F.substring("_bytes", 1, 16)
    dealt = slim.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("doc_id"), prefix).sortWithinPartitions("doc_id", "_bytes")
    blocks = dealt.mapInArrow(_blocks(tokenizer, end_id, block_ids), f"shard long, block long, block_start long, n_ids long, doc_ids array<{kind}>, payload binary")
    blocks.write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit integers) of every document in the files.

    A block is read in runs of ``READ_DOCS`` documents, whose boundaries the
    select samples give without the others. Starts come from them, the blocks'
    places in their shards and one total for each shard, which are summed up in
    one task.
    """
    python_ready(spark, 64)
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = shards.select(F.col("shard"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    if shards.count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)

    def run(batches):
        for batch in batches:
            for shard, start, docs, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "block_start", "doc_ids", "payload")), strict=True):
                block = Block(data)
                for first in range(0, len(docs), READ_DOCS):
                    offsets = block.offsets(first, min(len(docs), first + READ_DOCS))
                    n, at = len(offsets) - 1, int(offsets[0])
                    ids = block.ids[at : int(offsets[-1])].astype("<u4")
                    cuts = (offsets - at).tolist()
                    arrays = [
                        pa.array([shard] * n, pa.int64()), pa.array(docs[first : first + n], batch.schema.field("doc_ids").type.value_type), pa.array(offsets[:-1] + start),
                        pa.array(np.diff(offsets)), pa.array([ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["shard", "doc_id", "_local", "n_tokens", "ids"])

    rows = blocks.select("shard", "block_start", "doc_ids", "payload").mapInArrow(run, f"shard long, doc_id {kind}, _local long, n_tokens long, ids binary")
    return rows.join(shards, "shard").select("doc_id", (F.col("_base") + F.col("_local")).alias("start"), "n_tokens", "ids")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    from evalloom.llm.common import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
