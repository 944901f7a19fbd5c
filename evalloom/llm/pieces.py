"""SentencePiece encoding and decoding as a batched numpy Viterbi over distinct words.

Words of one length advance together, one end position at a time. Substring
hashes probe the sorted keys of all pieces; of the candidates that end at a
position a vectorised maximum is kept, with a backpointer.

* Unigram models: a candidate's score is that of the best path to its start
  plus the piece's score.
* BPE models: scores of pieces do not add up to what merging gives. A sequence
  of pieces is the result of merging exactly if each piece alone and each pair
  of neighbours merges to itself, so a candidate's score is 0 if the pair with
  the best piece before it holds and minus infinity if not; exactly one
  candidate holds at each position. Pairs are tested by replaying both pieces'
  merges, vectorised over pairs, and remembered in a table of fixed size.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import python_ready

SPACE = "▁"
#: Memory for the words that a Python worker has met since it last began anew; those of the time before are kept as long.
CACHE_BYTES = 16_000_000
#: Memory that an entry takes beside its word and its ids.
ENTRY_BYTES = 180
#: Text that is encoded at once; batches beyond are cut.
BATCH_BYTES = 16_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = -np.inf


def _mix(points: np.ndarray) -> np.ndarray:
    """64-bit values of code points."""
    x = points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


class Codec:
    """Encodes and decodes by a model file with identity normalisation; other normalisers are refused."""

    def __init__(self, model_file: str):
        with open(model_file, "rb") as f:
            self._load(f.read())

    def _load(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(data)
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation is supported")
        self.bpe = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = norm.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bytes_of = [0] * 256
        self.byte_fallback = model.trainer_spec.byte_fallback
        normal: dict[str, int] = {}
        spelled: list[bytes] = []
        for i, p in enumerate(model.pieces):
            spelled.append(b"")
            if p.type == kinds.NORMAL:
                normal[p.piece] = i
                spelled[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kinds.BYTE:
                self.bytes_of[int(p.piece[3:-1], 16)] = i
                spelled[i] = bytes([int(p.piece[3:-1], 16)])
            elif p.type == kinds.UNKNOWN:
                spelled[i] = (model.trainer_spec.unk_surface or " ⁇ ").encode()
        self.lens = np.array([len(x) for x in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        # pieces with white space inside would join words
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in normal)
        if self.bpe:
            usable = self._replay(normal)
        else:
            usable = normal
            self.unknown_score = min(self.scores[i] for i in normal.values()) - 10.0
        self.longest = max(map(len, usable))
        by_key = sorted((self._key(p), i) for p, i in usable.items())
        self.keys = np.array([k for k, _ in by_key], np.uint64)
        self.ids = np.array([i for _, i in by_key], np.int64)
        self.likely = np.zeros(1 << 20, bool)  # by the first bits of a key
        self.likely[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def _key(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in _mix(np.array([ord(c) for c in piece], np.uint32)):
                h = h * BASE + c
            return int(h + np.uint64(len(piece)) * np.uint64(0xD6E8FEB86659FD93))

    # --- BPE: which pairs of pieces stay apart
    def _replay(self, normal: dict[str, int]) -> dict[str, int]:
        """Merge each piece alone and keep the symbols at its edges with the score at which each goes on changing."""
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(self.scores) + len(symbol))
        pairs, usable, left, right = {}, {}, {}, {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = self.scores[i]
        for p, i in normal.items():
            parts, history = list(p), []
            while len(parts) > 1:
                best, at = max((self.scores[normal[x]], -k) if (x := parts[k] + parts[k + 1]) in normal else (_LOW, -k) for k in range(len(parts) - 1))
                if best == _LOW:
                    break
                history.append((parts[0], parts[-1], best))
                parts[-at : -at + 2] = ["".join(parts[-at : -at + 2])]
            if len(parts) > 1:
                continue  # merging never gives this piece
            usable[p] = i
            history.append((p, p, _LOW))
            for edge, of in ((0, left), (1, right)):
                steps: list[list] = []
                for h in history:
                    if steps and steps[-1][0] == symbol[h[edge]]:
                        steps[-1][1] = min(steps[-1][1], h[2])
                    else:
                        steps.append([symbol[h[edge]], h[2]])
                of[i] = steps
        depth = max(max(map(len, left.values())), max(map(len, right.values())))
        shape = (len(self.scores), depth)
        for name, of in (("left", left), ("right", right)):
            sym, least = np.zeros(shape, np.int64), np.full(shape, _LOW)
            for i, steps in of.items():
                for k, (s, x) in enumerate(steps):
                    sym[i, k], least[i, k] = s, x
            setattr(self, f"{name}_symbol", sym)
            setattr(self, f"{name}_score", least)
        order = sorted(pairs)
        self.pair_keys, self.pair_scores = np.array(order, np.int64), np.array([pairs[k] for k in order])
        self.seen = np.full(1 << 21, -1, np.int64)
        return usable

    def _stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b apart."""
        i, j, ok, live = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = self.right_symbol[x, i[live]] << 20 | self.left_symbol[y, j[live]]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            cross = np.where(self.pair_keys[at] == key, self.pair_scores[at], _LOW)
            s, t = self.right_score[x, i[live]], self.left_score[y, j[live]]
            joined = (cross > s) & (cross >= t)
            ok[live[joined]] = False
            go = ~joined & ((s > _LOW) | (t > _LOW))
            first = s >= t
            i[live[go & first]] += 1
            j[live[go & ~first]] += 1
            live = live[go]
        return ok

    def _pairs_stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 17 | b
        slot = ((code * 0x9E3779B1) >> 9) & (len(self.seen) - 1)
        known = self.seen[slot]
        out = (known & 1).astype(bool)
        missing = np.flatnonzero(known >> 1 != code)
        if len(missing):
            new, back = np.unique(code[missing], return_inverse=True)
            stay = self._stay(new >> 17, new & ((1 << 17) - 1))
            out[missing] = stay[back]
            self.seen[((new * 0x9E3779B1) >> 9) & (len(self.seen) - 1)] = new << 1 | stay
        return out

    # --- the lattice
    def _encode_equal(self, words: list[str]) -> list[np.ndarray]:
        """Piece ids of words of one length; -1 stands for a character that no piece covers."""
        points = _points(words)
        count, n = points.shape
        with np.errstate(over="ignore"):
            sums = np.zeros((n + 1, count), np.uint64)
            for p in range(n):
                sums[p + 1] = sums[p] * BASE + _mix(points[:, p])
            powers = [np.uint64(1)]
            for _ in range(min(n, self.longest)):
                powers.append(powers[-1] * BASE)
            spots, rows, ids, sizes = [], [], [], []
            for length in range(1, min(n, self.longest) + 1):
                key = sums[length:] - sums[:-length] * powers[length] + np.uint64(length) * np.uint64(0xD6E8FEB86659FD93)
                key = key.reshape(-1)
                likely = np.flatnonzero(self.likely[(key >> np.uint64(44)).astype(np.int64)])
                key = key[likely]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                likely = likely[hit]
                spots.append(likely // count + length)
                rows.append(likely % count)
                ids.append(self.ids[at[hit]])
                sizes.append(np.full(len(likely), length))
            spot, row, found, size = map(np.concatenate, (spots, rows, ids, sizes))
            order = np.argsort(spot, kind="stable")  # by end, then by length
            row, found, size = row[order], found[order], size[order]
            cuts = np.searchsorted(spot[order], np.arange(1, n + 2))
            piece = np.full((n + 1, count), -1, np.int64)
            back = np.ones((n + 1, count), np.int64)
            best = np.zeros((n + 1, count))
            for p in range(1, n + 1):
                part = slice(cuts[p - 1], cuts[p])
                r, f, z = row[part], found[part], size[part]
                if self.bpe:
                    before = piece[p - z, r]
                    holds = (before < 0) | (z == p)
                    test = np.flatnonzero(~holds)
                    holds[test] = self._pairs_stay(before[test], f[test])
                    r, f, z = r[holds], f[holds], z[holds]
                else:
                    best[p] = best[p - 1] + self.unknown_score
                    score = best[p - z, r] + self.scores[f]
                    np.maximum.at(best[p], r, score)
                    wins = score == best[p, r]  # of equal scores the longest piece is written last
                    r, f, z = r[wins], f[wins], z[wins]
                piece[p, r], back[p, r] = f, z
        # all words walk back together
        ends, out, live, at = [], [], np.arange(count), np.full(count, n)
        while len(live):
            here = np.full(count, -2, np.int64)
            here[live] = piece[at[live], live]
            ends.append(here)
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        table = np.stack(ends[::-1], 1) if ends else np.empty((count, 0), np.int64)
        for k in range(count):
            row = table[k]
            out.append(row[row > -2])
        return out

    def _finish(self, word: str, ids: np.ndarray) -> bytes:
        """Characters that no piece covers become bytes, or one unknown piece for each run of them."""
        if ids.min(initial=0) >= 0:
            return ids.astype("<i4").tobytes()
        out, at, fresh = [], 0, True
        sizes = self._sizes(word, ids)
        for i, size in zip(ids.tolist(), sizes, strict=True):
            if i >= 0:
                out.append(i)
                fresh = True
            elif self.byte_fallback:
                out += [self.bytes_of[b] for b in word[at : at + size].encode()]
            elif fresh:
                out.append(self.unknown)
                fresh = False
            at += size
        return np.array(out, "<i4").tobytes()

    def _sizes(self, word: str, ids: np.ndarray) -> list[int]:
        if not hasattr(self, "_chars"):
            text = [self.spelled[s : s + n].tobytes().decode("utf-8", "replace") for s, n in zip(self.starts.tolist(), self.lens.tolist(), strict=True)]
            self._chars = [len(t) for t in text]
        return [self._chars[i] if i >= 0 else 1 for i in ids.tolist()]

    def forget(self) -> None:
        self.before, self.cache, self.held = {}, {}, 0

    def _keep(self, word: str, ids: bytes) -> None:
        self.cache[word] = ids
        self.held += ENTRY_BYTES + len(word) + len(ids)

    def _learn(self, words: list[str]) -> None:
        """Put words into the cache; a word stands without its first white-space sign."""
        lead = SPACE if self.by_word and self.prefix else ""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            step = max(1, 100_000 // (length + 1))
            for k in range(0, len(same), step):
                part = same[k : k + step]
                full = [lead + w for w in part]
                if not length and not lead:
                    continue
                for w, f, ids in zip(part, full, self._encode_equal(full), strict=True):
                    self._keep(w, self._finish(f, ids))

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if not (self.by_word and self.prefix):
            text = text.replace(" ", SPACE)
            return [SPACE + text if self.prefix else text]
        if SPACE in text or "  " in text or text[0] == " ":
            return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null and empty texts have none."""
        split = [self._words(t or "") for t in texts]
        if self.held > CACHE_BYTES:
            self.before, self.cache, self.held = self.cache, {}, 0
        cache, before = self.cache, self.before
        new = {w for words in split for w in words if w not in cache}
        for w in new & before.keys():
            self._keep(w, before[w])
        if new := new - before.keys():
            self._learn(sorted(new))
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, encoded: list[bytes]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(b"".join(encoded), "<i4")
        sizes = self.lens[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        spots = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        data = self.spelled[spots].tobytes()
        out, k, at = [], 0, 0
        for e in encoded:
            n = len(e) // 4
            end = int(ends[k + n - 1]) if n else at
            text = data[at:end].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
            k, at = k + n, end
        return out


@functools.lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, model_file: str, with_text: bool = False) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers) and decoded of every row, and the text if asked for.

    ``model_file`` is opened on the executors. A null text gives no ids and
    decodes to the empty text; rows are not merged or reordered.
    """
    python_ready(docs.sparkSession, 2048)
    names = ["doc_id", "ids", "decoded"] + ["text"] * with_text

    def run(batches):
        tool = codec(model_file)
        try:
            for batch in batches:
                rows = max(1, int(batch.num_rows * min(1.0, BATCH_BYTES / max(1, batch.nbytes))))
                for k in range(0, batch.num_rows, rows):
                    part = batch.slice(k, rows)
                    ids = tool.encode(part.column("text").to_pylist())
                    arrays = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(tool.decode(ids), pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays + [part.column("text")] * with_text, names=names)
        finally:
            tool.forget()  # the worker goes on with other tasks, which need the memory

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string" + ", text string" * with_text)


def n_tokens(ids="ids") -> F.Column:
    return (F.octet_length(ids) / 4).cast("long")
