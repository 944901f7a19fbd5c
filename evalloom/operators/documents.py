"""HTML and text into blocks, sections and chunks.

Packing depends on what was packed before, so blocks are folded in order, a
section at a time, in Arrow batches. Tokens are counted as words and signs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions.text import SENTENCE
from evalloom.operators.evaluation import heading_parts
from evalloom.sources.session import python_ready

TARGET, MOST, OVERLAP, LEAST = 600, 800, 90, 40
TEXTS = ("paragraph", "list", "overlap")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def token_count(text: Column) -> Column:
    """Like :func:`count_tokens`: letters and digits of any script, and Python's white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f])"), F.lit(1)))


@functools.lru_cache(maxsize=2000)
def count_tokens(text: str) -> int:
    """Splitting, packing and merging ask for the same pieces in turn."""
    return sum(1 for _ in _TOKEN.finditer(text))


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, level, text): headings, paragraphs, list items and table rows in order; scripts and styles go."""
    clean = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style|nav|header|footer)\b.*?</\1>|<!--.*?-->", " ")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)(<(h[1-6]|p|li|tr)\b[^>]*>.*?</\2>)"), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]+>", " "), r"\s+", " "))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").when(tag == "tr", "table").otherwise("paragraph")
    rows = rows.select(key, "pos", kind.alias("kind"), F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int")).alias("level"), text.alias("text"))
    return rows.filter(F.length("text") > 0)


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of plain text: a short line that ends in a stop is a heading, the other lines are paragraphs."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "text")).filter(F.length(F.trim("text")) > 0)
    heading = (F.length("text") <= 30) & F.col("text").rlike(r"^\p{Lu}")
    return rows.select(key, "pos", F.when(heading, "heading").otherwise("paragraph").alias("kind"), F.when(heading, F.lit(2)).alias("level"), "text")


def outline(blocks: DataFrame, key: str) -> DataFrame:
    """Each block with its section: the last heading of level 1 and of level 2 at or before it; a new level 1 clears level 2."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("level") == 1, F.struct("pos", "text")), ignorenulls=True).over(w)
    sub = F.last(F.when(F.col("level") == 2, F.struct("pos", "text")), ignorenulls=True).over(w)
    rows = blocks.withColumns({"_top": top, "_sub": sub})
    live = F.col("_top").isNull() | (F.col("_sub.pos") > F.col("_top.pos"))
    return rows.select(*blocks.columns, F.col("_top.text").alias("part"), F.when(live, F.col("_sub.text")).alias("section"))


# --- chunks: one pass over blocks in order


class Unit(NamedTuple):
    """A block or a part of one, with its tokens and one for what joins it to the next."""

    kind: str
    text: str
    page: int
    path: tuple[str, ...]
    size: int


class Draft(NamedTuple):
    text: str
    path: tuple[str, ...]
    pages: tuple[int, int]
    size: int
    sums: tuple[int, int, int]  # of tables, of lists, of all
    titles: str


def unit(kind: str, text: str, page: int, path: tuple[str, ...]) -> Unit:
    return Unit(kind, text, page, path, count_tokens(text) + 1)


def every_tokens(text: str, most: int) -> list[str]:
    """A text in pieces of so many tokens, whatever stands there."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    edges = [0, *starts[most::most], len(text)]
    return [text[x:y] for x, y in zip(edges, edges[1:], strict=False)]


def split_unit(u: Unit, most: int) -> Iterator[Unit]:
    """A list at its items and a paragraph at its sentences, each part as long as it may be; what is too long by itself is cut by tokens."""
    if u.size <= most:
        yield u
        return
    between, parts = ("\n", u.text.split("\n")) if u.kind == "list" else (" ", re.split(SENTENCE, u.text))
    made: list[str] = []
    run, length = None, 0
    for part in parts:
        n = count_tokens(part)  # tokens do not reach over white space, so lengths add up
        if n > most or (run is not None and length + n > most):
            if run is not None:
                made.append(run)
            run, length = None, 0
        if n > most:
            made += every_tokens(part, most)
        else:
            run, length = part if run is None else f"{run}{between}{part}", length + n
    if run is not None:
        made.append(run)
    for text in made:
        yield unit(u.kind, text, u.page, u.path)


def tail_of(units: list[Unit], tokens: int = OVERLAP) -> Unit | None:
    """What the next chunk repeats of the last text: its last sentences, between 0.6 and 1.4 times ``tokens``, or the last tokens of a long one; nothing if that is all of it."""
    texts = [u for u in units if u.kind in TEXTS]
    if not texts:
        return None
    last = texts[-1]
    sentences = re.split(SENTENCE, last.text.replace("\n", " "))
    first, length = len(sentences), 0
    while first and length < 0.6 * tokens:
        n = count_tokens(sentences[first - 1])
        if length + n > 1.4 * tokens:
            break
        first, length = first - 1, length + n
    if first < len(sentences):
        text = " ".join(sentences[first:])
    else:
        starts = [m.start() for m in _TOKEN.finditer(last.text)]
        text = last.text[starts[-tokens] if len(starts) >= tokens else 0 :]
        text = text.partition(" ")[2] if " " in text else text
    return None if text == last.text else unit("overlap", f"… {text}", last.page, last.path)


def has_body(units: list[Unit]) -> bool:
    return any(u.kind not in ("heading", "overlap") for u in units)


def packed(units: Iterable[Unit]) -> Iterator[tuple[list[Unit], str | None]]:
    """A section's units in chunks, tables alone with the headings before them (or the section's last title).

    A chunk closes at the target, if it has half of it or would pass the most;
    headings at its end go on to the next one, which begins with its tail unless
    that leaves no room.
    """
    held: list[Unit] = []

    def closed(carry: bool) -> list[Unit] | None:
        nonlocal held
        end = len(held)
        while end and held[end - 1].kind == "heading":
            end -= 1
        front, heads = held[:end], held[end:]
        if not has_body(front):
            return None
        tail = tail_of(front) if carry else None
        held = [tail, *heads] if tail else heads
        return front

    for u in units:
        if u.kind == "table":
            if front := closed(False):
                yield front, None
            heads = [h.text for h in held if h.kind == "heading"]
            yield [u], "\n".join(heads) if heads else (u.path[-1] if u.path else "")
            held = []
            continue
        for part in split_unit(u, MOST - OVERLAP - 20):
            size = sum(h.size for h in held)
            if held and size + part.size > TARGET and has_body(held) and (2 * size >= TARGET or size + part.size > MOST):
                if front := closed(True):
                    yield front, None
                if sum(h.size for h in held) + part.size > MOST:
                    held = [h for h in held if h.kind != "overlap"]
            held.append(part)
    if has_body(held):
        yield held, None


def table_texts(text: str, prefix: str) -> list[str]:
    """A table under its prefix, whole or by rows with its first two lines in each part; a row that is too long by itself is cut by tokens."""
    head = f"{prefix}\n\n" if prefix else ""
    if count_tokens(head + text) <= MOST:
        return [head + text]
    lines = text.split("\n")
    top = head + "\n".join(lines[:2])
    base = count_tokens(top) + 1
    out: list[str] = []
    part, size = [], base

    def end() -> None:
        nonlocal part, size
        if part:
            out.append("\n".join([top, *part]))
        part, size = [], base

    for row in lines[2:]:
        n = count_tokens(row) + 1
        if size + n > MOST:
            end()
        if base + n > MOST:
            out += [f"{top}\n{piece}" for piece in every_tokens(row, max(1, MOST - base))]
        else:
            part, size = [*part, row], size + n
    end()
    return out


def shared_path(paths: Iterable[tuple[str, ...]]) -> tuple[str, ...]:
    out = []
    for names in zip(*paths, strict=False):
        if len(set(names)) > 1:
            break
        out.append(names[0])
    return tuple(out)


def drafted(units: Iterable[Unit]) -> Iterator[Draft]:
    for own, prefix in packed(units):
        path, pages = shared_path(u.path for u in own), (min(u.page for u in own), max(u.page for u in own))
        body = [u for u in own if u.kind in ("paragraph", "list", "table")]
        sums = tuple(sum(u.size for u in body if kind is None or u.kind == kind) for kind in ("table", "list", None))
        for text in table_texts(own[0].text, prefix) if prefix is not None else ["\n\n".join(u.text for u in own)]:
            yield Draft(text, path, pages, count_tokens(text) + 1, sums, " ".join(path))


def merged(drafts: Iterable[Draft]) -> list[Draft]:
    """A draft below the least joins the one before it, or, as the first of its section, the next one, if both fit. It keeps the longer one's kind."""
    out: list[Draft] = []
    waits = False

    def both(a: Draft, b: Draft, kind: Draft) -> Draft:
        return Draft(f"{a.text}\n\n{b.text}", shared_path((a.path, b.path)), (min(a.pages[0], b.pages[0]), max(a.pages[1], b.pages[1])), a.size + b.size, kind.sums, kind.titles)

    for d in drafts:
        if waits and out[-1].size + d.size <= MOST:
            d = both(out.pop(), d, d)
        small = d.size < LEAST
        if small and out and out[-1].size + d.size <= MOST:
            out[-1] = both(out[-1], d, out[-1])
            waits = False
        else:
            out.append(d)
            waits = small and len(out) == 1
    return out


_NUMBER = re.compile(r"\d+(?:\.\d+)*|[A-Z]")


class Sections:
    """Blocks of documents one after the other; a section's units come out when the next one begins.

    A section is the nearest numbered heading with the headings of level 1 and 2
    above; headings of level 3 stay inside. One of headings alone is left out.
    Table blocks of one line that follow each other are the rows of one table.
    """

    def __init__(self, titles: bool):
        self.titles = titles
        self.begin(None)

    def begin(self, key) -> None:
        self.key, self.stack, self.section, self.name = key, [], None, (None, None)
        self.units: list[Unit | tuple] = []
        self.opening, self.title = self.titles, set()

    def end(self) -> tuple[tuple[str | None, str | None], list[Unit]] | None:
        units, self.units = [u if isinstance(u, Unit) else unit("table", "\n".join(u[0]), *u[1:]) for u in self.units], []
        return (self.name, units) if any(u.kind != "heading" for u in units) else None

    def add(self, kind: str, level: int | None, text: str, page: int, number: str | None, title: str | None):
        """The section that ends before this block, if one does."""
        self.opening = self.opening and kind == "heading" and level == 1 and page == 1
        if self.opening:
            self.title.add(text)
        if kind == "heading":
            if page == 1 and text in self.title:
                return None  # the document's title stands for itself
            depth = level or 3
            self.stack = [h for h in self.stack if h[0] < depth] + [(depth, text, number, title)]
        name = next(((n, t) for _, _, n, t in reversed(self.stack) if n and _NUMBER.fullmatch(n)), (None, self.stack[-1][3] if self.stack else None))
        section = (name[0], tuple(h[1] for h in self.stack if h[0] <= 2))
        done = None
        if section != self.section:
            done, self.section, self.name = self.end(), section, name
        path = tuple(h[1] for h in self.stack)
        if kind != "table" or "\n" in text:
            self.units.append(unit(kind, text, page, path))
        elif self.units and not isinstance(self.units[-1], Unit):
            self.units[-1][0].append(text)
        else:
            self.units.append(([text], page, path))
        return done


def chunks(blocks: DataFrame, key: str, in_order: bool = False, titles: bool = False) -> DataFrame:
    """Chunks of documents' blocks: (key, chunk_index, section, section_number, section_title, page_start, page_end, content_type, tokens, text).

    ``blocks``: key, pos, kind (heading, paragraph, list, table), level, text and,
    if there are pages, page. They are folded as they come, so a task holds one
    section. ``in_order`` says that a document's blocks already follow each other
    by pos within a partition, as those that were cut from one row do; else one
    shuffle by key sorts them. With ``titles`` the level-1 headings that begin
    page 1 are the title and no section. Documents without text have no chunk;
    rows of one key are one document, but where pos begins anew another one.
    """
    spark = blocks.sparkSession
    python_ready(spark, 1000)
    kind = blocks.schema[key].dataType.simpleString()
    head = heading_parts(F.col("text"))
    page = F.coalesce("page", F.lit(1)).cast("int") if "page" in blocks.columns else F.lit(1)
    is_head = F.col("kind") == "heading"
    rows = blocks.filter(F.col("text").isNotNull()).select(key, F.col("pos").cast("long").alias("pos"), "kind", F.col("level").cast("int").alias("level"), "text", page.alias("page"), F.when(is_head, head["number"]).alias("number"), F.when(is_head, head["title"]).alias("title"))
    if not in_order:
        rows = rows.repartition(key).sortWithinPartitions(key, "pos")
    names = ["key", "chunk_index", "_path", "section_number", "section_title", "page_start", "page_end", "_tables", "_lists", "_total", "_titles", "tokens", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, index, out = Sections(titles), 0, [[] for _ in names]
        last = None

        def put(done) -> None:
            nonlocal index
            if done is None:
                return
            (number, title), units = done
            for d in merged(drafted(units)):
                for column, value in zip(out, (fold.key, index, list(d.path), number, title, *d.pages, *d.sums, d.titles, count_tokens(d.text), d.text), strict=True):
                    column.append(value)
                index += 1

        def batch_of(schema: pa.DataType) -> pa.RecordBatch:
            types = [schema, pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            for c in out:
                c.clear()
            return made

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, pos, what, level, text, at, number, title in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or last[0] != k or pos <= last[1]:
                    put(fold.end())
                    fold.begin(k)
                    index = 0
                last = (k, pos)
                put(fold.add(what, level, text, at, number, title))
            if out[0]:
                yield batch_of(key_type)
        put(fold.end())
        if out[0]:
            yield batch_of(key_type)

    schema = f"key {kind}, chunk_index int, _path array<string>, section_number string, section_title string, page_start int, page_end int, _tables long, _lists long, _total long, _titles string, tokens long, text string"
    made = rows.mapInArrow(run, schema)
    what = content_type(F.col("_tables"), F.col("_lists"), F.col("_total"), F.col("_titles"))
    return made.select(F.col("key").alias(key), "chunk_index", F.array_join("_path", " › ").alias("section"), "section_number", "section_title", "page_start", "page_end", what.alias("content_type"), "tokens", "text")


# Titles that tell what a section is.
GLOSSARY = r"(?i)\b(?:glossary|definitions|defined terms|abbreviations)\b"
REVISION = r"(?i)\b(?:revision|version|document|change) (?:history|log)\b|\bchangelog\b"
APPENDIX = r"(?i)\bappendi(?:x|ces)\b"


def content_type(tables: Column, lists: Column, total: Column, path: Column) -> Column:
    """The kind of a section: by its titles, else by what has over half of its tokens, else appendix or prose."""
    name = F.coalesce(path, F.lit(""))
    return (
        F.when(name.rlike(REVISION), "revision_history").when(name.rlike(GLOSSARY), "glossary").when(2 * tables > F.greatest(total, F.lit(1)), "table")
        .when(2 * lists > F.greatest(total, F.lit(1)), "list").when(name.rlike(APPENDIX), "appendix").otherwise("prose")
    )


def hashing_embedder(df: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """Deterministic unit vectors of hashed words, for use where no model is at hand; a text without words is all zeros."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")).alias("w"))
    h = F.xxhash64("w")
    signed = words.groupBy(key, F.pmod(h, F.lit(size)).alias("i")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1).otherwise(-1)).alias("v"))
    vectors = signed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("v").cast("double")))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")) / F.nullif("n", F.lit(0.0)), F.lit(0.0)))
    empty = F.array_repeat(F.lit(0.0), size)
    return df.select(key).join(vectors, key, "left").select(key, F.coalesce(dense, empty).alias("embedding"))
