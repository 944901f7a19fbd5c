"""Text functions as Column expressions; Python only where a builtin cannot say it."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from evalloom.functions import stemmer

# The words that a search leaves out, and the formats of codes and marks.
STOPWORD_TEXT = """
a about above after again against all am an and any are aren't as at be because been before being below between both
but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't
has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself just let
me more most must my myself no nor not now of off on once only or other ought our ours ourselves out over own same shall
she should shouldn't so some such than that the their theirs them themselves then there these they this those through to
too under until up upon very was wasn't we were weren't what when where which while who whom why will with won't would
wouldn't you your yours yourself yourselves s t d ll m re ve also may might per via
"""
STOPWORDS = STOPWORD_TEXT.replace("'", "").split()  # texts lose their apostrophes first
_STOP = frozenset(STOPWORDS)
COMPOUND = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"
APOSTROPHES = "['’‘`]"
DOC_CODE = r"\b[A-Z]{2,5}-[A-Z]{2,5}-\d{2,4}\b"
CODE_RANGE = r"\b([A-Z]{2,5}-[A-Z]{2,5}-)(\d{2,4})\s*(?:to|–|—|-)\s*\1(\d{2,4})\b"
SENTENCE = r"(?<=[.!?;])\s+(?=[A-Z0-9(\"“])"
MONTH_DATE = r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4}\b"
LIST_MARKER = r"^(?:[•●▪◦‣∙–\-*∗]\s+|\d{1,2}[.)]\s+|\((?:[a-z]|[ivx]{1,4}|\d{1,2})\)\s+)"
FOOTER, RULE = r"(?i)^(?:Page \d+ of \d+|End of document\b.*)$", r"^[\s\-_=—–·.•*]+$"
SECTION_REFS = (r"\((\d+\.\d+)\)", r"(?i)(?:section|§)\s*(\d+\.\d+)")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least two characters; null has none."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) > 1)


def kept(token: Column) -> Column:
    return ~token.isin(STOPWORDS) & ((F.length(token) > 1) | token.rlike("^[0-9]$"))


#: Words that a Python worker remembers at most, twice over.
WORDS_KEPT = 200_000


class _Words(dict):
    """The tokens of each word met lately: looked up by word, made where they are missing."""

    def __init__(self):
        super().__init__()
        self.before: dict[str, tuple[str, ...]] = {}

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= WORDS_KEPT:
            self.before = dict(self)
            self.clear()
        found = self.before.get(word)
        if found is None:
            parts = re.split(r"[.\-/]", word)
            found = tuple(stemmer.stem(p) if p.isalpha() else p for p in parts if p not in _STOP and (len(p) > 1 or p.isdigit()))
            found = (word, *found) if len(parts) > 1 else found
        self[word] = found
        return found


_words = _Words()
_APOSTROPHE, _COMPOUND = re.compile(APOSTROPHES), re.compile(COMPOUND)


def normal_tokens(text: str | None) -> list[str]:
    """What :func:`search_tokens` gives for one text."""
    flat = text or ""
    flat = (flat if flat.isascii() else unicodedata.normalize("NFKC", flat)).lower()
    return [t for w in _COMPOUND.findall(_APOSTROPHE.sub("", flat)) for t in _words[w]]


@F.pandas_udf(ArrayType(StringType()))
def search_tokens(text: pd.Series) -> pd.Series:
    """The tokens of an index: normalised, without stopwords, compounds whole and in parts, alphabetic parts stemmed; null has none."""
    return text.map(normal_tokens)


def compound_tokens(text: Column, stem=None) -> Column:
    """Tokens with their parts: "sim-hr-102" gives itself, sim, hr and 102.

    Apostrophes are dropped first. A token of one part is kept unless it is a
    stopword or one letter; of several parts the whole is always kept. ``stem``
    maps purely alphabetic tokens.
    """
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), APOSTROPHES, "")
    words = F.regexp_extract_all(flat, F.lit(f"({COMPOUND})"), F.lit(1))
    cut = (lambda w: F.when(w.rlike("^[a-z]+$"), stem(w)).otherwise(w)) if stem else (lambda w: w)

    def spread(w: Column) -> Column:
        parts = F.split(w, r"[.\-/]")
        of = F.transform(F.filter(parts, kept), cut)
        return F.when(F.size(parts) > 1, F.concat(F.array(w), of)).otherwise(of)

    return F.flatten(F.transform(words, spread))


def sentences(text: Column) -> Column:
    """Cut after . ! ? ; and white space, where a capital, a digit, a bracket or a quote begins what follows."""
    return F.split(text, SENTENCE)


def doc_codes(text: Column, most: int = 20) -> Column:
    """Distinct document codes: those of ranges "X-101 to X-105" of at most ``most`` steps, then all others in order of first use."""
    group = lambda k: F.regexp_extract_all(text, F.lit(CODE_RANGE), F.lit(k))
    ranges = F.filter(F.arrays_zip(group(1).alias("p"), group(2).alias("a"), group(3).alias("b")), lambda r: (r["b"].cast("int") - r["a"].cast("int")).between(1, most))
    spread = F.flatten(F.transform(ranges, lambda r: F.transform(F.sequence(r["a"].cast("int"), r["b"].cast("int")), lambda n: F.concat(r["p"], _padded(n, F.length(r["a"]))))))
    return F.array_distinct(F.concat(spread, F.regexp_extract_all(text, F.lit(f"({DOC_CODE})"), F.lit(1))))


def _padded(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), F.greatest(width, F.length(n.cast("string"))), F.lit("0"))


def code_range(prefix: Column, first: Column, last: Column, most: int = 20) -> Column:
    """The codes of a range, zero-padded like its first number; a range that is longer or backwards gives its ends."""
    n = F.sequence(first.cast("int"), last.cast("int"))
    span = last.cast("int") - first.cast("int")
    return F.when(span.between(0, most), F.transform(n, lambda x: F.concat(prefix, _padded(x, F.length(first))))).otherwise(F.array(F.concat(prefix, first), F.concat(prefix, last)))


def month_date(text: Column) -> Column:
    """"March 5, 2024" as a date; null when it is none."""
    return F.to_date(F.try_to_timestamp(text, F.lit("MMMM d, yyyy")))


def cell(text: Column) -> Column:
    """A table cell: a line break after a hyphen goes and the hyphen stays, white space collapsed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\w-)\s*\n\s*", ""), r"\s+", " "))


def markers(text: Column) -> Column:
    """Numbers of citation marks [1, 3], once each in order."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.array_distinct(F.transform(F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*"))), lambda x: x.cast("int")))


def snippet(text: Column, most: int = 280) -> Column:
    """White space collapsed, cut at a word, with an ellipsis if cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(cut, F.lit("…")))


def excerpt(text: Column, most: int = 400) -> Column:
    """A snippet without citation marks."""
    return snippet(F.regexp_replace(text, r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""), most)


def short_title(text: Column, words: int = 6) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\"'`]", ""), r"\s+", " "))
    return F.regexp_replace(F.array_join(F.slice(F.split(clean, " "), 1, words), " "), r"[.:;,]+$", "")


def jurisdiction(text: Column) -> Column:
    """ISO-2 codes or GLOBAL, UK read as GB; null otherwise."""
    up = F.upper(F.trim(text))
    return F.when(up == "UK", "GB").when(up.isin("GLOBAL", "WORLDWIDE"), "GLOBAL").when(up.rlike("^[A-Z]{2}$"), up)


def route_template(path: Column, params: Column) -> Column:
    """The path with each segment that is a parameter's value replaced by "{name}"; ``params`` maps names to values, and of equal values the last name counts."""
    pairs = F.reverse(F.map_entries(params))
    name = lambda p: F.get(F.filter(pairs, lambda e: e["value"] == p), F.lit(0))["key"]
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.coalesce(F.concat(F.lit("{"), name(p), F.lit("}")), p)), "/")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Containment that is blind to case and white space."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.contains(flat(text), flat(phrase))


def names_country(text: Column, name: str) -> Column:
    return F.lower(text).rlike(f"(?<![a-z]){name.lower()}(?![a-z])")


def trigrams(text: Column) -> Column:
    """Distinct word trigrams."""
    w = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: x != "")
    n = F.greatest(F.size(w) - 2, F.lit(0))
    # side by side, not by position: a position would cut the text anew for every trigram
    two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.zip_with(two, F.slice(w, F.lit(3), n), lambda a, b: F.concat_ws(" ", a, b)))


def share_of(a: Column, b: Column) -> Column:
    """|a and b| / |a| of sets, 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def defused(text: Column, tag: str) -> Column:
    """Closing tags that a text must not be able to write."""
    return F.regexp_replace(text, f"(?i)</\\s*{tag}\\s*>", f"<\\\\/{tag}>")


def common_prefix(paths: Column) -> Column:
    """The longest path that begins all paths of an array of arrays."""
    shorter = lambda a, b: F.transform(F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), (x == y).alias("s"))), lambda p: p["x"].isNotNull()), lambda p: F.when(p["s"], p["x"]))
    def fold(a: Column, b: Column) -> Column:
        same = shorter(a, b)
        stop = F.array_position(F.transform(same, lambda x: x.isNull()), True)
        return F.when(stop > 0, F.slice(same, F.lit(1), (stop - 1).cast("int"))).otherwise(same)

    return F.aggregate(F.slice(paths, 2, F.greatest(F.size(paths) - 1, F.lit(0))), F.get(paths, F.lit(0)), fold)


def seed64(*parts: Column) -> Column:
    """First eight bytes of the sha256 of the parts joined by the unit separator, as an unsigned number."""
    digest = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
