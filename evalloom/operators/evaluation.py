"""Evaluation operations: routing, citations, page expectations, run aggregates, noise floors and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T


def routed(rows: DataFrame, known: list[str], most: int = 3) -> DataFrame:
    """departments that are known, distinct, at most ``most``; clarify holds if none is left and no part asks."""
    kept = F.slice(F.array_distinct(F.filter("departments", lambda x: x.isin(known))), 1, most)
    return rows.withColumn("departments", kept).withColumn("clarify", F.size("departments") == 0)


def question_parts(parts: Column, country: Column, most: int = 6) -> Column:
    """Parts trimmed, distinct, at most ``most``, each with the question's country where it names none; fewer than two are no parts."""
    clean = F.slice(F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != "")), 1, most)
    each = F.transform(clean, lambda p: F.concat_ws(" | ", p, country))
    return F.when(F.size(clean) >= 2, each).otherwise(F.array().cast("array<string>"))


def cited_sources(answers: DataFrame, sources: DataFrame, key: str, answer: str, n: str = "n") -> DataFrame:
    """The sources that an answer cites, in the order of first citation; marks without a source go."""
    marks = answers.select(key, F.posexplode(T.markers(F.col(answer))).alias("pos", n))
    hits = marks.join(sources, [key, n])
    return hits.withColumn("order", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).drop("pos")


def source_line(n: Column, code: Column, title: Column, section: Column, pages: Column) -> Column:
    """"[n] CODE Title, §section, p. pages" with what is null left out."""
    return F.concat_ws(", ", F.concat(F.lit("["), n, F.lit("] "), F.concat_ws(" ", code, title)), F.concat(F.lit("§"), section), F.concat(F.lit("p. "), pages))


def chunk_header(code: Column, title: Column, version: Column, jurisdiction: Column, department: Column, path: Column) -> Column:
    """"[code · title vN · juris · dept | a › b]"."""
    left = F.concat_ws(" · ", code, F.concat_ws(" v", title, version), jurisdiction, department)
    return F.concat(F.lit("["), F.concat_ws(" | ", left, F.when(F.size(path) > 0, F.array_join(path, " › "))), F.lit("]"))


def cross_references(text: Column, own: Column) -> Column:
    """Codes other than the own one, then section numbers of "(n.n)" and of "section n.n" or "§ n.n", once each."""
    codes = F.filter(T.doc_codes(text), lambda c: ~c.eqNullSafe(own))
    return F.array_distinct(F.concat(codes, *[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in T.SECTION_REFS]))


# The shapes of numbered headings (kind, pattern, group of the number, group of the title).
HEADINGS = (
    ("part", r"(?i)^Part\s+(\d+|[IVX]+)\b\s*[–—:.-]?\s*(.*)$", 1, 2),
    ("appendix", r"^(Appendix|Annex|Schedule)\s+([A-Z0-9]{1,3})\b\s*[–—:.-]?\s*(.*)$", 2, 3),
    ("numbered", r"^(\d{1,3}(?:\.\d{1,3})*)\.?\s+(\S.*)$", 1, 2),
    ("lettered", r"^([A-Z])\.\s+(\S.*)$", 1, 2),
)


def heading_parts(line: Column, digits: int = 3) -> Column:
    """Struct (kind, number, title) of a heading: "Part N" for parts, the letter of appendices; kind and number are null for other lines.

    A part or appendix without a title of its own has the whole line as its title.
    Section numbers have at most ``digits`` digits between their points.
    """
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("number"), line.alias("title"))
    for kind, pattern, number, title in reversed(HEADINGS):
        pattern = pattern.replace(r"\d{1,3}", rf"\d{{1,{digits}}}") if kind == "numbered" else pattern
        n, t = F.regexp_extract(line, pattern, number), F.trim(F.regexp_extract(line, pattern, title))
        n = F.concat(F.lit("Part "), n) if kind == "part" else n
        out = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), n.alias("number"), F.when(t == "", line).otherwise(t).alias("title"))).otherwise(out)
    return out


def redacted(headers: Column, secret: tuple[str, ...] = ("authorization", "cookie", "set-cookie", "x-api-key")) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*secret), "***").otherwise(v))


def capped(body: Column, most: int = 65536) -> tuple[Column, Column]:
    """The body up to a length, and whether it was cut."""
    return F.substring(body, 1, most), F.coalesce(F.length(body) > most, F.lit(False))


def topic_words(title: Column, generic: tuple[str, ...] = ("policy", "procedure", "guideline", "manual", "general")) -> Column:
    """Words of a title without a plural s and without generic ones."""
    words = F.transform(F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda w: F.length(w) > 2), lambda w: F.when(w.rlike("[^s]s$"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*generic)))


def table_cleaned(table: Column) -> Column:
    """Cells cleaned, rows without any text dropped, every row padded to the widest, and columns without any text dropped."""
    filled = F.filter(F.transform(table, lambda r: F.transform(r, T.cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.coalesce(F.array_max(F.transform(filled, F.size)), F.lit(0))
    padded = F.transform(filled, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    used = lambda i: F.exists(padded, lambda r: F.get(r, i) != "")
    return F.transform(padded, lambda r: F.filter(r, lambda c, i: used(i)))


def markdown_rows(table: Column) -> Column:
    """A table as Markdown lines, pipes escaped, with a rule under the first row."""
    lines = F.transform(table, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(F.get(table, F.lit(0)))))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def noise_floor(pairs: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """|mean difference| of an A/A pair: what a change has to exceed."""
    return pairs.groupBy(*by).agg(F.abs(F.avg(F.col(b) - F.col(a))).alias("floor"), F.count(F.lit(1)).alias("n"))


def check_verdict(overlap: Column, duplicate: Column, eligible: Column) -> tuple[Column, Column]:
    """(failures, warnings) of a synthetic case: copied from 0.6, warned from 0.4, duplicate from 0.7."""
    some = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())
    return some((overlap >= 0.6, "copied"), (duplicate >= 0.7, "duplicate"), (~eligible, "ineligible")), some(((overlap >= 0.4) & (overlap < 0.6), "overlap"))


def case_pass_rows(cases: DataFrame, by: str) -> DataFrame:
    """case_pass over done cases with a verdict, and error_rate over done and failed ones, as metric rows."""
    done = F.col("status") == "done"
    sums = cases.groupBy(by).agg(F.avg(F.when(done, F.col("passed").cast("double"))).alias("case_pass"), F.avg(F.when(done | (F.col("status") == "error"), (F.col("status") == "error").cast("double"))).alias("error_rate"))
    return sums.unpivot([by], ["case_pass", "error_rate"], "metric", "value")


def run_cost_estimate(cases: int, judge_checks: float, app_per_case: float = 0.0012, judge_per_check: float = 0.003) -> float:
    """Dollars that a run of so many cases will cost."""
    return round(cases * app_per_case + cases * judge_checks * judge_per_check, 6)


def cost_of(cases: Column, judge_checks: Column, app_per_case: float = 0.0012, judge_per_check: float = 0.003) -> Column:
    """:func:`run_cost_estimate` of columns."""
    return F.round(cases * app_per_case + cases * judge_checks * judge_per_check, 6)


def chunk_counts(documents: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(key, chunks) of every document, 0 without chunks; counted before the join."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return documents.select(key).join(counts, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("chunks"))


def synced(chunks: DataFrame, documents: DataFrame, edits: DataFrame, key: str, columns: list[str], reindex: list[str]) -> DataFrame:
    """Chunks with the columns of their documents after edits (null changes nothing), and whether a column that forces a new index changed."""
    new = edits.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    now = documents.select(key, *columns).join(new, key, "left")
    changed = F.lit(False)
    for c in reindex:
        changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)))
    now = now.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns], changed.alias("reindex"))
    return chunks.join(now, key)


def committed(candidates: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Candidates that become cases: approved, not committed before, whose key no case has; of several with one key the first."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = candidates.filter((F.col("status") == "approved") & ~F.col("committed")).join(existing.select(key).distinct(), key, "left_anti")
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def summaries(scores: DataFrame, by: str, value: str, passed: Column) -> DataFrame:
    """n, mean, p50 and p95 of a measure and the share that passed."""
    p = lambda q: F.percentile(value, F.lit(q))
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.avg(passed.cast("int")).alias("pass_rate"))
