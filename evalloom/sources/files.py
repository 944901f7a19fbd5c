"""Readers and writers of the application's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.sources.session import shared_place


def cases(lines: DataFrame, mapping: dict[str, str], defaults: dict[str, str], key: str = "case_key", lists: tuple[str, ...] = (), most: int = 2000) -> DataFrame:
    """JSON lines (line_no, value) as cases: fields renamed, defaults filled in, "a|b" split, an error for each bad line.

    error is "not JSON", "no key" or "duplicate key" (for all but the first); a
    line beyond ``most`` is "too many rows", which is the import's own limit.
    """
    parsed = lines.select("line_no", F.try_parse_json("value").alias("_v"))
    field = lambda name: F.coalesce(F.try_variant_get("_v", f"$.{mapping.get(name, name)}", "string"), F.lit(defaults.get(name)))
    names = list(dict.fromkeys([key, *mapping, *defaults]))
    rows = parsed.select("line_no", F.col("_v").isNull().alias("_bad"), *[field(n).alias(n) for n in names])
    nth = F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    error = F.when(F.col("_bad"), "not JSON").when(F.col(key).isNull(), "no key").when(nth > 1, "duplicate key").when(F.col("line_no") > most, "too many rows")
    rows = rows.withColumn("error", error).drop("_bad")
    for n in lists:
        rows = rows.withColumn(n, F.filter(F.transform(F.split(n, r"\|"), F.trim), lambda x: x != ""))
    return rows


def line_numbers(df: DataFrame, order: str, into: str = "line_no") -> DataFrame:
    """Rows with dense numbers from 1 in the order of a column that has no ties.

    One range shuffle sorts the rows into written partitions; only one count for
    each partition is summed up in one task.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    path = shared_place(df.sparkSession)
    df.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_part": F.spark_partition_id(), "_local": local}).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    return dealt.join(starts, "_part").withColumn(into, F.col("_start") + F.col("_local") + 1).drop("_part", "_local", "_start")


def front_matter(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Front matter as a map, and the body, of "---" headed files; a file without has an empty map."""
    has = F.col(text).rlike(r"^---\n(?s:.*?)\n---\n")
    head = F.regexp_extract(text, r"^---\n((?s:.*?))\n---\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))
    empty = F.create_map().cast("map<string,string>")
    return files.select(path, F.when(has, F.map_from_entries(entries)).otherwise(empty).alias("header"), F.when(has, F.regexp_replace(text, r"^---\n(?s:.*?)\n---\n", "")).otherwise(F.col(text)).alias("body"))


def server_events(streams: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, event, data) of recorded event streams: blocks apart by empty lines, data lines joined; comments and blocks without data go."""
    blocks = streams.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n\n+")).alias("seq", "b"))
    lines = F.split("b", "\n")
    value = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    data = value("data")
    return blocks.filter(F.size(data) > 0).select(key, "seq", F.coalesce(F.get(value("event"), F.lit(0)), F.lit("message")).alias("event"), F.array_join(data, "\n").alias("data"))


def uploads(spark: SparkSession, folder: str, magic: bytes, most: int) -> DataFrame:
    """Files of a folder with digest, size and whether their first bytes and size are accepted."""
    files = spark.read.format("binaryFile").load(folder)
    ok = (F.substring("content", 1, len(magic)) == F.lit(magic)) & (F.col("length") <= most)
    return files.select("path", F.sha2("content", 256).alias("digest"), "length", ok.alias("accepted"))


def canonical_lines(df: DataFrame, order: str) -> DataFrame:
    """One JSON object for each row, keys sorted, in order of a column; nulls are left out."""
    names = sorted(c for c in df.columns if c != order)
    return df.select(order, F.to_json(F.struct(*names)).alias("value")).orderBy(order).select("value")


def retained(df: DataFrame, at: str, now: str, days: int) -> DataFrame:
    """Rows that are not older than so many days."""
    return df.filter(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def markdown_table(rows: DataFrame, columns: list[str], title: str, most: int = 1000) -> str:
    """A small result as a report; more than ``most`` rows are refused, not cut."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    body = ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in found]
    return "\n".join([f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *body])
