"""Tables whose rows are replaced by key, in versions that readers see whole or not at all.

A table is a folder: ``data/<commit>/_bucket=<n>`` has the rows of a bucket as
one commit wrote them, and ``_versions/<number>.json`` is a manifest that names
each bucket's live folder with its count of rows. A replacement reads the
buckets of its keys only, writes them once to a new commit, and renames a new
manifest into place. The rename is what publishes: before it the old version is
whole and readable, after it the new one, and of two writers that began from
one version the second fails with ``Conflict`` and has to begin anew.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to become."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of what a folder has; nothing where there is none."""
    place, fs = _files(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(place)] if fs.exists(place) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n, _ in _listed(spark, f"{path}/_versions") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's manifest, by default the last one's; none where the table has no version. A version that is gone is an error."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    place, fs = _files(spark, f"{path}/_versions/{version:012d}.json")
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets. Without any version there is nothing to read, which is an error."""
    known = manifest(spark, path, version)
    if known is None:
        raise FileNotFoundError(f"{path} has no version")
    return _rows(spark, path, known, buckets)


def _rows(spark: SparkSession, path: str, known: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(known["schema"])
    live = [f"{path}/{x['at']}" for b, x in sorted(known["live"].items()) if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*live) if live else spark.createDataFrame([], schema)


def counted(spark: SparkSession, path: str, version: int | None = None) -> int:
    """Rows of a version, from its manifest."""
    known = manifest(spark, path, version)
    return sum(x["rows"] for x in known["live"].values()) if known else 0


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def asked_buckets(asked: DataFrame, keys: list[str], buckets: int) -> set[int]:
    """The buckets that keys lie in: at most as many numbers as the table has buckets."""
    return {r["b"] for r in asked.select(bucket_of(keys, buckets).alias("b")).distinct().collect()}


def publish(spark: SparkSession, path: str, base: dict | None, rows: DataFrame, affected: set[int] | None, keys: list[str], buckets: int, ready: bool = False) -> int:
    """Write ``rows`` (with _bucket) as all that ``affected`` buckets have from now on (None: the whole table), and publish.

    Affected buckets without rows are empty from now on. Large buckets are
    dealt over several tasks, unless the rows are ``ready`` as they stand.
    """
    at = f"data/{uuid.uuid4().hex}"
    schema = rows.drop("_bucket").schema
    if base is not None and StructType.fromJson(base["schema"]).simpleString() != schema.simpleString():
        raise ValueError("the table has other columns")
    (rows if ready else rows.hint("rebalance", "_bucket")).write.partitionBy("_bucket").parquet(f"{path}/{at}")
    fresh = {}
    if any(n.startswith("_bucket=") for n, _ in _listed(spark, f"{path}/{at}")):
        for r in spark.read.parquet(f"{path}/{at}").groupBy("_bucket").count().collect():  # a row for each bucket
            fresh[str(r["_bucket"])] = {"at": f"{at}/_bucket={r['_bucket']}", "rows": r["count"]}
    stay = {b: x for b, x in base["live"].items() if affected is not None and int(b) not in affected} if base else {}
    number = base["version"] + 1 if base else 1
    _commit(spark, path, {"version": number, "keys": keys, "buckets": buckets, "schema": schema.jsonValue(), "live": stay | fresh})
    return number


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    jvm = spark._jvm
    beside, fs = _files(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    stream = fs.create(beside)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    final, _ = _files(spark, f"{path}/_versions/{state['version']:012d}.json")
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, final, plain)
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {state['version']} of {path} is another writer's") from e
        raise


def _began(spark: SparkSession, path: str, keys: list[str], buckets: int) -> tuple[dict | None, int]:
    base = manifest(spark, path)
    if base is not None and base["keys"] != keys:
        raise ValueError(f"the table's keys are {base['keys']}")
    return base, base["buckets"] if base else buckets


def replace(rows: DataFrame, path: str, keys: list[str], asked: DataFrame | None = None, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> int:
    """Put ``rows`` in place of all rows with the keys of ``asked`` (by default, of ``rows``); gives the new version's number.

    Keys that are asked for and have no new row go; nulls in keys are values like
    others. ``order`` sorts rows within files. The number of buckets is set by a
    table's first version.
    """
    spark = rows.sparkSession
    base, buckets = _began(spark, path, keys, buckets)
    asked = (rows if asked is None else asked).select(*keys).distinct()
    affected, new = asked_buckets(asked, keys, buckets), rows
    if base is not None:
        old, names = _rows(spark, path, base, affected), [f"_key{i}" for i in range(len(keys))]
        if sorted(old.columns) != sorted(rows.columns):
            raise ValueError(f"the table's columns are {old.columns}")
        gone = asked.toDF(*names)
        same = [old[k].eqNullSafe(gone[n]) for k, n in zip(keys, names, strict=True)]
        new = rows.select(*old.columns).unionByName(old.join(gone, same, "left_anti"))
    new = new.withColumn("_bucket", bucket_of(keys, buckets))
    if order:
        new = new.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", *order)
    return publish(spark, path, base, new, affected, keys, buckets, ready=bool(order))


def upsert(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Insert rows, in place of those that have their keys. A key that repeats in ``rows`` is an error: neither could be said to be the last."""
    twice = rows.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {tuple(twice[0])[:-1]} repeats")
    return replace(rows, path, keys, buckets=buckets)


def insert_missing(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> int:
    """Insert one row of each key that the table lacks; rows that it has stay as they are."""
    spark = rows.sparkSession
    base, buckets = _began(spark, path, keys, buckets)
    rows = rows.dropDuplicates(keys)
    if base is not None:
        old, names = _rows(spark, path, base, asked_buckets(rows, keys, buckets)).select(*keys), [f"_key{i}" for i in range(len(keys))]
        known = old.toDF(*names)
        rows = rows.join(known, [rows[k].eqNullSafe(known[n]) for k, n in zip(keys, names, strict=True)], "left_anti")
    return replace(rows, path, keys, buckets=buckets)


def remove(gone: DataFrame, path: str, keys: list[str]) -> int:
    """Remove all rows with the keys of ``gone``."""
    spark = gone.sparkSession
    return replace(_rows(spark, path, manifest(spark, path), set()), path, keys, asked=gone)


def expire(spark: SparkSession, path: str, keep: int = 2, older_than_s: float = 86_400) -> list[str]:
    """Forget all but the last ``keep`` versions, and remove what no kept version names and nobody has written to for a while; gives the commits removed."""
    known = versions(spark, path)
    for v in known[: max(0, len(known) - keep)]:
        place, fs = _files(spark, f"{path}/_versions/{v:012d}.json")
        fs.delete(place, False)
    used = {x["at"].split("/")[1] for v in known[max(0, len(known) - keep) :] for x in manifest(spark, path, v)["live"].values()}
    gone = [n for n, at in _listed(spark, f"{path}/data") if n not in used and at <= (time.time() - older_than_s) * 1000]
    for n in gone:
        place, fs = _files(spark, f"{path}/data/{n}")
        fs.delete(place, True)
    return gone
