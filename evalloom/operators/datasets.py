"""Dataset versions, calibration badges, settings, memberships and review samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions.config import canonical_json
from evalloom.sources.session import python_ready

# Presets of a range in days, the longest custom range, and from how many days on weeks are shown.
PRESETS, MOST_DAYS, WEEKS_FROM = {"7d": 7, "30d": 30, "90d": 90}, 366, 93


def resolve_range(preset: str | None, start: str | None, end: str | None, today: dt.date) -> tuple[str, dt.date, dt.date, int, str]:
    """(key, first day, last day, days, grain) of a requested range.

    A custom range needs two dates in order; it ends today at the latest and has
    at most ``MOST_DAYS`` days. Anything else is a preset, 30 days by default.
    """

    def read(x: str | None) -> dt.date | None:
        try:
            return dt.datetime.strptime(x, "%Y-%m-%d").date() if x and len(x) == 10 else None
        except ValueError:
            return None

    a, b = read(start), read(end)
    if preset == "custom" and a and b and a <= b:
        last = min(b, today)
        days = min((last - min(a, last)).days + 1, MOST_DAYS)
        return "custom", last - dt.timedelta(days - 1), last, days, "week" if days >= WEEKS_FROM else "day"
    key = preset if preset in PRESETS else "30d"
    return key, today - dt.timedelta(PRESETS[key] - 1), today, PRESETS[key], "day"


def effective_settings(orgs: DataFrame, stored: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Every organisation with its stored settings; a null, empty or zero one falls back to the default."""
    rows = orgs.select(key).join(stored, key, "left")
    given = lambda c: F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c))
    return rows.select(key, *[F.coalesce(given(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def org_access(orgs: DataFrame, members: DataFrame, org: str, user) -> DataFrame:
    """Organisations with the user's role, null where they are no member."""
    mine = members.filter(F.col("user_id") == user).groupBy(org).agg(F.min("role").alias("role"))
    return orgs.join(mine, org, "left")


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the distinct keys of two frames: both, only_a or only_b. Null keys are left out."""
    x, y = (d.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(f"_{n}", F.lit(True)) for d, n in ((a, "a"), (b, "b")))
    side = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "only_a").otherwise("only_b")
    return x.join(y, key, "full_outer").select(key, side.alias("side"))


def request_hash(request: Column, sample: Column) -> Column:
    """Digest of a request (JSON) with its sample number: keys sorted, no blanks, so that equal requests share one memo entry."""
    body = F.concat(F.lit('{"request":'), canonical_json(request), F.lit(',"sample_idx":'), sample.cast("string"), F.lit("}"))
    return F.sha2(body, 256)


def badges(metrics: DataFrame, targets: DataFrame, calibrations: DataFrame) -> DataFrame:
    """(metric, status, n, kappa, calibration_id, latest_id): how far a metric's judge is calibrated.

    ``metrics``: metric, reviewable. ``targets``: metric, prompt_version, judge_model.
    ``calibrations``: id, metric, prompt_version, judge_model, status, n, kappa,
    created_at. A calibration of the target's very version and model gives its
    status (the newest of several); one of another gives "stale" and is named as
    the latest (highest version, newest first); else uncalibrated. Calibrations
    of no reviews do not count.
    """
    used = calibrations.filter("n > 0")
    newest = F.max(F.struct("created_at", "id", "status", "n", "kappa"))
    exact = used.groupBy("metric", "prompt_version", "judge_model").agg(newest.alias("e"))
    latest = used.groupBy("metric").agg(F.max_by("id", F.struct("prompt_version", "created_at", "id")).alias("_latest"))
    rows = metrics.join(targets, "metric", "left").join(exact, ["metric", "prompt_version", "judge_model"], "left").join(latest, "metric", "left")
    live = F.col("reviewable")
    status = F.when(live & F.col("e").isNotNull(), F.col("e.status")).when(live & F.col("_latest").isNotNull(), "stale").otherwise("uncalibrated")
    own = lambda c: F.when(live, F.col(f"e.{c}"))
    return rows.select("metric", status.alias("status"), F.coalesce(own("n"), F.lit(0)).alias("n"), own("kappa").alias("kappa"), own("id").alias("calibration_id"), F.when(live & F.col("e").isNull(), F.col("_latest")).alias("latest_id"))


def disagreement_sample(scores: DataFrame, case: str, score: str, size: int, seed: int) -> DataFrame:
    """(case, score, pos): the cases that disagree most (score > 0), ties in the order of seeded hashes, dealt out in another seeded order."""
    draw = lambda tag: F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.lit(tag), F.col(case).cast("string")), 256)
    top = scores.filter(F.col(score) > 0).orderBy(F.desc(score), draw("tie"), case).limit(size)
    return top.select(case, score, F.row_number().over(Window.orderBy(draw("deal"), case)).alias("pos"))  # as many rows as were asked for


def new_versions(versions: DataFrame, cases: DataFrame, dataset: str = "dataset_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drafts, copied cases, refused): a new draft of every dataset, copied from its latest version.

    A dataset that has a draft is refused with that draft's number. ``versions``:
    dataset, version, status; ``cases``: dataset, version, position and content.
    """
    state = versions.groupBy(dataset).agg(F.max("version").alias("_latest"), F.max(F.when(F.col("status") == "draft", F.col("version"))).alias("draft"))
    free = state.filter(F.col("draft").isNull())
    drafts = free.select(dataset, (F.col("_latest") + 1).alias("version"), F.lit("draft").alias("status"))
    copied = cases.join(free, (cases[dataset] == free[dataset]) & (cases["version"] == free["_latest"])).select(cases[dataset], *[cases[c] for c in cases.columns if c not in (dataset, "version")], (F.col("_latest") + 1).alias("version"))
    return drafts, copied, state.filter(F.col("draft").isNotNull()).select(dataset, F.col("draft").alias("version"))


def published(versions: DataFrame, cases: DataFrame, content: list[str], dataset: str = "dataset_id") -> DataFrame:
    """(dataset, version, status, case_count, content_hash): drafts with cases become published, others are as they were.

    The hash is over the sorted digests of the cases' canonical JSON, so that the
    order of cases does not matter. A published version never changes.
    """
    python_ready(versions.sparkSession)
    digest = F.sha2(canonical_json(F.to_json(F.struct(*sorted(content)))), 256)
    sums = cases.withColumn("_h", digest).groupBy(dataset, "version").agg(F.count(F.lit(1)).alias("case_count"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("content_hash"))
    rows = versions.join(sums, [dataset, "version"], "left")
    turns = (F.col("status") == "draft") & F.col("case_count").isNotNull()
    live = turns | (F.col("status") == "published")
    return rows.select(dataset, "version", F.when(turns, "published").otherwise(F.col("status")).alias("status"), F.coalesce("case_count", F.lit(0)).alias("case_count"), F.when(live, F.col("content_hash")).alias("content_hash"))
