"""Streaming, state, file and evaluation-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.functions import text as T
from evalloom.operators import relational as R
from evalloom.operators import set_similarity as SS
from evalloom.operators import statistics as S
from evalloom.plans.registry import query
from evalloom.sources import files
from evalloom.sources.standins import duck, table
from evalloom.streaming import feeds

_COUNT = "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS messages, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2"


@query("strs3_monthly_quota", _COUNT)
def quota(spark, d):
    """A complete-mode stream over the event files."""
    return feeds.drained(feeds.monthly_counters(feeds.event_stream(spark, d)))


@query("strs4_quota_status", f"""WITH c AS ({_COUNT}) SELECT user_id, month, CASE WHEN user_id % 10 = 0 THEN 40 ELSE 25 END AS message_limit, CASE WHEN user_id % 10 = 0 THEN 900 ELSE 200000 END AS token_limit,
CASE WHEN user_id % 30 = 0 THEN NULL WHEN messages >= CASE WHEN user_id % 10 = 0 THEN 40 ELSE 25 END THEN 'messages' WHEN tokens >= CASE WHEN user_id % 10 = 0 THEN 900 ELSE 200000 END THEN 'tokens' END AS exhausted FROM c""")
def quota_status(spark, d):
    limits = table(spark, d, "events").select("user_id").distinct().filter("user_id % 10 = 0").selectExpr("user_id", "40 AS message_limit", "900 AS token_limit", "user_id % 30 = 0 AS is_admin")
    return feeds.quota_status(feeds.monthly_counters(table(spark, d, "events")), limits)


@query("strs1_progress_feed", "SELECT event_id, ts, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-20 00:00:00', 0) ORDER BY ts, event_id LIMIT 50")
def feed(spark, d):
    return feeds.changes_after(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_id", ("2024-01-20 00:00:00", 0))


_QUEST = """WITH f AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS n FROM f)
SELECT user_id, count(*)::INT AS progress, min(CASE WHEN n = 3 THEN t END) AS done_at FROM r GROUP BY user_id"""


@query("strs10_quest_fold", _QUEST)
def quests(spark, d):
    return feeds.quest_fold(table(spark, d, "events"))


@query("strs10_quest_stream", _QUEST)
def quest_stream(spark, d):
    """The stateful stream; its last update of each user."""
    out = feeds.drained(feeds.quest_stream(feeds.event_stream(spark, d)), "update")
    return out.groupBy("user_id").agg(F.max("progress").alias("progress"), F.min("done_at").cast("timestamp_ntz").alias("done_at"))


@query("add_tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    """An addition to the reference's surface."""
    rows = feeds.drained(feeds.tumbling(feeds.event_stream(spark, d).withColumn("ts", F.col("ts")), "6 hours"), "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("add_session_windows", """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def session(spark, d):
    """An addition to the reference's surface."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feeds.sessions(e, "4 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("strs12_idempotent", "SELECT count(*) AS n FROM events")
def idempotent(spark, d):
    """Every event delivered twice, counted once."""
    e = table(spark, d, "events")
    return feeds.deduplicated(e.unionByName(e)).agg(F.count(F.lit(1)).alias("n"))


@query("strs11_merged_state", """WITH s AS (SELECT user_id, count(*) AS progress, min(ts) AS done_at, list(DISTINCT event_type) AS cards, event_id % 2 AS half FROM events GROUP BY user_id, event_id % 2)
SELECT user_id, max(progress) AS progress, min(done_at) AS done_at, array_to_string(list_sort(list_distinct(flatten(list(cards)))), ',') AS cards FROM s GROUP BY 1""")
def merged(spark, d):
    e = table(spark, d, "events")
    half = lambda k: e.filter(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count(F.lit(1)).alias("progress"), F.min("ts").alias("done_at"), F.collect_set("event_type").alias("cards"))
    return feeds.merged_state(half(0), half(1), ["user_id"]).withColumn("cards", F.array_join("cards", ","))


@query("strs7_run_state", """WITH c AS (SELECT o_custkey AS run, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'P') AS in_flight, ['running', 'stopping', 'pausing'][1 + o_custkey % 3] AS status FROM orders GROUP BY 1)
SELECT run, CASE WHEN status = 'stopping' AND in_flight = 0 THEN 'finalizing' WHEN status = 'pausing' AND in_flight = 0 THEN 'paused' WHEN status = 'running' AND finished >= total THEN 'finalizing' ELSE status END AS state FROM c""")
def run_state(spark, d):
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "P").alias("in_flight"))
    status = F.get(F.array(F.lit("running"), F.lit("stopping"), F.lit("pausing")), (F.col("run") % 3).cast("int"))
    return c.select("run", feeds.run_state(status, F.col("total"), F.col("finished"), F.col("in_flight")).alias("state"))


@query("src06_jsonl_import", """WITH l AS (SELECT row_number() OVER (ORDER BY event_id) AS line_no, event_id % 3000 AS k, event_type, event_id FROM events)
SELECT line_no, CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(k AS VARCHAR) END AS case_key, CASE WHEN event_id % 101 = 0 THEN 'answer' ELSE event_type END AS type,
CASE WHEN event_id % 101 = 0 THEN 'not JSON' WHEN row_number() OVER (PARTITION BY CASE WHEN event_id % 101 = 0 THEN NULL ELSE k END ORDER BY line_no) > 1 THEN 'duplicate key' WHEN line_no > 2000 THEN 'too many rows' END AS error FROM l""")
def jsonl(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 101 == 0, "{broken").otherwise(F.to_json(F.struct((F.col("event_id") % 3000).alias("key"), F.col("event_type").alias("kind"))))
    lines = files.line_numbers(e.select("event_id", text.alias("value")), "event_id")
    return files.cases(lines, {"case_key": "key", "type": "kind"}, {"type": "answer"}).select("line_no", "case_key", "type", "error")


@query("src10_server_events", "SELECT conv_id, CAST(turn AS BIGINT) AS seq, role AS event, CAST(length(text) AS BIGINT) AS n FROM conversations WHERE text NOT LIKE '%' || chr(10) || '%' AND conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) = count(*) - 1 AND min(turn) = 0 AND NOT bool_or(text LIKE '%' || chr(10) || '%'))")
def sse(spark, d):
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.max("turn").alias("m"), F.count(F.lit(1)).alias("n"), F.min("turn").alias("lo"), F.bool_or(F.col("text").contains("\n")).alias("nl"))
    g = g.filter("m = n - 1 AND lo = 0 AND NOT nl").select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("event: "), x["role"], F.lit("\ndata: "), x["text"])), "\n\n").alias("s"))
    return files.server_events(g, "conv_id", "s").select("conv_id", F.col("seq").cast("long").alias("seq"), "event", F.char_length("data").cast("long").alias("n"))


@query("snk09_canonical_jsonl", """SELECT '{"n_name":"' || n_name || '","n_regionkey":' || CAST(n_regionkey AS VARCHAR) || '}' AS value FROM nation""")
def canonical(spark, d):
    return files.canonical_lines(table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name"), "n_nationkey")


@query("snk08_run_export", """SELECT r_name AS run, count(*) AS cases, string_agg(n_name, ';' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def export(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    nested = r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("cases"))
    return nested.select(F.col("r_name").alias("run"), F.size("cases").cast("long").alias("cases"), F.array_join(F.col("cases.n_name"), ";").alias("names"))


@query("snk11_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY")
def retention(spark, d):
    return files.retained(table(spark, d, "events"), "ts", "2024-01-30 00:00:00", 14).select("event_id")


@query("snk12_cascade", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 11 = 0) GROUP BY 1")
def cascade(spark, d):
    c = table(spark, d, "conversations")
    gone = c.filter("conv_id % 11 = 0").select("conv_id").distinct()
    return c.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg29_safety_panel", duck("run_scores") + " SELECT flag AS metric, count(*) FILTER (WHERE status = 'done') AS n, count(*) FILTER (WHERE status = 'done' AND hit = 0) AS bad, count(*) FILTER (WHERE status = 'error') AS errors, avg(hit) FILTER (WHERE status = 'done') AS mean FROM run_scores GROUP BY 1")
def safety(spark, d):
    done = F.col("status") == "done"
    return table(spark, d, "run_scores").groupBy(F.col("flag").alias("metric")).agg(F.count_if(done).alias("n"), F.count_if(done & (F.col("hit") == 0)).alias("bad"), F.count_if(F.col("status") == "error").alias("errors"), F.avg(F.when(done, F.col("hit"))).alias("mean"))


@query("agg30_retest_spread", "SELECT l_returnflag AS metric, l_linestatus AS model, count(*) AS n, avg(l_tax) AS spread FROM lineitem GROUP BY 1, 2")
def retest(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_tax").alias("spread"))


@query("agg31_common_judge", "SELECT o_orderpriority AS metric, o_orderstatus AS judge, n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) AS r FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def judge(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("metric"), F.col("o_orderstatus").alias("judge")).agg(F.count(F.lit(1)).alias("n"))
    return R.latest(g, ["metric"], [F.desc("n"), F.asc("judge")])


@query("agg38_version_counts", "SELECT p_brand AS prompt, count(*) AS versions, max(p_partkey) AS latest FROM part GROUP BY 1")
def versions(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("prompt")).agg(F.count(F.lit(1)).alias("versions"), F.max("p_partkey").alias("latest"))


@query("win08_trend_markers", duck("run_scores") + """, r AS (SELECT type, flag, finished_at, case_key, run, lag(flag) OVER (PARTITION BY type ORDER BY finished_at, case_key, run) AS before FROM run_scores) SELECT type, case_key, run, before, flag FROM r WHERE before <> flag""")
def trend(spark, d):
    r = table(spark, d, "run_scores").withColumn("before", F.lag("flag").over(Window.partitionBy("type").orderBy("finished_at", "case_key", "run")))
    return r.filter("before <> flag").select("type", "case_key", "run", "before", "flag")


@query("win13_aa_pair", "SELECT o_orderpriority AS fingerprint, max(CASE WHEN r = 1 THEN o_orderkey END) AS newest, max(CASE WHEN r = 2 THEN o_orderkey END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 2 GROUP BY 1")
def aa_pair(spark, d):
    top = R.top_per_key(table(spark, d, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2, "r")
    return top.groupBy(F.col("o_orderpriority").alias("fingerprint")).agg(F.max(F.when(F.col("r") == 1, F.col("o_orderkey"))).alias("newest"), F.max(F.when(F.col("r") == 2, F.col("o_orderkey"))).alias("second"))


@query("join10_score_call", "SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS call FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1")
def score_call(spark, d):
    return table(spark, d, "lineitem").filter("l_suppkey % 3 <> 0").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("call"))


@query("join22_title_match", r"""WITH s AS (SELECT p_partkey AS k, p_brand AS dept, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '')) AS t FROM part)
SELECT k, other, jaccard FROM (SELECT a.k, b.k AS other, len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)) AS contained, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM s a JOIN s b ON a.dept = b.dept AND a.k <> b.k)
WHERE contained >= 0.5 QUALIFY rank() OVER (PARTITION BY k ORDER BY contained DESC, jaccard DESC) = 1""")
def title_match(spark, d):
    return title_match_all(spark, d)


@query("join22_title_match_all")
def title_match_all(spark, d):
    """Parts of a department with equal words are one class; classes are matched, then their members paired."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("p_name"), "[^a-z0-9]+"), lambda w: w != "")))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("dept"), words.alias("x"))
    classes = s.groupBy("dept", "x").agg(F.count(F.lit(1)).alias("n"))
    # a class stands for its words; one with several members is also its own partner
    sets = SS.ordered_sets(classes.withColumn("w", F.col("x")), ["dept"], "x", "w")
    both = SS.contained_pairs(sets, ["dept"], "x", 0.5).withColumnRenamed("other", "y")
    own = classes.filter((F.col("n") > 1) & (F.size("x") > 0)).select("dept", "x", F.col("x").alias("y"), F.lit(1.0).alias("contained"), F.lit(1.0).alias("jaccard"))
    both = both.unionByName(own)
    rank = F.rank().over(Window.partitionBy("dept", "x").orderBy(F.desc("contained"), F.desc("jaccard")))
    best = both.withColumn("r", rank).filter("r = 1").select("dept", "x", "y", "jaccard")
    others = s.select("dept", F.col("k").alias("other"), F.col("x").alias("y"))
    return s.join(best, ["dept", "x"]).join(others, ["dept", "y"]).filter("k <> other").select("k", "other", "jaccard")


@query("sta15_rotating_suffix", "SELECT o_orderkey, ['a', 'b', 'c'][1 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3] AS suffix FROM orders")
def rotating(spark, d):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, d, "orders").select("o_orderkey", F.get(F.array(*map(F.lit, "abc")), nth % 3).alias("suffix"))


@query("sta25_queue_progress", duck("run_scores") + " SELECT type, count(*) AS items, count(*) FILTER (WHERE hit = 1) AS graded, min(CASE WHEN hit = 0 THEN case_key END) AS next FROM run_scores GROUP BY 1")
def progress(spark, d):
    return table(spark, d, "run_scores").groupBy("type").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("hit") == 1).alias("graded"), F.min(F.when(F.col("hit") == 0, F.col("case_key"))).alias("next"))


@query("sta14_robustness", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount - l_tax) > greatest(l_tax, l_discount / 2, 0.02) THEN 'moved' ELSE 'stable' END AS verdict FROM lineitem")
def robustness(spark, d):
    moved = F.abs(F.col("l_discount") - F.col("l_tax")) > F.greatest(F.col("l_tax"), F.col("l_discount") / 2, F.lit(0.02))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(moved, "moved").otherwise("stable").alias("verdict"))


@query("sta34_enrichment", "SELECT doc_id, source, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars >= 320) WHERE r <= 8")
def enrichment(spark, d):
    return R.top_per_key(table(spark, d, "documents").filter("n_chars >= 320"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8, "r").select("doc_id", "source", "r")


@query("sta35_commit", "SELECT event_type AS case_key, 'new' AS state FROM events GROUP BY 1 HAVING event_type NOT IN ('click', 'view')")
def commit(spark, d):
    have = spark.createDataFrame([("click",), ("view",)], "case_key string")
    new = table(spark, d, "events").select(F.col("event_type").alias("case_key")).distinct()
    return new.join(have, "case_key", "left_anti").withColumn("state", F.lit("new"))


@query("sta36_version_hash", "SELECT n_regionkey AS version, sha256(string_agg(n_name, chr(31) ORDER BY n_name)) AS h FROM nation GROUP BY 1")
def version_hash(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("version")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "\x1f"), 256).alias("h"))


@query("sta18_tie_ranks_by_flag", "SELECT l_returnflag AS g, count(*) AS n FROM lineitem GROUP BY 1")
def tie_ranks(spark, d):
    return S.spearman(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_tax", ["g"]).select("g", "n")
