"""Filters, joins, windows, sorts, paging and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalloom.operators import relational as R
from evalloom.plans.registry import query
from evalloom.sources import snapshots
from evalloom.sources.session import shared_place
from evalloom.sources.standins import duck, table


@query("flt01_optional_predicates", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'")
def optional(spark, d):
    return R.optional(table(spark, d, "orders"), o_orderstatus=["F", "O"], o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_orderstatus")


@query("flt02_status_class", "SELECT event_id, CAST(200 + event_id % 400 AS BIGINT) AS code FROM events WHERE 200 + event_id % 400 BETWEEN 400 AND 499")
def status_class(spark, d):
    e = table(spark, d, "events").select("event_id", (200 + F.col("event_id") % 400).alias("code"))
    return e.filter(R.status_class(F.col("code"), "4xx"))


@query("flt03_log_search", r"SELECT doc_id, source FROM documents WHERE source ILIKE '%src1%' OR lang ILIKE '%e\_s%' ESCAPE '\'")
def log_search(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(R.contains_any("src1", "source") | R.contains_any("e_s", "lang")).select("doc_id", "source")


@query("flt05_document_list", duck("docs") + " SELECT doc_id, status, department FROM docs WHERE status = 'ready' AND department = 'src3' AND text ILIKE '%the%'")
def doc_list(spark, d):
    return R.optional(table(spark, d, "docs"), status="ready", department="src3").filter(R.contains_any("the", "text")).select("doc_id", "status", "department")


@query("flt06_array_membership", "SELECT user_id FROM events GROUP BY user_id HAVING list_contains(list(DISTINCT event_type), 'purchase')")
def membership(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return e.filter(F.array_contains("tags", "purchase")).select("user_id")


@query("flt07_metric_below", duck("run_scores") + " SELECT case_key, run FROM run_scores WHERE case_key IN (SELECT case_key FROM run_scores WHERE faithfulness < 0.02)")
def metric_below(spark, d):
    s = table(spark, d, "run_scores")
    low = s.filter("faithfulness < 0.02").select("case_key")
    return s.join(low, "case_key", "left_semi").select("case_key", "run")


@query("flt08_json_flag", "SELECT event_id, CASE WHEN props LIKE '{%}' THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_flag(spark, d):
    return json_flag_all(spark, d)


@query("flt08_json_flag_all")
def json_flag_all(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("props").like("{%}"), F.get_json_object("props", "$.k")).alias("k"))


@query("flt09_chunk_eligibility", duck("docs") + " SELECT doc_id FROM docs WHERE status = 'ready' AND n_chars >= 320 AND doc_type NOT IN ('manual')")
def eligible(spark, d):
    return table(spark, d, "docs").filter((F.col("status") == "ready") & (F.col("n_chars") >= 320) & ~F.col("doc_type").isin("manual")).select("doc_id")


@query("flt10_scope_rule", duck("docs") + """
, f AS (SELECT doc_id, CASE WHEN jurisdiction = 'de' THEN 0 WHEN jurisdiction = 'en' THEN 1 ELSE 2 END AS r FROM docs WHERE department = 'src2' AND (jurisdiction IN ('de', 'en') OR doc_type = 'manual'))
SELECT doc_id, CAST(row_number() OVER (ORDER BY r, doc_id) AS INT) AS ordinal FROM f ORDER BY r, doc_id LIMIT 50""")
def scope(spark, d):
    docs = table(spark, d, "docs").filter("department = 'src2' AND (jurisdiction IN ('de', 'en') OR doc_type = 'manual')")
    rank = F.when(F.col("jurisdiction") == "de", 0).when(F.col("jurisdiction") == "en", 1).otherwise(2)
    top = docs.select("doc_id", rank.alias("r")).orderBy("r", "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy("r", "doc_id")).alias("ordinal"))  # 50 rows


@query("prj01_rounding", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / 7, 8) AS v FROM lineitem")
def rounding(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7, 8).alias("v"))


@query("prj03_override_merge", duck("usage") + " SELECT id, coalesce(tier_actual, tier_requested) AS tier, coalesce(eval_run_id, 'none') AS run FROM usage")
def override(spark, d):
    return table(spark, d, "usage").select("id", F.coalesce("tier_actual", "tier_requested").alias("tier"), F.coalesce("eval_run_id", F.lit("none")).alias("run"))


@query("prj05_json_number", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ms FROM events")
def json_number(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_cast(variant_get(try_parse_json(props), '$.k', 'string') as double)").alias("ms"))


@query("prj06_age_bucket", """SELECT o_orderkey, CASE WHEN age < 1 THEN 'day' WHEN age < 7 THEN 'week' WHEN age < 30 THEN 'month' ELSE 'older' END AS age
FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '1998-08-01') AS age FROM orders)""")
def age_bucket(spark, d):
    age = F.datediff(F.lit("1998-08-01").cast("date"), F.col("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.when(age < 1, "day").when(age < 7, "week").when(age < 30, "month").otherwise("older").alias("age"))


@query("prj07_hours_left", "SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-01' - ts) / 3600) AS BIGINT) AS hours FROM events")
def hours_left(spark, d):
    end = F.lit("2024-02-01").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.floor((F.unix_micros(end) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9).alias("hours"))


@query("join05_usage_users", duck("usage") + " SELECT id, c_name FROM usage LEFT JOIN customer ON c_custkey = user_id")
def usage_users(spark, d):
    u, c = table(spark, d, "usage"), table(spark, d, "customer")
    return u.join(c, u["user_id"] == c["c_custkey"], "left").select("id", "c_name")


@query("join06_message_cost", duck("messages", "usage") + """
, c AS (SELECT message_id, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM usage GROUP BY 1) SELECT id, cost_usd FROM messages LEFT JOIN c ON message_id = id""")
def message_cost(spark, d):
    c = table(spark, d, "usage").groupBy("message_id").agg(F.sum("cost_usd").cast("double").alias("cost_usd"))
    m = table(spark, d, "messages")
    return m.join(c, m["id"] == c["message_id"], "left").select("id", "cost_usd")


@query("join08_lateral_totals", duck("usage") + """
, r AS (SELECT DISTINCT request_id FROM usage WHERE operation = 'route')
SELECT request_id, calls, tokens, cost_usd FROM r, LATERAL (SELECT count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, CAST(sum(cost_usd) AS DOUBLE) AS cost_usd FROM usage u WHERE u.request_id = r.request_id)""")
def lateral(spark, d):
    u = table(spark, d, "usage")
    sums = u.groupBy("request_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").cast("double").alias("cost_usd"))
    return u.filter("operation = 'route'").select("request_id").distinct().join(sums, "request_id")


@query("join09_latest_job", """
SELECT o_custkey, o_orderkey, n_orders FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders) WHERE nth = 1""")
def latest_job(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count(F.lit(1)).alias("n_orders"))


@query("join11_asof_question", duck("messages") + """
SELECT a.id, (SELECT q.content FROM messages q WHERE q.conv_id = a.conv_id AND q.role = 'user' AND q.turn <= a.turn ORDER BY q.turn DESC LIMIT 1) AS question FROM messages a WHERE a.role = 'assistant'""")
def asof_question(spark, d):
    m = R.as_of(table(spark, d, "messages"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("content")), "question")
    return m.filter("role = 'assistant'").select("id", "question")


@query("join14_live_jobs", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_semi").select("o_orderkey")


@query("join15_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("join17_full_outer", duck("run_scores") + """
, a AS (SELECT case_key, status FROM run_scores WHERE run = 'A'), b AS (SELECT case_key, status FROM run_scores WHERE run = 'B')
SELECT coalesce(a.case_key, b.case_key) AS case_key, CASE WHEN b.case_key IS NULL THEN 'only_a' WHEN a.case_key IS NULL THEN 'only_b' WHEN a.status = 'done' AND b.status = 'done' THEN 'paired' ELSE 'not_done' END AS kind
FROM a FULL OUTER JOIN b ON a.case_key = b.case_key""")
def full_outer(spark, d):
    s = table(spark, d, "run_scores")
    side = lambda run: s.filter(F.col("run") == run).select("case_key", F.col("status").alias(f"status_{run}"))
    kind = F.when(F.col("status_B").isNull(), "only_a").when(F.col("status_A").isNull(), "only_b").when((F.col("status_A") == "done") & (F.col("status_B") == "done"), "paired").otherwise("not_done")
    return side("A").join(side("B"), "case_key", "full_outer").select("case_key", kind.alias("kind"))


@query("join18_run_dataset", "SELECT n_name, r_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def run_dataset(spark, d):
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_name", "r_name", "s_name")


@query("join21_neighbours", duck("messages") + """
SELECT m.id, p.role AS before, n.role AS after FROM messages m LEFT JOIN messages p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 LEFT JOIN messages n ON n.conv_id = m.conv_id AND n.turn = m.turn + 1""")
def neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = table(spark, d, "messages")
    near = lambda f, step: F.when(f("turn").over(w) == F.col("turn") + step, f("role").over(w))
    return m.select("id", near(F.lag, -1).alias("before"), near(F.lead, 1).alias("after"))


@query("join24_code_lookup", "SELECT doc_id, coalesce(r_name, 'unknown') AS department FROM documents LEFT JOIN region ON source = 'src' || CAST(r_regionkey AS STRING)")
def lookup(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("src"), F.col("r_regionkey")).alias("source"), "r_name")
    return table(spark, d, "documents").join(r, "source", "left").select("doc_id", F.coalesce("r_name", F.lit("unknown")).alias("department"))


@query("win01_leaderboard", "SELECT event_type AS game, user_id, value AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) AS rank FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, ts, event_id) = 1)) WHERE rank <= 10")
def leaderboard(spark, d):
    order = [F.desc("value"), F.asc("ts"), F.asc("event_id")]
    best = R.latest(table(spark, d, "events"), ["event_type", "user_id"], order)
    return R.top_per_key(best, ["event_type"], order, 10).select(F.col("event_type").alias("game"), "user_id", F.col("value").alias("score"), "rank")


@query("win02_page_total", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def page_total(spark, d):
    return R.with_total(table(spark, d, "customer").select("c_custkey", "c_name"), [F.asc("c_name"), F.asc("c_custkey")], 20, 40)


@query("win03_distinct_on", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def distinct_on(spark, d):
    return R.latest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("win04_latest_version", """SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS latest, arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS published FROM orders GROUP BY 1""")
def latest_version(spark, d):
    published = F.max_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("latest"), published.alias("published"))


@query("win05_change_markers", """SELECT o_custkey, o_orderkey, o_orderpriority, prev FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL AND prev <> o_orderpriority""")
def markers(spark, d):
    o = table(spark, d, "orders").withColumn("prev", F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return o.filter("prev <> o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority", "prev")


@query("win11_interleave", """SELECT vec_id, part, CAST(row_number() OVER (ORDER BY r, part) AS INT) AS pos FROM (
SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r, part) AS nth FROM (
SELECT vec_id % 60 AS vec_id, vec_id % 4 AS part, row_number() OVER (PARTITION BY vec_id % 4 ORDER BY vec_id) AS r FROM embeddings)) WHERE nth = 1""")
def interleave(spark, d):
    return _interleave(table(spark, d, "embeddings"))


@query("win11_interleave_all")
def interleave_all(spark, d):
    return _interleave(table(spark, d, "embeddings"))


def _interleave(vectors):
    from evalloom.operators.retrieval import interleaved

    e = vectors.select((F.col("vec_id") % 60).alias("chunk"), (F.col("vec_id") % 4).alias("part"), F.row_number().over(Window.partitionBy(F.col("vec_id") % 4).orderBy("vec_id")).alias("rank"), F.lit(0).alias("q"))
    return interleaved(e, "q").select(F.col("chunk").alias("vec_id"), "part", "pos")


@query("win12_first_reviews", """SELECT user_id, min(CASE WHEN nth = 1 THEN value END) AS first, min(CASE WHEN nth = 2 THEN value END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth <= 2 GROUP BY user_id""")
def first_reviews(spark, d):
    e = R.top_per_key(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 2, "nth")
    return e.groupBy("user_id").agg(F.min(F.when(F.col("nth") == 1, F.col("value"))).alias("first"), F.min(F.when(F.col("nth") == 2, F.col("value"))).alias("second"))


@query("srt03_null_order", duck("usage") + " SELECT id, tier_actual FROM usage ORDER BY tier_actual DESC NULLS LAST, id LIMIT 100")
def null_order(spark, d):
    return table(spark, d, "usage").orderBy(F.desc_nulls_last("tier_actual"), "id").limit(100).select("id", "tier_actual")


@query("srt04_keyset_page", "SELECT event_id, ts FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-15 00:00:00', 500) ORDER BY ts DESC, event_id DESC LIMIT 51")
def keyset(spark, d):
    return R.keyset_page(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 50, before=("2024-01-15 00:00:00", 500))


@query("srt04_keyset_page_back", "SELECT event_id, ts FROM (SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15 00:00:00', 500) ORDER BY ts, event_id LIMIT 51)")
def keyset_back(spark, d):
    return R.keyset_page(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 50, after=("2024-01-15 00:00:00", 500))


@query("srt07_distinct_sorted", "SELECT DISTINCT event_type FROM events ORDER BY 1")
def distinct_sorted(spark, d):
    return table(spark, d, "events").select("event_type").distinct().orderBy("event_type")


@query("srt09_last_turns", duck("messages") + """ SELECT id, conv_id, turn FROM messages WHERE length(trim(content)) > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")
def last_turns(spark, d):
    m = table(spark, d, "messages").filter(F.length(F.trim("content")) > 0)
    return R.top_per_key(m, ["conv_id"], [F.desc("turn")], 6).orderBy("conv_id", "turn").select("id", "conv_id", "turn")


@query("set01_conditional_union", "SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['done', 'final'] ELSE ['open'] END) AS tag FROM orders")
def conditional_union(spark, d):
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("done"), F.lit("final"))).otherwise(F.array(F.lit("open")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(tags).alias("tag"))


@query("set03_set_algebra", """WITH s AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)
SELECT user_id, len(list_intersect(t, ['click', 'view', 'x'])) AS found, 3 - len(list_intersect(t, ['click', 'view', 'x'])) AS missing, len(t) - len(list_intersect(t, ['click', 'view', 'x'])) AS extra FROM s""")
def set_algebra(spark, d):
    want = F.array(F.lit("click"), F.lit("view"), F.lit("x"))
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return s.select("user_id", F.size(F.array_intersect("t", want)).cast("long").alias("found"), F.size(F.array_except(want, F.col("t"))).cast("long").alias("missing"), F.size(F.array_except(F.col("t"), want)).cast("long").alias("extra"))


@query("set04_ordered_dedup", """WITH w AS (SELECT item_id, w, min(i) AS i FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM benchmark) GROUP BY 1, 2)
SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM w GROUP BY 1""")
def ordered_dedup(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(F.split(F.lower("text"), " ")), " ").alias("words"))


@query("strs5_claim_order", """SELECT id, priority FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at FROM orders)
WHERE (status = 'queued' AND created_at <= TIMESTAMP '1997-01-01') OR (status = 'running' AND created_at < TIMESTAMP '1997-01-01' - INTERVAL 5 MINUTE)""")
def claims(spark, d):
    jobs = table(spark, d, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority", "o_orderdate AS created_at", "o_orderdate AS available_at", "o_orderdate AS locked_at")
    return R.claim_order(jobs, "1997-01-01 00:00:00").select("id", "priority")


@query("snk05_upsert", """WITH n AS (SELECT user_id, count(*) AS used FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), o AS (SELECT user_id, count(*) AS used FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE user_id NOT IN (SELECT user_id FROM n)""")
def upsert(spark, d):
    e = table(spark, d, "events")
    count = lambda cond: e.filter(cond).groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))
    path = shared_place(spark)
    snapshots.upsert(count("ts < timestamp_ntz'2024-01-15'"), path, ["user_id"])
    snapshots.upsert(count("ts >= timestamp_ntz'2024-01-15'"), path, ["user_id"])
    return snapshots.read(spark, path)


@query("snk06_insert_missing", """SELECT user_id FROM events WHERE event_type = 'click' GROUP BY 1 UNION SELECT user_id FROM events WHERE event_type = 'view'""")
def insert_missing(spark, d):
    e = table(spark, d, "events")
    of = lambda kind: e.filter(F.col("event_type") == kind).select("user_id").distinct()
    path = shared_place(spark)
    snapshots.insert_missing(of("click"), path, ["user_id"])
    snapshots.insert_missing(of("view"), path, ["user_id"])
    return snapshots.read(spark, path)


@query("snk07_pivot_export", """SELECT l_orderkey, coalesce(CAST(max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS VARCHAR), '') AS "1", coalesce(CAST(max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS VARCHAR), '') AS "2" FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1""")
def pivot(spark, d):
    return R.pivot_export(table(spark, d, "lineitem").filter("l_linenumber <= 2"), "l_orderkey", "l_linenumber", "l_quantity", ["1", "2"])


@query("agg32_json_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def json_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name"))), lambda x: x["n_name"]), ",").alias("nations"))


@query("agg33_better_players", """WITH b AS (SELECT event_type AS game, user_id, max(value) AS best FROM events GROUP BY 1, 2) SELECT game, user_id, best, CAST(rank() OVER (PARTITION BY game ORDER BY best DESC) AS INT) AS place FROM b""")
def better(spark, d):
    b = table(spark, d, "events").groupBy(F.col("event_type").alias("game"), "user_id").agg(F.max("value").alias("best"))
    return b.withColumn("place", F.rank().over(Window.partitionBy("game").orderBy(F.desc("best"))))


@query("agg34_first_visit_union", """SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS visited FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY 1""")
def first_visits(spark, d):
    v = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("o"))
    return v.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "event_type"))), lambda x: x["event_type"]), ",").alias("visited"))


@query("agg36_locations", """SELECT coalesce(r_name, 'Worldwide') AS place, count(DISTINCT n_nationkey) AS countries, CAST(grouping(r_name) AS INT) AS last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)""")
def locations(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    g = n.join(r, n["n_regionkey"] == r["r_regionkey"]).rollup("r_name").agg(F.countDistinct("n_nationkey").alias("countries"), F.grouping("r_name").cast("int").alias("last"))
    return g.select(F.coalesce("r_name", F.lit("Worldwide")).alias("place"), "countries", "last")


@query("agg37_catalogue", "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS departments, string_agg(DISTINCT lang, ',' ORDER BY lang) AS jurisdictions FROM documents")
def catalogue(spark, d):
    return table(spark, d, "documents").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n) for c, n in (("source", "departments"), ("lang", "jurisdictions"))])


@query("dat02_month_bounds", "SELECT event_id, date_trunc('month', ts)::DATE AS month, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS next FROM events")
def month_bounds(spark, d):
    return table(spark, d, "events").select("event_id", F.trunc("ts", "MM").alias("month"), F.add_months(F.trunc("ts", "MM"), 1).alias("next"))
