"""Text, document-processing, pricing and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import config, pricing, stemmer
from evalloom.functions import text as T
from evalloom.operators import documents as D
from evalloom.plans.registry import query
from evalloom.sources.session import python_ready
from evalloom.sources.standins import duck, table


@query("str02_compound_tokens", r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[''’‘`]', '', 'g'), '[a-z0-9]+(?:[.\-/][a-z0-9]+)*')) AS w FROM documents),
p AS (SELECT doc_id, w, string_split_regex(w, '[.\-/]') AS p FROM x), a AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN list_concat([w], p) ELSE p END AS l, len(p) AS n FROM p),
e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i, n FROM a)
SELECT doc_id, count(*) AS n, count(DISTINCT t) AS d FROM e WHERE (n > 1 AND i = 1) OR (t NOT IN ($STOP) AND (length(t) > 1 OR regexp_matches(t, '[0-9]'))) GROUP BY doc_id""".replace("$STOP", ", ".join(f"'{w}'" for w in T.STOPWORDS)))
def compound(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.compound_tokens(F.col("text"))).alias("t"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("d"))


@query("str04_stemmed_terms")
def stems(spark, d):
    """Stem of each distinct term; tests hold the stemmer to published examples."""
    python_ready(spark)
    terms = table(spark, d, "documents").select(F.explode(T.simple_tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", stemmer.stemmed(F.col("term")).alias("stem"))


@query("str01_nfkc")
def nfkc(spark, d):
    python_ready(spark)
    return table(spark, d, "documents").select("doc_id", F.md5(T.nfkc(F.col("text"))).alias("h"))


@query("str05_doc_codes", r"""SELECT n_nationkey AS k, array_to_string(list_concat(
CASE WHEN n_nationkey % 30 BETWEEN 1 AND 20 THEN list_transform(range(98, 98 + n_nationkey % 30 + 1), lambda i: 'SIM-IT-' || lpad(CAST(i AS VARCHAR), greatest(2, length(CAST(i AS VARCHAR)))::INT, '0')) ELSE ['SIM-IT-98', 'SIM-IT-' || CAST(98 + n_nationkey % 30 AS VARCHAR)][1:CASE WHEN n_nationkey % 30 = 0 THEN 1 ELSE 2 END] END,
[upper(substr(n_name, 1, 3)) || '-HR-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')]), ',') AS codes FROM nation""")
def codes(spark, d):
    t = table(spark, d, "nation").selectExpr("n_nationkey AS k", "concat('From SIM-IT-98 to SIM-IT-', 98 + n_nationkey % 30, ' and ', upper(substr(n_name, 1, 3)), '-HR-', lpad(n_nationkey, 3, '0'), ', SIM-IT-98') AS t")
    return t.select("k", F.array_join(T.doc_codes(F.col("t")), ",").alias("codes"))


@query("str05_code_range", "SELECT n_nationkey AS k, array_to_string(list_transform(range(101, 101 + n_nationkey % 5 + 1), lambda i: 'X-' || lpad(CAST(i AS VARCHAR), 3, '0')), ',') AS codes FROM nation")
def code_range(spark, d):
    n = table(spark, d, "nation").selectExpr("n_nationkey AS k", "'101' AS a", "cast(101 + n_nationkey % 5 as string) AS b")
    return n.select("k", F.array_join(T.code_range(F.lit("X-"), F.col("a"), F.col("b")), ",").alias("codes"))


@query("str06_month_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate::DATE END AS d FROM orders")
def month_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "Smarch 40, 1999").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("t"))
    return o.select("o_orderkey", T.month_date(F.col("t")).alias("d"))


@query("str09_sentences", r"""SELECT doc_id, len(regexp_extract_all(text, '[.!?;]\s+[A-Z0-9("“]')) + 1 AS n FROM documents""")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("str13_markers", "SELECT o_orderkey, array_to_string(list_distinct_ordered, ',') AS m FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 2 THEN ['2', '7'] ELSE [CAST(o_custkey % 5 AS VARCHAR), '2', '7'] END AS list_distinct_ordered FROM orders)")
def markers(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey", "concat('a [', o_custkey % 5, ', 2] b [7] [2]') AS t")
    return o.select("o_orderkey", F.array_join(F.transform(T.markers(F.col("t")), lambda x: x.cast("string")), ",").alias("m"))


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("str14_snippet", rf"SELECT doc_id, CASE WHEN length({_FLAT}) <= 280 THEN {_FLAT} ELSE regexp_replace(substr({_FLAT}, 1, 280), '\s+\S*$', '') || '…' END AS snippet FROM documents")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("str16_short_title", duck("messages") + r""" SELECT id, regexp_replace(array_to_string(string_split(trim(regexp_replace(regexp_replace(content, '["''`]', '', 'g'), '\s+', ' ', 'g')), ' ')[1:6], ' '), '[.:;,]+$', '') AS title FROM messages""")
def title(spark, d):
    return table(spark, d, "messages").select("id", T.short_title(F.col("content")).alias("title"))


@query("str17_jurisdiction", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'GB' WHEN lang = 'fr' THEN 'GLOBAL' WHEN lang = 'de' THEN 'DE' END AS j FROM documents")
def jurisdiction(spark, d):
    raw = F.when(F.col("lang") == "en", " uk").when(F.col("lang") == "fr", "Worldwide").when(F.col("lang") == "de", "de").otherwise("Spain")
    return table(spark, d, "documents").select("doc_id", T.jurisdiction(raw).alias("j"))


@query("str18_route_template", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/v1/orgs/{org_id}/chat/' || CAST(user_id + 1 AS VARCHAR) ELSE '/v1/docs/{doc_id}/' || CAST(event_id AS VARCHAR) END AS route FROM events")
def route(spark, d):
    path = F.when(F.col("event_id") % 2 == 0, F.concat_ws("/", F.lit("/v1/orgs"), "user_id", F.lit("chat"), F.col("user_id") + 1)).otherwise(F.concat(F.lit("/v1/docs/d-7/"), F.col("event_id")))
    params = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("org_id"), F.col("user_id").cast("string"))).otherwise(F.create_map(F.lit("doc_id"), F.lit("d-7")))
    return table(spark, d, "events").select("event_id", T.route_template(path, params).alias("route"))


@query("str20_condensed_events", """WITH g AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM (SELECT user_id, event_type, island, event_id FROM g) GROUP BY user_id, event_type, island""")
def condensed(spark, d):
    from pyspark.sql.window import Window

    w = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    e = table(spark, d, "events").withColumn("island", w("user_id") - w("user_id", "event_type"))
    return e.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n")).drop("island")


@query("str21_phrase", r"SELECT doc_id, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'of the') AS has FROM documents")
def phrase(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contains_phrase(F.col("text"), F.lit("Of  THE ")).alias("has"))


@query("str22_country", "SELECT doc_id, regexp_matches(' ' || lower(text) || ' ', '[^a-z]than[^a-z]') AS named FROM documents")
def country(spark, d):
    return table(spark, d, "documents").select("doc_id", T.names_country(F.col("text"), "Than").alias("named"))


@query("arr01_common_prefix", """WITH w AS (SELECT p_brand, string_split(p_type || '/' || replace(p_name, ' ', '/'), '/') AS w FROM part), n AS (SELECT p_brand, unnest(range(1, min(len(w)) + 1)) AS i FROM w GROUP BY 1),
s AS (SELECT p_brand, i, count(DISTINCT array_to_string(w[1:i], '/')) AS d, min(array_to_string(w[1:i], '/')) AS p FROM n JOIN w USING (p_brand) GROUP BY 1, 2) SELECT p_brand, coalesce(arg_max(p, i) FILTER (WHERE d = 1), '') AS p FROM s GROUP BY 1""")
def prefix(spark, d):
    """What the paths of all parts of a brand begin with."""
    path = F.split(F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit("/"))), "/")
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(path).alias("paths"))  # the kinds and names of a brand are few
    return rows.select("p_brand", F.array_join(T.common_prefix(F.col("paths")), "/").alias("p"))


_BOOK = [("model-0", "standard", 2.5, 0.25, 10.0), ("model-0", "flex", 1.25, 0.125, 5.0), ("model-1", "standard", 0.4, 0.1, 1.6)]


@query("mth04_pricing", duck("usage") + """, b AS (SELECT * FROM (VALUES ('model-0', 'standard', 2.5, 0.25, 10.0), ('model-0', 'flex', 1.25, 0.125, 5.0), ('model-1', 'standard', 0.4, 0.1, 1.6)) v(model, tier, i, c, o)),
r AS (SELECT u.id, input_tokens - least(cached_tokens, input_tokens) AS fresh, least(cached_tokens, input_tokens) AS hit, output_tokens, coalesce(x.i, s.i, 0)::DOUBLE AS i, coalesce(x.c, s.c, 0)::DOUBLE AS c, coalesce(x.o, s.o, 0)::DOUBLE AS o, x.model IS NULL AS estimated
FROM usage u LEFT JOIN b x ON x.model = u.model AND x.tier = coalesce(u.tier_actual, 'standard') LEFT JOIN b s ON s.model = u.model AND s.tier = 'standard')
SELECT id, floor((fresh * i + hit * c + output_tokens * o) * 100 + 0.5) / 1e8 AS cost, estimated FROM r""")
def priced(spark, d):
    book = spark.createDataFrame(_BOOK, "model string, tier string, input double, cached double, output double")
    calls = table(spark, d, "usage").select("id", "model", F.col("tier_actual").alias("tier"), "input_tokens", "cached_tokens", "output_tokens")
    return pricing.priced(calls, book).select("id", F.col("cost").cast("double").alias("cost"), "estimated")


@query("mth05_longest_prefix", duck("usage") + ", m AS (SELECT * FROM (VALUES ('model'), ('model-1'), ('other')) v(known)) SELECT id, known FROM usage JOIN m ON starts_with(model, known) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(known) DESC) = 1")
def longest(spark, d):
    models = spark.createDataFrame([("model",), ("model-1",), ("other",)], "model string")
    return pricing.longest_prefix(table(spark, d, "usage").select("id", "model"), models).select("id", "known")


@query("map02_config_diff")
def config_diff(spark, d):
    python_ready(spark)
    e = table(spark, d, "events").selectExpr("event_id", "concat('{\"a\": {\"k\": ', get_json_object(props, '$.k'), ', \"m\": ', event_id % 3, '}, \"v\": [1, 2]}') AS cfg")
    pairs = e.alias("x").join(e.alias("y"), F.col("y.event_id") == F.col("x.event_id") + 1)
    return pairs.select(F.col("x.event_id").alias("event_id"), F.array_join(config.differing(config.flat_config("x.cfg"), config.flat_config("y.cfg")), ",").alias("changed"))


@query("jsn01_canonical_hash")
def canonical(spark, d):
    python_ready(spark)
    return table(spark, d, "events").select("event_id", F.sha2(config.canonical_json("props"), 256).alias("h"))


@query("doc04_html_blocks")
def html_blocks(spark, d):
    return D.html_blocks(table(spark, d, "pages"), "page_id", "html")


_BLOCKS = r"""blocks AS (SELECT doc_id, i AS pos, line AS text, length(line) <= 30 AND regexp_matches(line, '^\p{Lu}') AS heading FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents) WHERE length(trim(line)) > 0)"""


@query("doc08_outline", f"WITH {_BLOCKS} SELECT doc_id, pos, CASE WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM blocks")
def outline(spark, d):
    return D.outline(D.text_blocks(table(spark, d, "documents"), "doc_id", "text"), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", "section")


@query("doc14_chunks")
def chunks(spark, d):
    """Section-aware chunks of every document, without a shuffle; tests hold the rules to fixed chunks and to plain Python."""
    return D.chunks(D.text_blocks(table(spark, d, "documents"), "doc_id", "text"), "doc_id", in_order=True)


@query("doc12_token_counts", r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]')), 0) AS n FROM documents")
def token_counts(spark, d):
    return token_counts_all(spark, d)


@query("doc12_token_counts_all")
def token_counts_all(spark, d):
    return table(spark, d, "documents").select("doc_id", D.token_count(F.col("text")).cast("long").alias("n"))


@query("doc17_duplicate_uploads", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) > 1")
def uploads(spark, d):
    from pyspark.sql.window import Window

    nth = F.row_number().over(Window.partitionBy("source", F.sha2("text", 256)).orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", nth.alias("nth")).filter("nth > 1").select("doc_id")


@query("doc18_hashed_embeddings")
def embeddings(spark, d):
    return D.hashing_embedder(table(spark, d, "benchmark"), "item_id", "text")


@query("src05_upload_check", "SELECT doc_id, sha256(text) AS digest, octet_length(encode(text)) AS size, octet_length(encode(text)) <= 20000 AS accepted FROM documents")
def upload(spark, d):
    size = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), size.alias("size"), (size <= 20000).alias("accepted"))
