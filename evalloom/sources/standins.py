"""Views of the driver tables in the shape of the application's tables, for Spark and for the oracle.

One SQL text with a few dialect words serves both engines, so that a query and
its oracle see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = {
    "spark": {"$K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "$MIN(": "make_dt_interval(0, 0, ", "$T0": "TIMESTAMP_NTZ'2024-01-01 00:00:00'"},
    "duck": {"$K": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "$MIN(": "to_minutes(", "$T0": "TIMESTAMP '2024-01-01 00:00:00'"},
}

_VIEWS = {
    "usage": (
        "events",
        """SELECT event_id AS id, CAST(floor(event_id / 3) AS BIGINT) AS request_id, ts AS created_at, user_id, user_id % 4 AS org_id,
        CASE event_type WHEN 'click' THEN 'route' WHEN 'view' THEN 'embed' WHEN 'signup' THEN 'title' ELSE 'answer' END AS operation,
        CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 19 = 0 THEN 'stopped' ELSE 'ok' END AS status, concat('model-', CAST(event_id % 3 AS STRING)) AS model,
        CASE event_id % 4 WHEN 0 THEN 'flex' WHEN 1 THEN 'standard' END AS tier_actual, CASE event_id % 5 WHEN 0 THEN 'flex' ELSE 'standard' END AS tier_requested,
        $K AS input_tokens, CAST(floor($K / 3) AS BIGINT) AS cached_tokens, (event_id * 7) % 97 AS output_tokens, CASE WHEN event_id % 3 = 0 THEN (event_id * 5) % 61 END AS reasoning_tokens, value AS latency_ms,
        CASE WHEN event_id % 2 = 0 THEN value / 4 END AS ttft_ms, CAST(CAST(event_id % 1000 AS DOUBLE) / 8000 AS DECIMAL(14,8)) AS cost_usd,
        CASE WHEN event_id % 7 = 0 THEN concat('run-', CAST(event_id % 5 AS STRING)) END AS eval_run_id, CASE WHEN event_id % 14 = 0 THEN concat('case-', CAST(event_id % 20 AS STRING)) END AS eval_case_id,
        event_id % 500 AS message_id FROM {events}""",
    ),
    "messages": (
        "conversations",
        """SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text AS content, $T0 + $MIN(CAST(conv_id * 60 + turn * 3 AS INT)) AS created_at,
        CASE WHEN role = 'assistant' THEN CASE (conv_id + turn) % 5 WHEN 0 THEN 1 WHEN 1 THEN -1 END END AS feedback,
        CASE (conv_id * 3 + turn) % 13 WHEN 0 THEN 'stopped' WHEN 1 THEN 'failed' ELSE 'complete' END AS status,
        CASE WHEN role = 'assistant' THEN CAST(conv_id * 17 + turn * 31 AS DOUBLE) END AS total_ms, conv_id % 50 AS user_id, conv_id % 4 AS org_id, conv_id % 11 = 0 AS is_eval,
        CASE WHEN (conv_id + turn) % 9 = 0 THEN $T0 + $MIN(CAST(conv_id AS INT)) END AS bookmarked_at FROM {conversations}""",
    ),
    "docs": (
        "documents",
        """SELECT doc_id, text, lang AS jurisdiction, source AS department, n_chars, doc_id % 5 AS org_id, CASE doc_id % 6 WHEN 0 THEN 'country_supplement' WHEN 1 THEN 'manual' ELSE 'policy' END AS doc_type,
        CASE doc_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 4 <> 0 THEN doc_id END AS indexed_at FROM {documents}""",
    ),
    "outputs": (
        "orders",
        """SELECT o_orderkey AS case_key, CASE o_custkey % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'UK' WHEN 2 THEN 'GLOBAL' END AS expected, CASE o_orderkey % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'UK' WHEN 2 THEN 'GLOBAL' END AS routed, o_orderkey % 11 = 0 AS bypassed,
        concat('An answer of ', CASE o_orderkey % 6 WHEN 0 THEN 'Germany' WHEN 1 THEN 'germanic  tribes' WHEN 2 THEN 'London' ELSE 'nobody' END, '. ', CASE WHEN o_orderkey % 9 = 0 THEN 'CANARY  seven' ELSE 'x' END) AS answer FROM {orders}""",
    ),
    "run_scores": (
        "lineitem",
        """SELECT l_orderkey AS case_key, CASE l_linenumber WHEN 1 THEN 'A' ELSE 'B' END AS run, max(l_discount) AS faithfulness, max(CASE WHEN l_returnflag = 'R' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS hit, max(l_extendedprice) AS latency_ms,
        CASE WHEN l_orderkey % 17 = 0 THEN 'error' ELSE 'done' END AS status, max(l_linestatus) AS type, max(l_returnflag) AS flag, max(l_shipdate) AS finished_at FROM {lineitem} WHERE l_linenumber <= 2 GROUP BY l_orderkey, l_linenumber""",
    ),
}


def _text(name: str, dialect: str) -> str:
    text = _VIEWS[name][1]
    for word, meaning in _WORDS[dialect].items():
        text = text.replace(word, meaning)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view of one in the application's shape."""
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, _ = _VIEWS[name]
    return spark.sql(_text(name, "spark"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def duck(*names: str, recursive: bool = False) -> str:
    """The WITH clause that gives the oracle the same views; further CTEs may follow after a comma."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({_text(n, 'duck').replace('{' + _VIEWS[n][0] + '}', _VIEWS[n][0])})" for n in names)
