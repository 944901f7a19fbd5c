"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from evalloom.llm import decontamination, sharding

SPACE_CLASS = r"[\x20\x09-\x0D]"

_CRC = """
    crc_start AS (SELECT list_transform(range(256), lambda i: i::BIGINT) AS c),
    crc_table AS (
        SELECT list_transform(c, lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS tab
        FROM crc_start),
    crcs AS (
        SELECT x, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda h: ('0x' || h)::BIGINT),
            lambda c, b: xor(c // 256, tab[1 + xor(c % 256, b)]), 4294967295::BIGINT), 4294967295) AS crc
        FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents), crc_table)"""

_SIDES = "ceil(sqrt(greatest(n, 1)))::BIGINT"


def op3() -> str:
    """The permutation with the sides of the domain as SQL values."""
    left, right = "(x % a)", "(x // a)"
    stages, prev = [], "start_of"
    for j, (mul, add, mul2) in enumerate(sharding.round_keys()):
        stages.append(f"round{j} AS (SELECT * REPLACE (r AS l, (l + (((r * {mul} + {add}) % {sharding.P1}) * {mul2}) % {sharding.P2}) % {'a' if j % 2 == 0 else 'b'} AS r) FROM {prev})")
        prev = f"round{j}"
    del left, right
    body = ", ".join(stages)
    return f"""
    WITH RECURSIVE {_CRC},
    sizes AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM (SELECT n, {_SIDES} AS a FROM (SELECT count(*) AS n FROM documents))),
    slim AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size, crc AS text_crc32 FROM documents JOIN crcs ON x = coalesce(text, '')),
    numbers AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no FROM slim),
    walk AS (
        SELECT row_no, row_no AS x, 0 AS step, n, a, b FROM numbers, sizes
        UNION ALL
        (WITH start_of AS (SELECT row_no, step, n, a, b, x % a AS l, x // a AS r FROM walk WHERE step = 0 OR x >= n), {body}
        SELECT row_no, r * a + l AS x, step + 1 AS step, n, a, b FROM {prev})),
    placed AS (SELECT row_no, x FROM walk WHERE step > 0 AND x < n)
    SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 40)::INT AS shard, x // 40 AS slot, NULL::INT AS grown_shard
    FROM numbers JOIN placed USING (row_no)"""


OP5 = f"""
    WITH lines AS (
        SELECT doc_id, text, i AS pos, parts[i] AS line,
            translate(regexp_replace(parts[i], '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM (SELECT doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
    common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
        sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
    FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id, text"""



OP2 = r"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS x FROM documents),
    words AS (SELECT rid, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM texts),
    spots AS (SELECT rid, i, w[i:i+4] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
    twice AS (SELECT rid, win FROM spots GROUP BY rid, win HAVING count(*) >= 2),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM spots JOIN twice USING (rid, win), range(5) AS t(k) GROUP BY rid),
    lines AS (SELECT rid, unnest(string_split(x, chr(10))) AS line FROM texts),
    dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
    base AS (
        SELECT rid, doc_id, host, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
            length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
        FROM texts JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN covered USING (rid)),
    failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
    rules AS (SELECT *, base_failed OR 10 * n_symbols > word_chars AS rule_failed FROM failed),
    hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS f FROM rules WHERE host IS NOT NULL GROUP BY host),
    moments AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts),
    prior AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1e12 END AS k FROM moments),
    verdicts AS (SELECT host, n AS host_docs, f AS host_failed, (f + m * k) / (n + k) > 0.5 AS host_rejected FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_rejected, false) AS host_rejected,
        NOT base_failed AND NOT coalesce(host_rejected, false) AS kept
    FROM rules LEFT JOIN verdicts USING (host)"""


def op1(masks=decontamination.MASKS, window=decontamination.WINDOW) -> str:
    """The same search on the tokens themselves instead of their hashes."""
    longest = max(map(len, masks))
    tokens = r"string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', chr(1), 'g'), chr(1))"
    seeds = " UNION ALL ".join(
        f"SELECT $id, $key, i, {k} AS mask, concat_ws(chr(1), {', '.join(f't[i + {j}]' for j, c in enumerate(mask) if c == '1')}) AS seed "
        f"FROM (SELECT *, unnest(range(1, len(t) - {len(mask)} + 2)) AS i FROM $from WHERE len(t) >= $least)"
        for k, mask in enumerate(masks)
    )
    # items shorter than the longest mask: all their tokens, from five on all but one, are a seed
    seeds += f" UNION ALL SELECT $id, $key, i, -(10 * n + z) AS mask, list_aggregate(list_transform(t[i:i + n - 1], lambda w, k: CASE WHEN k = z THEN '' ELSE w END), 'string_agg', chr(1)) AS seed FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM $from, (SELECT n, unnest(CASE WHEN n >= 5 THEN range(1, n + 1) ELSE [0] END) AS z FROM (SELECT DISTINCT len(t) AS n FROM items WHERE len(t) < {longest} AND len(t) > 0)) WHERE len(t) >= n AND $short)"
    of = lambda table, ident, key: seeds.replace("$least", "1" if table == "docs" else str(longest)).replace("$short", "true" if table == "docs" else "len(t) = n").replace("$id", ident).replace("$key", key).replace("$from", table)
    return f"""
    WITH items AS (SELECT item_id, list_filter({tokens}, lambda w: w <> '') AS t FROM benchmark WHERE item_id IS NOT NULL),
    docs AS (SELECT doc_id, coalesce(text, '') AS x, {tokens} AS t FROM documents GROUP BY ALL),
    dseeds AS ({of('docs', 'doc_id', 'x')}), iseeds AS ({of('items', 'item_id', '1 AS one')}),
    hits AS (SELECT DISTINCT d.doc_id, d.x, b.item_id, d.i - b.i AS off FROM dseeds d JOIN iseeds b USING (mask, seed)),
    lined AS (
        SELECT h.doc_id, h.x, h.item_id, h.off, d.t AS dt, b.t AS bt, least(len(b.t), {window}) AS n_compared
        FROM hits h JOIN docs d ON d.x = h.x AND d.doc_id IS NOT DISTINCT FROM h.doc_id JOIN items b USING (item_id)),
    flags AS (SELECT *, list_transform(range(1, len(bt) + 1), lambda i: CASE WHEN off + i >= 1 AND dt[off + i] = bt[i] THEN 1 ELSE 0 END) AS eq FROM lined),
    sums AS (SELECT *, list_max(list_transform(range(1, len(bt) - n_compared + 2), lambda s: list_sum(eq[s:s + n_compared - 1]))) AS n_equal FROM flags),
    good AS (SELECT * FROM sums WHERE n_equal * 1000 >= n_compared * 800)
    SELECT doc_id, item_id, off AS "at", n_compared, n_equal::INT AS n_equal
    FROM good QUALIFY row_number() OVER (PARTITION BY doc_id, x, item_id ORDER BY n_equal DESC, off) = 1"""


OP11 = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.e) = len(b.e)),
    positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other_id)::INT AS rank,
        n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
    QUALIFY rank <= 5"""

ORACLES = {"op1_decontamination": op1(), "op2_quality_rules": OP2, "op3_feistel_sharding": op3(), "op5_line_dedup": OP5, "op11_hard_negatives": OP11}
