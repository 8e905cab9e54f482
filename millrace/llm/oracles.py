"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from .sharding import MULTIPLIER

#: The jump walk of every key as a recursive query in 128-bit arithmetic; CRC-32 byte by byte over a table made by its rule.
JUMP_SHARDING = f"""
WITH RECURSIVE w AS (
  SELECT rid, 0::BIGINT AS hop, 0::BIGINT AS was, 0::BIGINT AS nxt, CASE WHEN k < 0 THEN k + 18446744073709551616::HUGEINT ELSE k END AS k
  FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rid, coalesce(doc_id, 0)::HUGEINT AS k FROM documents)
  UNION ALL
  SELECT rid, nxt, CASE WHEN nxt < 40 THEN nxt ELSE was END,
         floor((nxt + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592::HUGEINT)::DOUBLE + 1.0::DOUBLE)))::BIGINT, k2
  FROM (SELECT *, ((k * {MULTIPLIER}::HUGEINT) % 18446744073709551616::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM w WHERE nxt <= 40)
),
j AS (SELECT rid, max(was) AS shard, max(hop) AS grown_shard FROM w GROUP BY rid),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
  lambda c, n: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rid, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, rid, size, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32 FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM d JOIN j USING (rid)"""

_FOUND = "SELECT doc_id, {k} AS k, regexp_extract_all(t, '{p}', {g}) AS tested, regexp_extract_all(t, '{p}', 0) AS ms, string_split_regex(t, '{p}') AS gs, {n} AS n FROM d"
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SPANS = " UNION ALL ".join(
    _FOUND.format(k=k, p=p, g=g, n=n)
    for k, p, g, n in (
        (0, _ASSIGN, 2, 6), (1, "AKIA[A-Z0-9]{16,}", 0, 20), (2, "[0-9a-f]{24,}", 0, 24), (3, "[0-9A-Za-z]{16,}", 0, 16), (4, "[A-Za-z0-9+/_-]{20,}", 0, 20),
    )
)

#: Matches are placed by the lengths of what lies between them; every window's entropy is computed anew.
SECRET_SCAN = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_SPANS}),
u AS (SELECT doc_id, k, n, ms[i] AS m, tested[i] AS g,
        list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f WHERE len(ms) > 0)),
base AS (SELECT doc_id, k, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM u WHERE k <= 2 AND length(g) >= n),
runs AS (SELECT doc_id, k, n AS w, CASE k WHEN 3 THEN 2.8 ELSE 3.7 END::DOUBLE AS h, CASE WHEN x THEN substr(m, 3) ELSE m END AS m, s::BIGINT + CASE WHEN x THEN 2 ELSE 0 END AS s
  FROM (SELECT *, k = 3 AND regexp_full_match(m, '0[xX][0-9A-Fa-f]{16,}') AS x FROM u WHERE k > 2)),
cand AS (SELECT * FROM runs WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND (k = 4 OR regexp_full_match(m, '[0-9A-Fa-f]+'))),
wide AS (SELECT doc_id, k, s + min(i) AS s, s + max(i) + w AS e, substr(m, (min(i) + 1)::BIGINT, (max(i) - min(i) + w)::BIGINT) AS m FROM (
    SELECT *, unnest(list_filter(range(0, length(m) - w + 1), lambda i: list_aggregate(string_split(substr(m, (i + 1)::BIGINT, w), ''), 'entropy') >= h)) AS i FROM cand)
  GROUP BY doc_id, k, s, m, w),
ent AS (SELECT doc_id, k, s, e FROM wide
  WHERE NOT regexp_matches(m, '(?i:example|placeholder|changeme|dummy|your[-_]?(key|token|secret))|(?i:0123456789|1234567890|abcdefghij|deadbeef)')
  AND NOT len(list_filter(range(1, length(m) - 6), lambda i: len(list_distinct(string_split(substr(m, i::BIGINT, 8), ''))) = 1)) > 0),
every AS (SELECT *, 1 AS b FROM base UNION ALL SELECT *, 0 FROM ent),
l AS (SELECT doc_id, b, s, k, ['assign', 'access', 'hex', 'entropy_hex', 'entropy_base64'][k + 1] || ':' || s || ':' || e AS x FROM every),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
  string_agg(x, ',' ORDER BY s, k) FILTER (WHERE b = 1) AS bs, string_agg(x, ',' ORDER BY s, k) AS sp FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""
