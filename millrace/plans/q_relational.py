"""The admitted analytical SQL surface, one query for each construct.

Every query is written once, in PostgreSQL's dialect. Spark runs it through the translator;
DuckDB runs the text itself as the oracle, except where ``ORACLE`` gives another wording of what its
dialect lacks.
"""

from __future__ import annotations

from .tables import postgres

SQL = {
    # Scan, filter, project
    "scan_filter_project": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue
FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount >= 0.05 AND l_returnflag <> 'N'""",
    # R14, R17, R18
    "predicate_mix": """
SELECT c_custkey, c_name, c_mktsegment FROM customer
WHERE (c_name LIKE '%1_' OR c_name ILIKE 'customer%9') AND c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  AND c_acctbal IS NOT NULL AND NULLIF(c_nationkey, 3) IS DISTINCT FROM 4""",
    # R22, R23
    "case_coalesce": """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size,
       COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS status, GREATEST(o_totalprice, 50000.0) AS at_least, LEAST(o_orderkey, o_custkey) AS low
FROM orders""",
    # Casts, arithmetic, strings
    "cast_math": """
SELECT p_partkey, p_size::BIGINT * 3 - 1 AS grown, CAST(floor(p_retailprice) AS INTEGER) % 7 AS rest, p_brand || '/' || p_type AS label, -p_size AS minus,
       'it''s' AS quoted, abs(p_size - 25) AS off /* a comment 'with' quotes */
FROM part -- and one more""",
    # R11
    "distinct_pairs": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    # R12, R74
    "distinct_on_latest_order": """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey""",
    # R15, R16, R19
    "regex_similar_like_any": """
SELECT p_partkey, p_brand, p_type FROM part
WHERE p_brand ~ '[0-4]$' AND p_type !~* 'tin' AND p_brand SIMILAR TO 'Brand#(1|2|3)%' AND p_size = ANY (SELECT p_size FROM part WHERE p_size > 5)""",
    "quantified_all": """
SELECT c_custkey, c_acctbal FROM customer
WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey < 3) AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""",
    # R27, R28, R29
    "json_extract_agg": """
SELECT event_type, count(*) AS n, sum((props ->> 'k')::BIGINT) AS total, max((props ->> 'k')::BIGINT) AS top FROM events
WHERE (props ->> 'k') IS NOT NULL GROUP BY event_type""",
    "json_contains": """
SELECT event_id FROM events WHERE props @> '{"k": 7}' AND props ? 'k'""",
    # R25, R29
    "array_ops": """
SELECT o_orderkey, ARRAY[o_orderstatus, o_orderpriority] @> ARRAY['O'] AS open, ARRAY[1, 2] && ARRAY[length(o_orderstatus), 5] AS one
FROM orders""",
    "array_subquery": """
SELECT r_name, cardinality(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)) AS nations FROM region""",
    # R02, R03, R26
    "values_row_series": """
SELECT v.a, v.b, s.n FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b) JOIN generate_series(1, 5) AS s(n) ON s.n > v.a
WHERE ROW(v.a, s.n) <> ROW(2, 4)""",
    "unnest_ordinality": """
SELECT e.vec_id, u.n, u.x FROM embeddings e, unnest(e.embedding) WITH ORDINALITY AS u(x, n)""",
    # R24, R46, R47
    "semi_exists": """
SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)""",
    "anti_not_exists": """
SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
    "not_in_null_safe": """
SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(c_nationkey, 3) FROM customer WHERE c_nationkey <> 3 AND c_acctbal > 5000)""",
    "scalar_correlated": """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer WHERE c_acctbal > 9000""",
    # R40 - R45
    "join_inner_star": """
SELECT r_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY r_name, c_mktsegment""",
    "join_left_zero_count": """
SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "join_full_coalesce": """
SELECT COALESCE(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c
FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k""",
    "join_right": """
SELECT n_name, r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_name LIKE 'A%'""",
    "join_cross_small": "SELECT r_name, v.x FROM region CROSS JOIN (VALUES (1), (2)) AS v(x)",
    "join_using": """
SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY 1) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)""",
    "join_theta_range": """
SELECT b.name, count(*) AS n FROM orders JOIN (VALUES ('low', 0, 100000), ('mid', 100000, 200000), ('high', 200000, 100000000)) AS b(name, lo, hi)
ON o_totalprice >= b.lo AND o_totalprice < b.hi GROUP BY b.name""",
    "join_lateral_top": """
SELECT n_name, t.s_suppkey, t.s_acctbal FROM nation, LATERAL (
  SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) AS t""",
    # R48, R92
    "hierarchy_closure_recursive": """
WITH RECURSIVE edge(child, parent) AS (
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region
), closure(ancestor, descendant, depth) AS (
  SELECT child, child, 0 FROM edge UNION ALL SELECT e.parent, c.descendant, c.depth + 1 FROM closure c JOIN edge e ON e.child = c.ancestor
) SELECT ancestor, descendant, depth FROM closure""",
    # R49
    "composite_key_join": """
SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a
JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
GROUP BY a.l_orderkey, a.l_linenumber""",
    "conditional_polymorphic_join": """
SELECT x.kind, x.id, COALESCE(c.c_name, s.s_name) AS name
FROM (VALUES ('customer', 1), ('supplier', 1), ('customer', 5), ('supplier', 3)) AS x(kind, id)
LEFT JOIN customer c ON x.kind = 'customer' AND c.c_custkey = x.id LEFT JOIN supplier s ON x.kind = 'supplier' AND s.s_suppkey = x.id""",
    # R50 - R61
    "group_having": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS mean
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    "rollup_region": """
SELECT r_name, n_name, count(*) AS n, GROUPING(n_name) AS g FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)""",
    "cube_flags": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""",
    "filter_percentage": """
SELECT c_mktsegment, round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / NULLIF(count(*), 0), 4) AS pct FROM customer GROUP BY c_mktsegment""",
    "filter_over": """
SELECT o_orderkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') OVER (PARTITION BY o_custkey) AS open_total FROM orders""",
    "avg_of_counts": """
SELECT round(avg(n), 6) AS mean FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) t""",
    "count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "agg_stats": """
SELECT l_returnflag, round(var_pop(l_quantity), 4) AS vp, round(var_samp(l_quantity), 4) AS vs, round(stddev_pop(l_quantity), 6) AS sp,
       round(stddev_samp(l_quantity), 6) AS ss FROM lineitem GROUP BY l_returnflag""",
    "agg_regression": """
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs,
       round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept FROM lineitem GROUP BY l_returnflag""",
    "agg_percentiles": """
SELECT o_orderpriority, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS median,
       percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM orders GROUP BY o_orderpriority""",
    "string_agg_sorted": """
SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name DESC) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
    "bool_aggs": """
SELECT l_returnflag, bool_and(l_quantity > 0) AS positive, bool_or(l_discount > 0.09) AS deep FROM lineitem GROUP BY l_returnflag""",
    # R70 - R73
    "win_rank": """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders""",
    "win_lag_lead": """
SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events""",
    "win_rows_frame": """
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders""",
    "win_range_frame": """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '100' HOUR PRECEDING AND CURRENT ROW) AS n FROM events""",
    "win_named": """
SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "win_groups_frame": """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders""",
    # R80 - R82
    "topk_nulls": """
SELECT k, n FROM (SELECT NULLIF(o_orderpriority, '5-LOW') AS k, count(*) AS n FROM orders GROUP BY 1) t ORDER BY k DESC LIMIT 3""",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "fetch_with_ties": "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 5 ROWS WITH TIES",
    # R90, R91
    "set_union_all": """
SELECT c_nationkey AS k, 'c' AS src FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 's' FROM supplier WHERE s_acctbal > 5000""",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte_chain": """
WITH big(custkey, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY 1), top AS (SELECT custkey FROM big WHERE total > 1000000)
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT custkey FROM top) GROUP BY c_mktsegment""",
    "set_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    # What the queries above leave out
    "like_escape": r"SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand!_%' ESCAPE '!' AND p_brand LIKE 'Brand!#1%' ESCAPE '!'",
    "tilde_operators": "SELECT p_partkey FROM part WHERE p_brand ~~ 'Brand#1%' AND p_type !~~ '%TIN' AND p_type ~~* '%a%' AND p_type !~~* '%zz%'",
    "json_paths": """
SELECT event_id, props -> 'k' ->> 'none' AS deep, props #>> '{k}' AS k, (props #> '{k}')::TEXT AS k2 FROM events WHERE event_id % 7 = 0""",
    "json_any_all_keys": "SELECT event_id FROM events WHERE props ?| ARRAY['x', 'k'] AND NOT props ?& ARRAY['k', 'x'] AND event_id % 5 = 0",
    "json_path_exists": "SELECT event_id FROM events WHERE props @? '$.k' AND NOT props @? '$.other' AND event_id % 3 = 0",
    "agg_arrays": """
SELECT n_regionkey, cardinality(array_agg(n_name ORDER BY n_name)) AS n, (array_agg(n_name ORDER BY n_name))[1] AS first FROM nation GROUP BY n_regionkey""",
    "agg_json": "SELECT r_regionkey, json_array_length(json_agg(n_name)::TEXT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey",
    "agg_mode": "SELECT l_linestatus, mode() WITHIN GROUP (ORDER BY l_returnflag) AS flag FROM lineitem GROUP BY l_linestatus",
    # dates
    "date_rolling_vs_calendar": """
SELECT count(*) FILTER (WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01') AS calendar,
       count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1996-06-30' - INTERVAL '365' DAY AND o_orderdate <= TIMESTAMP '1996-06-30') AS rolling FROM orders""",
    "date_trunc_month": "SELECT to_char(date_trunc('month', o_orderdate), 'YYYY-MM') AS month, count(*) AS n FROM orders GROUP BY 1",
    "duration_epoch": """
SELECT round(avg(EXTRACT(EPOCH FROM (l_shipdate - o_orderdate))), 2) AS seconds FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    "date_diff_days": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE - o_orderdate::DATE AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
}

ORACLE = {
    "json_contains": "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7",
    "array_ops": """
SELECT o_orderkey, list_has_all([o_orderstatus, o_orderpriority], ['O']) AS open, list_has_any([1, 2], [length(o_orderstatus)::INTEGER, 5]) AS one
FROM orders""",
    "array_subquery": "SELECT r_name, count(n_name) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name",
    "values_row_series": """
SELECT v.a, v.b, s.n FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b) JOIN generate_series(1, 5) AS s(n) ON s.n > v.a WHERE NOT (v.a = 2 AND s.n = 4)""",
    "unnest_ordinality": """
SELECT vec_id, n, embedding[n] AS x FROM embeddings, range(1, 65) AS t(n)""",
    "regex_similar_like_any": """
SELECT p_partkey, p_brand, p_type FROM part
WHERE regexp_matches(p_brand, '[0-4]$') AND NOT regexp_matches(p_type, '(?i)tin') AND regexp_matches(p_brand, '^Brand#[123]') AND p_size > 5""",
    "tilde_operators": "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' AND p_type NOT LIKE '%TIN' AND p_type ILIKE '%a%' AND p_type NOT ILIKE '%zz%'",
    "json_paths": "SELECT event_id, NULL::VARCHAR AS deep, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS k2 FROM events WHERE event_id % 7 = 0",
    "json_any_all_keys": "SELECT event_id FROM events WHERE list_has_any(json_keys(props), ['x', 'k']) AND NOT list_has_all(json_keys(props), ['k', 'x']) AND event_id % 5 = 0",
    "json_path_exists": "SELECT event_id FROM events WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.other') AND event_id % 3 = 0",
    "agg_arrays": "SELECT n_regionkey, count(*) AS n, min(n_name) AS first FROM nation GROUP BY n_regionkey",
    "agg_json": "SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1",
    "fetch_with_ties": "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 5",
    "date_trunc_month": "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
    "topk_nulls": """
SELECT k, n FROM (SELECT NULLIF(o_orderpriority, '5-LOW') AS k, count(*) AS n FROM orders GROUP BY 1) t ORDER BY k DESC NULLS FIRST LIMIT 3""",
    "quantified_all": """
SELECT c_custkey, c_acctbal FROM customer WHERE coalesce(c_acctbal > (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey < 3), true)
AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""",
}

QUERIES = {name: postgres(sql) for name, sql in SQL.items()}
ORACLE_SQL = {name: ORACLE.get(name, sql) for name, sql in SQL.items()}
