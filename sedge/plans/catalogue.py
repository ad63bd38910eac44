"""The queries over the test tables, each through the SQL front end, with the DuckDB SQL of the same result.

An entry is (name, dialect SQL, DuckDB SQL); None where DuckDB reads the dialect's text as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sedge.sql.connection import Connection

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FLAGSHIP = """
    SELECT r.r_name, n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n_lines
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
    GROUP BY r.r_name, n.n_name"""

#: Rows with text of either case, NULLs and duplicates, written out so that both engines see the same.
MIXED = "WITH m(id, a, b) AS (VALUES (1, 'a', 1), (2, 'A', 2), (3, 'b', NULL), (4, NULL, 3), (5, 'B ', 2))"

ENTRIES: list[tuple[str, str, str | None]] = [
    ("revenue_by_nation", FLAGSHIP, None),
    ("scan_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 49", None),
    ("one_row_source", "SELECT 1 AS a, 'x' AS b, 2.5 AS c", "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, CAST(2.5 AS DOUBLE) AS c"),
    ("filter_3vl", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 1000 OR NULL) OR o_orderkey % 7 = 0 AND NOT (o_custkey = NULL)",
     "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 1000 OR NULL) OR o_orderkey % 7 = 0 AND NOT (o_custkey = NULL)"),
    ("between_in_case", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'mid' ELSE 'big' END AS bucket, p_size NOT BETWEEN 5 AND 40 AS outlying, p_size IN () AS never FROM part",
     "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IN (11, 12, 13) THEN 'mid' ELSE 'big' END AS bucket, CAST(p_size NOT BETWEEN 5 AND 40 AS BIGINT) AS outlying, CAST(0 AS BIGINT) AS never FROM part"),
    ("like_escape_glob", "SELECT p_partkey, p_name LIKE '%A%' AS has_a, p_brand GLOB 'Brand#[1-3]?' AS g, p_type LIKE '%!_%' ESCAPE '!' AS e FROM part",
     "SELECT p_partkey, CAST(p_name ILIKE '%A%' AS BIGINT) AS has_a, CAST(regexp_full_match(p_brand, 'Brand#[1-3].') AS BIGINT) AS g, CAST(p_type LIKE '%!_%' ESCAPE '!' AS BIGINT) AS e FROM part"),
    ("collate_nocase_group", MIXED + " SELECT min(id) AS first_id, count(*) AS n FROM m GROUP BY a COLLATE NOCASE", MIXED + " SELECT CAST(min(id) AS BIGINT) AS first_id, count(*) AS n FROM m GROUP BY lower(a)"),
    ("collate_rtrim_compare", MIXED + " SELECT id, a = 'B' COLLATE RTRIM AS eq FROM m", MIXED + " SELECT CAST(id AS BIGINT) AS id, CAST(rtrim(a) = 'B' AS BIGINT) AS eq FROM m"),
    ("column_label_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS dbl FROM orders WHERE dbl > 600000", "SELECT o_orderkey AS k, o_totalprice * 2 AS dbl FROM orders WHERE o_totalprice * 2 > 600000"),
    ("is_distinct", MIXED + " SELECT id, b IS NULL AS n, b IS NOT 2 AS d, b IS DISTINCT FROM 2 AS e, a ISNULL AS f, b IS TRUE AS t FROM m",
     MIXED + " SELECT CAST(id AS BIGINT) AS id, CAST(b IS NULL AS BIGINT) AS n, CAST(b IS DISTINCT FROM 2 AS BIGINT) AS d, CAST(b IS DISTINCT FROM 2 AS BIGINT) AS e, CAST(a IS NULL AS BIGINT) AS f, CAST(coalesce(b <> 0, false) AS BIGINT) AS t FROM m"),
    ("join_inner", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'", None),
    ("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    ("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY c_custkey", None),
    ("join_right", "SELECT o_orderkey, c_name FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal < 0", None),
    ("join_full", "WITH a(x, y) AS (VALUES (1, 'p'), (2, 'q'), (NULL, 'r')), b(x, z) AS (VALUES (2, 's'), (3, 't'), (NULL, 'u')) SELECT a.x AS ax, y, b.x AS bx, z FROM a FULL JOIN b ON a.x = b.x",
     "WITH a(x, y) AS (VALUES (1, 'p'), (2, 'q'), (NULL, 'r')), b(x, z) AS (VALUES (2, 's'), (3, 't'), (NULL, 'u')) SELECT CAST(a.x AS BIGINT) AS ax, y, CAST(b.x AS BIGINT) AS bx, z FROM a FULL JOIN b ON a.x = b.x"),
    ("join_full_using", "WITH a(k, y) AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15), b(k, z) AS (SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey > 10) SELECT k, y, z FROM a FULL JOIN b USING (k)", None),
    ("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier) b", None),
    ("join_natural_left", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 1) b", None),
    ("join_cross_theta", "SELECT a.n_name AS x, b.r_name AS y FROM nation a CROSS JOIN region b WHERE a.n_regionkey < b.r_regionkey", None),
    ("join_theta_on", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", None),
    ("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    ("join_forward_on", "SELECT n_name, r_name, s_suppkey FROM nation JOIN region ON r_regionkey = n_regionkey AND s_nationkey = n_nationkey JOIN supplier ON s_acctbal > 0",
     "SELECT n_name, r_name, s_suppkey FROM nation, region, supplier WHERE r_regionkey = n_regionkey AND s_nationkey = n_nationkey AND s_acctbal > 0"),
    ("join_group_parens", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA') ON c_nationkey = n_nationkey", None),
    ("join_star_using", "SELECT a.* FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)", None),
    ("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)", None),
    ("semi_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)", None),
    ("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    ("not_in_null_aware", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey NOT IN (SELECT NULL FROM region WHERE r_regionkey < 0)",
     "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name ILIKE 'A%')"),
    ("in_subquery_value", "SELECT n_nationkey, n_regionkey IN (SELECT CASE WHEN r_regionkey = 1 THEN NULL ELSE r_regionkey END FROM region WHERE r_regionkey < 3) AS v FROM nation",
     "SELECT n_nationkey, CAST(CASE WHEN n_regionkey IN (0, 2) THEN 1 END AS BIGINT) AS v FROM nation"),
    ("scalar_subquery_first_row", "SELECT r_name, (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_nationkey DESC LIMIT 1) AS last_nation FROM region",
     "SELECT r_name, (SELECT arg_max(n_name, n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS last_nation FROM region"),
    ("correlated_agg", "SELECT c_custkey, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer", None),
    ("correlated_theta", "SELECT n_nationkey, (SELECT count(*) FROM nation m WHERE m.n_nationkey < n.n_nationkey) AS below FROM nation n", None),
    ("row_value_lt", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_name) < (2, 'NATION_2')", "SELECT n_nationkey FROM nation WHERE n_regionkey < 2 OR n_regionkey = 2 AND n_name < 'NATION_2'"),
    ("row_value_null", MIXED + " SELECT id, (a, b) = ('a', NULL) AS eq, (b, a) < (2, NULL) AS lt, (a, b) IS (NULL, 3) AS same FROM m",
     MIXED + " SELECT CAST(id AS BIGINT) AS id, CAST((a = 'a') AND NULL AS BIGINT) AS eq, CAST(CASE WHEN b IS NULL THEN NULL WHEN b <> 2 THEN b < 2 END AS BIGINT) AS lt, CAST(a IS NULL AND b IS NOT DISTINCT FROM 3 AS BIGINT) AS same FROM m"),
    ("row_value_in", "SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey % 2) IN (SELECT n_nationkey, n_regionkey % 2 FROM nation)",
     "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey % 2 = s_suppkey % 2)"),
    ("group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10", None),
    ("group_alias", "SELECT substr(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY p", None),
    ("implicit_group", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS c FROM orders WHERE o_orderkey < 0", None),
    ("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 2) AS even FROM orders GROUP BY o_orderstatus", None),
    ("agg_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n, sum(DISTINCT c_nationkey) AS s FROM customer GROUP BY c_mktsegment",
     "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n, CAST(sum(DISTINCT c_nationkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment"),
    ("agg_total_empty", "SELECT total(o_totalprice) AS t, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a"),
    ("group_concat_ordered", "SELECT n_regionkey, group_concat(n_name, ';' ORDER BY n_nationkey DESC) AS names, string_agg(n_name, '+' ORDER BY n_name) FILTER (WHERE n_nationkey > 9) AS late FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey DESC) AS names, string_agg(n_name, '+' ORDER BY n_name) FILTER (WHERE n_nationkey > 9) AS late FROM nation GROUP BY n_regionkey"),
    ("group_concat_separators", MIXED + " SELECT group_concat(a, id ORDER BY id) AS s FROM m", "SELECT 'a2A3b5B ' AS s"),
    ("bare_column_max", "SELECT c_nationkey, max(c_acctbal) AS top, c_custkey FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, max(c_acctbal) AS top, arg_max(c_custkey, c_acctbal) AS c_custkey FROM customer GROUP BY c_nationkey"),
    ("bare_column_first", "SELECT n_regionkey, n_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey"),
    ("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    ("order_nulls", MIXED + " SELECT id, row_number() OVER (ORDER BY b, id) AS up, row_number() OVER (ORDER BY b DESC, id) AS down, row_number() OVER (ORDER BY b NULLS LAST, id) AS last FROM m",
     MIXED + " SELECT CAST(id AS BIGINT) AS id, row_number() OVER (ORDER BY b NULLS FIRST, id) AS up, row_number() OVER (ORDER BY b DESC NULLS LAST, id) AS down, row_number() OVER (ORDER BY b NULLS LAST, id) AS last FROM m"),
    ("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", None),
    ("limit_comma_negative", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 3, 10) LIMIT -1", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 10 OFFSET 3"),
    ("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    ("union_all", "SELECT n_name AS s FROM nation UNION ALL SELECT r_name FROM region", None),
    ("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    ("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier", None),
    ("left_assoc_compound", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT r_regionkey + 20 FROM region INTERSECT SELECT s_nationkey FROM supplier",
     "SELECT CAST(k AS BIGINT) AS k FROM ((SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5) UNION (SELECT r_regionkey + 20 FROM region)) INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier"),
    ("compound_nocase", "SELECT 'a' COLLATE NOCASE AS x UNION SELECT 'A' UNION SELECT 'b'", "SELECT unnest(['A', 'b']) AS x"),
    ("cte_shadow", "WITH nation AS (SELECT r_regionkey AS k FROM region) SELECT k FROM nation", None),
    ("cte_forward", "WITH a AS (SELECT k + 1 AS k FROM b), b AS (SELECT r_regionkey AS k FROM region) SELECT k FROM a", "SELECT CAST(r_regionkey + 1 AS BIGINT) AS k FROM region"),
    ("recursive_count", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 50) SELECT count(*) AS n, sum(x) AS s FROM c",
     "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 50) SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS s FROM c"),
    ("recursive_union_cycle", "WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x * 3) % 7 FROM c) SELECT x FROM c", "WITH RECURSIVE c(x) AS (SELECT CAST(1 AS BIGINT) UNION SELECT (x * 3) % 7 FROM c) SELECT x FROM c"),
    ("recursive_multi_term", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT 2 * x FROM c WHERE x < 8 UNION ALL SELECT 2 * x + 1 FROM c WHERE x < 8) SELECT x FROM c", "SELECT unnest(range(1, 16)) AS x"),
    ("recursive_reach", "WITH RECURSIVE g(a, b) AS (SELECT n_nationkey, (n_nationkey * 2 + 1) % 25 FROM nation), r(x) AS (SELECT 3 UNION SELECT b FROM r JOIN g ON a = x) SELECT x FROM r",
     "WITH RECURSIVE g(a, b) AS (SELECT CAST(n_nationkey AS BIGINT), CAST((n_nationkey * 2 + 1) % 25 AS BIGINT) FROM nation), r(x) AS (SELECT CAST(3 AS BIGINT) UNION SELECT b FROM r JOIN g ON a = x) SELECT x FROM r"),
    ("recursive_limit", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 100 ORDER BY 1 DESC LIMIT 1000) SELECT count(*) AS n FROM c", "SELECT CAST(100 AS BIGINT) AS n"),
    ("values_source", "VALUES (1, 'a', NULL), (2, 'b', 2.5)", "SELECT CAST(column1 AS BIGINT) AS column1, column2, CAST(column3 AS DOUBLE) AS column3 FROM (VALUES (1, 'a', NULL), (2, 'b', 2.5)) t(column1, column2, column3)"),
    ("derived_alias", "SELECT d.k, d.\"k:1\" AS k2 FROM (SELECT n_nationkey AS k, n_regionkey AS k FROM nation) d", "SELECT n_nationkey AS k, n_regionkey AS k2 FROM nation"),
    ("int_div_mod", "SELECT o_orderkey, o_orderkey / 7 AS d, -o_orderkey / 7 AS nd, o_orderkey % 5 AS m, o_orderkey / 0 AS z, o_orderkey % 0 AS zm, 7.0 / 2 AS r FROM orders",
     "SELECT o_orderkey, o_orderkey // 7 AS d, -o_orderkey // 7 AS nd, o_orderkey % 5 AS m, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS zm, CAST(3.5 AS DOUBLE) AS r FROM orders"),
    ("overflow_add", "WITH v(x) AS (VALUES (9223372036854775807), (-9223372036854775808), (5), (NULL)) SELECT x, typeof(x + 1) AS t, CAST(x + 1 AS REAL) AS r, x + 1 > x AS more, CAST(x - 1 AS REAL) AS less, typeof(x + x) AS twice FROM v",
     "WITH v(x) AS (VALUES (9223372036854775807::BIGINT), ((-9223372036854775807 - 1)::BIGINT), (5), (NULL)) SELECT x, CASE WHEN x IS NULL THEN 'null' WHEN x::HUGEINT + 1 > 9223372036854775807 THEN 'real' ELSE 'integer' END AS t, CAST(x::HUGEINT + 1 AS DOUBLE) AS r, CASE WHEN x IS NOT NULL THEN CAST(1 AS BIGINT) END AS more, CAST(x::HUGEINT - 1 AS DOUBLE) AS less, CASE WHEN x IS NULL THEN 'null' WHEN abs(2 * x::HUGEINT) > 9223372036854775807 THEN 'real' ELSE 'integer' END AS twice FROM v"),
    ("overflow_mul", "SELECT o_orderkey, typeof((o_orderkey + 4000000000) * (o_custkey + 2400000000)) AS t, CAST((o_orderkey + 4000000000) * (o_custkey + 2400000000) AS REAL) AS r FROM orders",
     "SELECT o_orderkey, CASE WHEN (o_orderkey::HUGEINT + 4000000000) * (o_custkey + 2400000000) > 9223372036854775807 THEN 'real' ELSE 'integer' END AS t, CASE WHEN (o_orderkey::HUGEINT + 4000000000) * (o_custkey + 2400000000) > 9223372036854775807 THEN (o_orderkey + 4000000000)::DOUBLE * (o_custkey + 2400000000)::DOUBLE ELSE CAST((o_orderkey::HUGEINT + 4000000000) * (o_custkey + 2400000000) AS DOUBLE) END AS r FROM orders"),
    ("neg_min", "WITH v(x) AS (VALUES (-9223372036854775808), (7)) SELECT x, typeof(-x) AS n, CAST(-x AS REAL) AS r, typeof(x / -1) AS d, x / -2 AS h, -9223372036854775808 / -1 AS c FROM v",
     "WITH v(x) AS (VALUES ((-9223372036854775807 - 1)::BIGINT), (7)) SELECT x, CASE WHEN x < -9 THEN 'real' ELSE 'integer' END AS n, CAST(-(x::HUGEINT) AS DOUBLE) AS r, CASE WHEN x < -9 THEN 'real' ELSE 'integer' END AS d, CASE WHEN x < -9 THEN 4611686018427387904 ELSE CAST(-3 AS BIGINT) END AS h, CAST(9223372036854775808 AS DOUBLE) AS c FROM v"),
    ("glob_column_class", "SELECT p_partkey, p_brand GLOB CASE WHEN p_partkey % 3 = 0 THEN 'Brand#[1-3]?' WHEN p_partkey % 3 = 1 THEN '*[^2-4]' ELSE 'Brand#[5-1]*' END AS g, p_brand GLOB CASE WHEN p_size < 25 THEN '[' ELSE 'B*[]1' END AS open FROM part",
     "SELECT p_partkey, CAST(regexp_full_match(p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#[1-3].' WHEN p_partkey % 3 = 1 THEN '.*[^2-4]' ELSE 'Brand#5.*' END) AS BIGINT) AS g, CAST(0 AS BIGINT) AS open FROM part"),
    ("recursive_million", "WITH RECURSIVE c(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM c WHERE x < 2500), d(a, b) AS (SELECT c.x, 1 FROM c UNION ALL SELECT a, b + 1 FROM d WHERE b < 500) SELECT count(*) AS n, max(a) AS m, max(b) AS k FROM d",
     "SELECT CAST(1250000 AS BIGINT) AS n, CAST(2500 AS BIGINT) AS m, CAST(500 AS BIGINT) AS k"),
    ("limit_far", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 9223372036854775807 OFFSET 100", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100"),
    ("date_overflow_of_months", "SELECT o_orderkey, date(o_orderdate, 'start of month', '+30 days', '+1 month') AS d, strftime('%W', o_orderdate) AS w FROM orders",
     "WITH d AS (SELECT o_orderkey, o_orderdate, date_trunc('month', o_orderdate) + INTERVAL 30 DAY AS x FROM orders) SELECT o_orderkey, strftime(date_trunc('month', x) + INTERVAL 1 MONTH + to_days(CAST(day(x) - 1 AS INTEGER)), '%Y-%m-%d') AS d, strftime(o_orderdate, '%W') AS w FROM d"),
    ("quoted_fallback", 'SELECT "no such thing" AS a, r_name FROM region', "SELECT 'no such thing' AS a, r_name FROM region"),
    ("join_right_using_star", "SELECT n.*, r_name FROM region r RIGHT JOIN (SELECT n_regionkey + 2 AS r_regionkey, n_name FROM nation) n USING (r_regionkey)", "SELECT CAST(n_regionkey + 2 AS BIGINT) AS r_regionkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey + 2"),
    ("having_alone", "SELECT count(*) AS n, max(o_orderkey) AS m FROM orders HAVING count(*) > 3", None),
    ("window_values", "SELECT c_custkey, percent_rank() OVER w AS p, cume_dist() OVER w AS d, first_value(c_acctbal) OVER w AS f, nth_value(c_acctbal, 2) OVER w AS s, last_value(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, ntile(3) OVER w AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)", None),
    ("window_exclude_sum", "SELECT c_custkey, sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS g, sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS c FROM customer",
     "SELECT c_custkey, CAST(sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS BIGINT) AS g, CAST(sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS BIGINT) AS c FROM customer"),
    ("order_collate", MIXED + " SELECT id, a FROM m ORDER BY a COLLATE NOCASE DESC, id LIMIT 3", MIXED + " SELECT CAST(id AS BIGINT) AS id, a FROM m ORDER BY lower(a) DESC NULLS LAST, id LIMIT 3"),
    ("order_of_compound", "SELECT o_orderkey AS k FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT c_custkey FROM customer ORDER BY k DESC LIMIT 40", None),
    ("cte_hints", "WITH a AS MATERIALIZED (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS NOT MATERIALIZED (SELECT k FROM a WHERE n > 12) SELECT a.k, a.n FROM a JOIN b ON a.k = b.k", None),
    ("precedence", "SELECT 1 + 2 * 3 - 7 % 4 AS a, 1 || 2 + 3 AS b, 2 * 3 || 4 AS c, 1 < 2 = 1 AS d, NOT 1 = 2 AS e, 1 + 1 << 2 AS f, 5 & 3 = 1 AS g, 1 OR 0 AND 0 AS h, - 2 * -3 AS i, ~1 + 1 AS j",
     "SELECT CAST(4 AS BIGINT) AS a, CAST(15 AS DOUBLE) AS b, CAST(68 AS DOUBLE) AS c, CAST(1 AS BIGINT) AS d, CAST(1 AS BIGINT) AS e, CAST(8 AS BIGINT) AS f, CAST(1 AS BIGINT) AS g, CAST(1 AS BIGINT) AS h, CAST(6 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS j"),
    ("literals", "SELECT 0x1F AS a, 1e3 AS b, .5 AS c, hex(x'4142') AS d, 'it''s' AS e, 9223372036854775807 AS f, -9223372036854775808 AS g, TRUE AS h", "SELECT CAST(31 AS BIGINT) AS a, CAST(1000 AS DOUBLE) AS b, CAST(0.5 AS DOUBLE) AS c, '4142' AS d, 'it''s' AS e, 9223372036854775807 AS f, CAST('-9223372036854775808' AS BIGINT) AS g, CAST(1 AS BIGINT) AS h"),
    ("row_value_between", "SELECT o_orderkey, (o_custkey, o_orderkey) BETWEEN (100, 5) AND (900, 2) AS b, CASE (o_custkey % 2, o_orderkey % 2) WHEN (0, 0) THEN 'even' WHEN (1, 1) THEN 'odd' ELSE 'mixed' END AS c FROM orders",
     "SELECT o_orderkey, CAST((o_custkey > 100 OR o_custkey = 100 AND o_orderkey >= 5) AND (o_custkey < 900 OR o_custkey = 900 AND o_orderkey <= 2) AS BIGINT) AS b, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 2 = 0 THEN 'even' WHEN o_custkey % 2 = 1 AND o_orderkey % 2 = 1 THEN 'odd' ELSE 'mixed' END AS c FROM orders"),
    ("nan_is_null", "SELECT 9e999 - 9e999 AS a, 0 * 9e999 AS b, typeof(9e999 - 9e999) AS t, 9e999 > 1 AS c", "SELECT CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b, 'null' AS t, CAST(1 AS BIGINT) AS c"),
    ("in_affinity", "SELECT count(*) AS n, '1' IN (1, 2) AS lone, 1 IN ('1') AS other FROM part WHERE p_partkey IN ('1', '2', 'x')", "SELECT CAST(2 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lone, CAST(0 AS BIGINT) AS other"),
    ("distinct_text_list", "SELECT o_orderpriority, length(group_concat(DISTINCT o_orderstatus)) AS l FROM orders GROUP BY 1", "SELECT o_orderpriority, CAST(2 * count(DISTINCT o_orderstatus) - 1 AS BIGINT) AS l FROM orders GROUP BY 1"),
    ("mixed_typeof", "SELECT typeof(column1) AS t, length(column1) AS l, quote(column1) AS q FROM (VALUES (1), ('x'), (2.5), (NULL), (x'41ff'))", "SELECT * FROM (VALUES ('integer', CAST(1 AS BIGINT), '1'), ('text', 1, '''x'''), ('real', 3, '2.5'), ('null', NULL, 'NULL'), ('blob', 2, 'X''41FF''')) v(t, l, q)"),
    ("mixed_order", "SELECT quote(column1) AS q, row_number() OVER (ORDER BY column1) AS n FROM (VALUES ('b'), (10), (x'00'), (9.5), (NULL), ('a'), (-1))", "SELECT * FROM (VALUES ('NULL', CAST(1 AS BIGINT)), ('-1', 2), ('9.5', 3), ('10', 4), ('''a''', 5), ('''b''', 6), ('X''00''', 7)) v(q, n)"),
    ("mixed_group", "SELECT typeof(min(column1)) AS t, count(*) AS n FROM (VALUES (1), ('1'), (2), ('1'), (2), (x'31')) GROUP BY column1", "SELECT * FROM (VALUES ('integer', CAST(1 AS BIGINT)), ('text', 2), ('integer', 2), ('blob', 1)) v(t, n)"),
    ("overflow_to_real", "SELECT 9223372036854775807 + 0.0 AS a, 9223372036854775808 AS b, 9223372036854775807 > 9223372036854775807.0 AS c", "SELECT CAST(9223372036854775807 AS DOUBLE) AS a, CAST(9223372036854775808 AS DOUBLE) AS b, CAST(0 AS BIGINT) AS c"),
    ("bitops_shift", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS b, ~p_size AS c, p_size << 2 AS d, p_size >> 1 AS e, p_size << -1 AS f, p_size << 64 AS g, -p_size >> 70 AS h FROM part",
     "SELECT p_partkey, CAST(p_size & 6 AS BIGINT) AS a, CAST(p_size | 8 AS BIGINT) AS b, CAST(-p_size - 1 AS BIGINT) AS c, CAST(p_size * 4 AS BIGINT) AS d, CAST(p_size // 2 AS BIGINT) AS e, CAST(p_size // 2 AS BIGINT) AS f, CAST(0 AS BIGINT) AS g, CAST(CASE WHEN p_size = 0 THEN 0 ELSE -1 END AS BIGINT) AS h FROM part"),
    ("cast_prefix", "SELECT CAST('123xyz' AS INTEGER) AS a, CAST('  4.5e1z' AS REAL) AS b, CAST('abc' AS INTEGER) AS c, CAST(3.99 AS INTEGER) AS d, CAST(-3.99 AS INT) AS e, CAST(12 AS TEXT) AS f, CAST(1e300 AS INTEGER) AS g, '5' + '6x' AS h, CAST(2.5 AS TEXT) AS i",
     "SELECT CAST(123 AS BIGINT) AS a, CAST(45 AS DOUBLE) AS b, CAST(0 AS BIGINT) AS c, CAST(3 AS BIGINT) AS d, CAST(-3 AS BIGINT) AS e, '12' AS f, CAST(9223372036854775807 AS BIGINT) AS g, CAST(11 AS DOUBLE) AS h, '2.5' AS i"),
    ("compare_affinity", "SELECT p_partkey FROM part WHERE p_size = '7' OR p_size > '45' OR p_partkey < 'x' AND p_size = 1", "SELECT p_partkey FROM part WHERE p_size = 7 OR p_size > 45 OR p_size = 1"),
    ("substr_grid", "WITH RECURSIVE g(i) AS (SELECT -7 UNION ALL SELECT i + 1 FROM g WHERE i < 7) SELECT a.i AS i, b.i AS j, substr('héllo', a.i, b.i) AS s FROM g a, g b",
     """WITH g(i) AS (SELECT unnest(range(-7, 8))), x AS (SELECT a.i, b.i AS j, CASE WHEN a.i < 0 THEN 5 + a.i WHEN a.i > 0 THEN a.i - 1 WHEN b.i > 0 THEN -1 ELSE 0 END AS st FROM g a, g b),
        y AS (SELECT i, j, CASE WHEN j < 0 THEN st + j ELSE st END AS lo, CASE WHEN j < 0 THEN st ELSE st + j END AS hi FROM x)
        SELECT i, j, coalesce(array_to_string(list_slice(['h', 'é', 'l', 'l', 'o'], greatest(0, least(5, lo)) + 1, greatest(0, least(5, hi))), ''), '') AS s FROM y"""),
    ("trim_set", "SELECT trim('xxaxyx', 'xy') AS a, ltrim('  b ') AS b, rtrim('cxyx', 'xy') AS c, trim(n_name, 'NA') AS d FROM nation", "SELECT 'a' AS a, 'b ' AS b, 'c' AS c, trim(n_name, 'NA') AS d FROM nation"),
    ("replace_instr", "SELECT n_name, replace(n_name, 'N', '<>') AS a, replace(n_name, '', 'z') AS b, instr(n_name, 'O') AS c, instr(n_name, '') AS d FROM nation",
     "SELECT n_name, replace(n_name, 'N', '<>') AS a, n_name AS b, CAST(instr(n_name, 'O') AS BIGINT) AS c, CAST(1 AS BIGINT) AS d FROM nation"),
    ("hex_unhex", "SELECT hex('ab') AS a, hex(NULL) AS b, hex(x'0f') AS c, hex(unhex('6162')) AS d, unhex('6') IS NULL AS e, hex(unhex('61-62', '-')) AS f, hex(12) AS g",
     "SELECT '6162' AS a, '' AS b, '0F' AS c, '6162' AS d, CAST(1 AS BIGINT) AS e, '6162' AS f, '3132' AS g"),
    ("typeof_map", MIXED + " SELECT id, typeof(a) AS ta, typeof(b) AS tb, typeof(2.5) AS tr, typeof(x'00') AS tx, typeof(NULL) AS tn, typeof(b = 2) AS tq FROM m",
     MIXED + " SELECT CAST(id AS BIGINT) AS id, CASE WHEN a IS NULL THEN 'null' ELSE 'text' END AS ta, CASE WHEN b IS NULL THEN 'null' ELSE 'integer' END AS tb, 'real' AS tr, 'blob' AS tx, 'null' AS tn, CASE WHEN b IS NULL THEN 'null' ELSE 'integer' END AS tq FROM m"),
    ("iif_variadic", "SELECT p_partkey, iif(p_size < 10, 'a', p_size < 20, 'b', 'c') AS x, if(p_size > 45, 1) AS y, coalesce(NULL, p_size) AS z, nullif(p_size, 7) AS w, ifnull(NULL, 'q') AS v FROM part",
     "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' ELSE 'c' END AS x, CAST(CASE WHEN p_size > 45 THEN 1 END AS BIGINT) AS y, p_size AS z, nullif(p_size, 7) AS w, 'q' AS v FROM part"),
    ("minmax_scalar_null", MIXED + " SELECT id, max(id, b) AS hi, min(id, b, 3) AS lo, max('a', 'B' COLLATE NOCASE) AS t FROM m",
     MIXED + " SELECT CAST(id AS BIGINT) AS id, CAST(CASE WHEN b IS NOT NULL THEN greatest(id, b) END AS BIGINT) AS hi, CAST(CASE WHEN b IS NOT NULL THEN least(id, b, 3) END AS BIGINT) AS lo, 'B' AS t FROM m"),
    ("text_functions", "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name) AS n, octet_length(p_type) AS o, unicode(p_name) AS u, lower('ÄB') AS k, length('é') AS e, octet_length('é') AS f FROM part",
     "SELECT p_partkey, lower(p_name) AS lo, upper(p_name) AS up, length(p_name) AS n, CAST(strlen(p_type) AS BIGINT) AS o, CAST(unicode(p_name) AS BIGINT) AS u, 'Äb' AS k, CAST(1 AS BIGINT) AS e, CAST(2 AS BIGINT) AS f FROM part"),
    ("char_abs_quote", "SELECT char(72, 233, 127822) AS c, abs(-5) AS a, abs(-2.5) AS b, 'a' || 1 || 2.5 || NULL IS NULL AS n, 'a' || 1 || 2.5 AS s, like('%b%', 'ABC') AS l, glob('a*', 'abc') AS g",
     "SELECT 'Hé🍎' AS c, CAST(5 AS BIGINT) AS a, CAST(2.5 AS DOUBLE) AS b, CAST(1 AS BIGINT) AS n, 'a12.5' AS s, CAST(1 AS BIGINT) AS l, CAST(1 AS BIGINT) AS g"),
    ("real_to_text", "SELECT CAST(1.0 AS TEXT) AS a, CAST(0.1 AS TEXT) AS b, CAST(1e20 AS TEXT) AS c, CAST(-2.5e-7 AS TEXT) AS d, CAST(123456789.25 AS TEXT) AS e", "SELECT '1.0' AS a, '0.1' AS b, '1.0e+20' AS c, '-2.5e-07' AS d, '123456789.25' AS e"),
    ("window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)", None),
    ("window_rows", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, lag(l_quantity, 1, 0.0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS f FROM lineitem", None),
    ("window_range", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM customer", None),
    ("window_groups", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM customer", None),
    ("window_exclude", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey / 5 ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM customer",
     "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey // 5 ORDER BY c_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS n FROM customer"),
    ("window_running", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events", None),
    ("json_extract", "SELECT event_id, json_extract(props, '$.k') AS k, props ->> 'k' AS k2 FROM events", "SELECT event_id, props ->> '$.k' AS k, props ->> '$.k' AS k2 FROM events"),
    ("date_parts", "SELECT o_orderkey, date(o_orderdate) AS d, strftime('%Y-%m', o_orderdate) AS ym, date(o_orderdate, 'start of month', '+1 month') AS nx FROM orders",
     "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m') AS ym, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS nx FROM orders"),
    ("percentile_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(percentile_cont(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m, round(quantile_cont(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag"),
    ("math_functions", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(pow(p_size, 2), 2) AS b, round(log10(p_retailprice), 6) AS c, ceil(p_retailprice) AS d, floor(p_retailprice) AS e, sign(p_size - 10) AS f FROM part",
     "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(pow(p_size, 2), 2) AS b, round(log10(p_retailprice), 6) AS c, ceil(p_retailprice) AS d, floor(p_retailprice) AS e, CAST(sign(p_size - 10) AS BIGINT) AS f FROM part"),
    ("pushed_filter_dates", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS r FROM lineitem WHERE l_shipdate >= '1995-01-01' AND l_shipdate < '1996-01-01' AND l_discount BETWEEN 0.03 AND 0.07 GROUP BY l_returnflag",
     "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount BETWEEN 0.03 AND 0.07 GROUP BY l_returnflag"),
]

_T = "CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT COLLATE NOCASE UNIQUE, n NUMERIC DEFAULT 12 CHECK (n >= 0)); INSERT INTO t SELECT n_nationkey, n_name, n_regionkey FROM nation;"

#: (name, script whose last statement gives the rows, DuckDB SQL): definitions and data changes.
SCRIPTS: list[tuple[str, str, str]] = [
    ("view_lazy", "CREATE VIEW v(k, x) AS SELECT n_regionkey, count(*) FROM nation GROUP BY 1; SELECT k, x FROM v", "SELECT n_regionkey AS k, count(*) AS x FROM nation GROUP BY 1"),
    ("ctas", "CREATE TABLE c AS SELECT r_name, r_regionkey * 2 AS k FROM region; SELECT r_name, k FROM c", "SELECT r_name, CAST(r_regionkey * 2 AS BIGINT) AS k FROM region"),
    ("insert_select", _T + "INSERT INTO t(a) SELECT r_name FROM region WHERE r_regionkey < 3; SELECT a, n FROM t", "SELECT n_name AS a, CAST(n_regionkey AS BIGINT) AS n FROM nation UNION ALL SELECT r_name, 12 FROM region WHERE r_regionkey < 3"),
    ("update_case", _T + "UPDATE t SET n = CASE WHEN n > 2 THEN n * 10 ELSE n + 1 END, a = a || '!' WHERE id % 2 = 0; SELECT id, a, n FROM t",
     "SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '!' ELSE n_name END AS a, CAST(CASE WHEN n_nationkey % 2 <> 0 THEN n_regionkey WHEN n_regionkey > 2 THEN n_regionkey * 10 ELSE n_regionkey + 1 END AS BIGINT) AS n FROM nation"),
    ("update_row_value", _T + "UPDATE t SET (n, a) = (SELECT r_regionkey + 100, r_name || t.id FROM region WHERE r_regionkey = t.n); SELECT id, a, n FROM t",
     "SELECT CAST(n_nationkey AS BIGINT) AS id, r_name || n_nationkey AS a, CAST(r_regionkey + 100 AS BIGINT) AS n FROM nation JOIN region ON r_regionkey = n_regionkey"),
    ("delete_where", _T + "DELETE FROM t WHERE n IN (SELECT r_regionkey FROM region WHERE r_name GLOB 'A*') OR NULL; SELECT id FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')"),
    ("upsert_do_update", _T + "INSERT INTO t(a, n) VALUES ('nation_1', 50), ('new', 1), ('NATION_1', 7) ON CONFLICT(a) DO UPDATE SET n = n + excluded.n WHERE excluded.n > 0; SELECT a, n FROM t",
     "SELECT n_name AS a, CAST(CASE WHEN n_name = 'NATION_1' THEN n_regionkey + 57 ELSE n_regionkey END AS BIGINT) AS n FROM nation UNION ALL SELECT 'new', 1"),
    ("upsert_do_nothing", _T + "INSERT INTO t(a, n) VALUES ('nation_1', 50), ('new', 1), ('NEW', 7) ON CONFLICT DO NOTHING; SELECT id, a, n FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS a, CAST(n_regionkey AS BIGINT) AS n FROM nation UNION ALL SELECT 25, 'new', 1"),
    ("insert_or_ignore", _T + "INSERT OR IGNORE INTO t VALUES (3, 'dup id', 1), (30, 'nation_4', 1), (31, 'fresh', 5), (32, 'bad', -1); SELECT id, a, n FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS a, CAST(n_regionkey AS BIGINT) AS n FROM nation UNION ALL SELECT 31, 'fresh', 5"),
    ("insert_or_replace", _T + "INSERT OR REPLACE INTO t VALUES (3, 'nation_4', 9), (40, 'x', 1); SELECT id, a, n FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS a, CAST(n_regionkey AS BIGINT) AS n FROM nation WHERE n_nationkey NOT IN (3, 4) UNION ALL SELECT 3, 'nation_4', 9 UNION ALL SELECT 40, 'x', 1"),
    ("returning_rows", _T + "UPDATE t SET n = n * 2 WHERE id < 4 RETURNING id, n, upper(a) AS u", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey * 2 AS BIGINT) AS n, upper(n_name) AS u FROM nation WHERE n_nationkey < 4"),
    ("generated_column", "CREATE TABLE g(id INTEGER PRIMARY KEY, v INT AS (s + 1), x INT, s INT GENERATED ALWAYS AS (x * id) STORED); INSERT INTO g(id, x) SELECT n_nationkey, n_regionkey FROM nation; SELECT id, x, s, v FROM g",
     "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS x, CAST(n_nationkey * n_regionkey AS BIGINT) AS s, CAST(n_nationkey * n_regionkey + 1 AS BIGINT) AS v FROM nation"),
    ("autoincrement", "CREATE TABLE s(id INTEGER PRIMARY KEY AUTOINCREMENT, x TEXT); INSERT INTO s(x) VALUES ('a'), ('b'); DELETE FROM s; INSERT INTO s(x) VALUES ('c'); SELECT id, x FROM s", "SELECT CAST(3 AS BIGINT) AS id, 'c' AS x"),
    ("transaction_savepoint", _T + "BEGIN; DELETE FROM t WHERE id < 10; SAVEPOINT p; DELETE FROM t; ROLLBACK TO p; COMMIT; SELECT id FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey >= 10"),
    ("alter_columns", _T + "ALTER TABLE t ADD COLUMN z TEXT DEFAULT 'q'; ALTER TABLE t RENAME COLUMN n TO m; ALTER TABLE t RENAME TO t2; SELECT id, m, z FROM t2", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS m, 'q' AS z FROM nation"),
    ("without_rowid", "CREATE TABLE w(a TEXT, b INT, v, PRIMARY KEY (a, b)) WITHOUT ROWID; INSERT INTO w SELECT n_name, n_regionkey, n_nationkey FROM nation; INSERT OR REPLACE INTO w VALUES ('NATION_1', 1, 99); SELECT a, b, v FROM w",
     "SELECT n_name AS a, CAST(n_regionkey AS BIGINT) AS b, CAST(CASE WHEN n_nationkey = 1 THEN 99 ELSE n_nationkey END AS BIGINT) AS v FROM nation"),
    ("strict_table", "CREATE TABLE k(i INT, r REAL, s TEXT) STRICT; INSERT INTO k SELECT n_nationkey, n_regionkey, n_name FROM nation; SELECT i, r, s FROM k", "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS DOUBLE) AS r, n_name AS s FROM nation"),
    ("expression_index", "CREATE TABLE e(x TEXT, act INT); CREATE UNIQUE INDEX ix ON e(lower(x)) WHERE act; INSERT OR IGNORE INTO e VALUES ('A', 1), ('a', 1), ('a', 0), ('A', 0); SELECT x, act FROM e", "SELECT * FROM (VALUES ('A', CAST(1 AS BIGINT)), ('a', 0), ('A', 0)) t(x, act)"),
    ("upsert_two_targets", _T + "INSERT INTO t VALUES (3, 'fresh', 50), (60, 'nation_7', 1), (61, 'new', 2), (61, 'newer', 3) ON CONFLICT(id) DO UPDATE SET n = excluded.n ON CONFLICT(a) DO UPDATE SET n = n + 100; SELECT id, a, n FROM t",
     "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS a, CAST(CASE n_nationkey WHEN 3 THEN 50 WHEN 7 THEN n_regionkey + 100 ELSE n_regionkey END AS BIGINT) AS n FROM nation UNION ALL SELECT 61, 'new', 3"),
    ("update_lineitem", "CREATE TABLE l AS SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem; UPDATE l SET l_quantity = l_quantity * 2, l_returnflag = 'X' WHERE l_orderkey % 5 = 0; DELETE FROM l WHERE l_quantity > 90; SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS q FROM l GROUP BY 1",
     "WITH u AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_quantity * 2 ELSE l_quantity END AS q, CASE WHEN l_orderkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS f FROM lineitem) SELECT f AS l_returnflag, count(*) AS n, round(sum(q), 2) AS q FROM u WHERE NOT q > 90 GROUP BY 1"),
    ("upsert_orders", "CREATE TABLE c(k INTEGER PRIMARY KEY, n INT, total INT, latest INT); INSERT INTO c SELECT c_custkey, 0, 0, -1 FROM customer WHERE c_custkey % 2 = 0; INSERT INTO c SELECT o_custkey, 1, o_orderkey, o_orderkey FROM orders WHERE true ORDER BY o_orderkey ON CONFLICT(k) DO UPDATE SET n = n + excluded.n, total = total + excluded.total, latest = excluded.latest WHERE excluded.latest % 10 > 0; SELECT k, n, total, latest FROM c",
     "WITH e AS (SELECT c_custkey AS k, 0 AS n, 0::BIGINT AS v, -1::BIGINT AS o FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, 1, o_orderkey, o_orderkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS i FROM e) SELECT CAST(k AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(max(o) AS BIGINT) AS latest FROM r WHERE i = 1 OR o % 10 > 0 GROUP BY k"),
    ("pragma_expression_default", "CREATE TABLE u(a text, b int DEFAULT ( 1 + 2 ), c DEFAULT 'it''s', d REAL DEFAULT -5); PRAGMA table_info(u)",
     "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', 'TEXT', CAST(0 AS BIGINT), NULL, CAST(0 AS BIGINT)), (1, 'b', 'INT', 0, '1 + 2', 0), (2, 'c', '', 0, '''it''''s''', 0), (3, 'd', 'REAL', 0, '-5', 0)) t(cid, name, type, \"notnull\", dflt_value, pk)"),
    ("pragma_index_desc", _T + "CREATE INDEX ix ON t(n DESC, a); PRAGMA index_xinfo(ix)",
     "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT), 'n', CAST(1 AS BIGINT), 'BINARY', CAST(1 AS BIGINT)), (1, 1, 'a', 0, 'NOCASE', 1), (2, -1, NULL, 0, 'BINARY', 0)) t(seqno, cid, name, \"desc\", coll, key)"),
    ("check_short_circuit", "CREATE TABLE q(x INT CHECK (x IS NULL OR x = 0 OR 10 / x > 0)); INSERT INTO q VALUES (NULL), (5), (0); SELECT x FROM q", "SELECT * FROM (VALUES (CAST(NULL AS BIGINT)), (5), (0)) t(x)"),
    ("generated_null_extended", "CREATE TABLE g(k INT, d INT AS (coalesce(k, 0) + 1)); INSERT INTO g SELECT r_regionkey FROM region WHERE r_regionkey < 2; SELECT r_regionkey, d FROM region LEFT JOIN g ON k = r_regionkey", "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN CAST(r_regionkey + 1 AS BIGINT) END AS d FROM region"),
    ("with_insert", _T + "WITH s AS (SELECT r_name AS x FROM region) INSERT INTO t(a) SELECT x FROM s; SELECT a, n FROM t WHERE id > 24", "SELECT r_name AS a, CAST(12 AS BIGINT) AS n FROM region"),
    ("counters", _T + "UPDATE t SET n = 1 WHERE id < 5; INSERT INTO t(a) VALUES ('zz'); SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS r", "SELECT CAST(1 AS BIGINT) AS c, CAST(31 AS BIGINT) AS t, CAST(25 AS BIGINT) AS r"),
    ("default_values", "CREATE TABLE d(a INT DEFAULT 4, b TEXT DEFAULT 'q'); INSERT INTO d DEFAULT VALUES; INSERT INTO d(b) VALUES ('r'); SELECT a, b FROM d", "SELECT * FROM (VALUES (CAST(4 AS BIGINT), 'q'), (4, 'r')) t(a, b)"),
    ("self_insert", "CREATE TABLE o AS SELECT o_orderkey AS k, o_custkey AS c FROM orders; INSERT INTO o SELECT k + 1000000, c FROM o; SELECT count(*) AS n, sum(k) AS s, count(DISTINCT c) AS d FROM o", "SELECT 2 * count(*) AS n, CAST(2 * sum(o_orderkey) + 1000000 * count(*) AS BIGINT) AS s, count(DISTINCT o_custkey) AS d FROM orders"),
    ("not_null_default", "CREATE TABLE d(a INT NOT NULL DEFAULT 7, b INT); INSERT OR REPLACE INTO d VALUES (NULL, 1), (2, 2); SELECT a, b FROM d", "SELECT * FROM (VALUES (CAST(7 AS BIGINT), CAST(1 AS BIGINT)), (2, 2)) t(a, b)"),
    ("drop_objects", "CREATE TABLE a1(x); CREATE VIEW v1 AS SELECT 1 AS x; CREATE INDEX i1 ON a1(x); DROP INDEX i1; DROP VIEW v1; DROP TABLE a1; DROP TABLE IF EXISTS a1; CREATE TABLE a1(y INT); INSERT INTO a1 SELECT n_nationkey FROM nation; SELECT y FROM a1", "SELECT CAST(n_nationkey AS BIGINT) AS y FROM nation"),
    ("alter_constraints", "CREATE TABLE z(a INT, b INT, c INT); INSERT INTO z SELECT n_nationkey, 0, n_regionkey FROM nation; ALTER TABLE z DROP COLUMN b; ALTER TABLE z ALTER COLUMN a SET NOT NULL; ALTER TABLE z ALTER COLUMN a DROP NOT NULL; INSERT INTO z VALUES (NULL, 9); SELECT a, c FROM z", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS c FROM nation UNION ALL SELECT NULL, 9"),
    ("pragma_table_list", "CREATE TABLE q1(a INT, b INT) STRICT; PRAGMA table_list(q1)", "SELECT 'main' AS schema, 'q1' AS name, 'table' AS type, CAST(2 AS BIGINT) AS ncol, CAST(0 AS BIGINT) AS wr, CAST(1 AS BIGINT) AS strict"),
    ("pragma_user_version", "PRAGMA user_version = 12; PRAGMA user_version", "SELECT CAST(12 AS BIGINT) AS user_version"),
    ("savepoint_release", _T + "SAVEPOINT a; DELETE FROM t WHERE id < 20; SAVEPOINT b; DELETE FROM t; ROLLBACK TO b; RELEASE a; SELECT id FROM t", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey >= 20"),
    ("strict_any", "CREATE TABLE k(i INT, a ANY) STRICT; INSERT INTO k VALUES (1, 5); INSERT INTO k VALUES (2, 'x'), (3, 2.5), (4, '0012'), (5, NULL); SELECT i, typeof(a) AS t, quote(a) AS q FROM k", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'integer', '5'), (2, 'text', '''x'''), (3, 'real', '2.5'), (4, 'text', '''0012'''), (5, 'null', 'NULL')) t(i, t, q)"),
    ("untyped_column", "CREATE TABLE u(a); INSERT INTO u SELECT o_orderkey FROM orders; INSERT INTO u SELECT o_orderstatus FROM orders; INSERT INTO u SELECT o_totalprice FROM orders; SELECT typeof(a) AS t, count(*) AS n, count(DISTINCT a) AS d FROM u GROUP BY 1", "SELECT 'integer' AS t, count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders UNION ALL SELECT 'text', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'real', count(*), count(DISTINCT o_totalprice) FROM orders"),
    ("pragma_table_info", _T + "PRAGMA table_info(t)", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'id', 'INTEGER', CAST(0 AS BIGINT), NULL, CAST(1 AS BIGINT)), (1, 'a', 'TEXT', 0, NULL, 0), (2, 'n', 'NUMERIC', 0, '12', 0)) t(cid, name, type, \"notnull\", dflt_value, pk)"),
]

#: Columns that give registered tables their row order.
ORDER = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def connect(spark: SparkSession, sf_dir: str) -> Connection:
    con = Connection(spark)
    for name in TABLES:
        con.offer(name, lambda path=f"{sf_dir}/{name}.parquet": spark.read.parquet(path), ORDER.get(name))
    return con


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connect(spark, sf_dir).sql(FLAGSHIP)


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: connect(spark, sf_dir).sql(sql)


def _script(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: connect(spark, sf_dir).execute_batch(sql)[-1].df


def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer of a table that went through a database image, with its index."""
    from sedge.sources.image import attach
    from sedge.sources.image_writer import export
    from sedge.sources.scratch import fresh_path

    con, again = connect(spark, sf_dir), Connection(spark)
    con.execute_batch("CREATE TABLE t(id INTEGER PRIMARY KEY, c INT, s TEXT, p REAL); INSERT INTO t SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders; CREATE INDEX i ON t(c DESC, s)")
    path = f"{fresh_path(spark, 'image')}.db"
    export(con, path)
    attach(again, path)
    return again.sql("SELECT c, s, count(*) AS n, max(id) AS last, round(max(p), 2) AS most FROM t GROUP BY 1, 2")


def folder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table that a second connection finds in the folder of the first after its commits."""
    from sedge.sources.scratch import fresh_path
    from sedge.sources.store import load, opened

    folder = fresh_path(spark, "folder")
    con = opened(spark, folder)
    con.offer("orders", lambda: spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")
    con.execute_batch("CREATE TABLE t AS SELECT o_orderkey AS k, o_custkey AS c FROM orders; BEGIN; DELETE FROM t WHERE k % 3 = 0; COMMIT; BEGIN; DELETE FROM t; ROLLBACK")
    return load(spark, folder).sql("SELECT c, count(*) AS n FROM t GROUP BY 1")


#: (function, DuckDB SQL): sources and sinks.
ROUND_TRIPS = [
    (image_round_trip, "SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n, max(o_orderkey) AS last, round(max(o_totalprice), 2) AS most FROM orders GROUP BY 1, 2"),
    (folder_round_trip, "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _query(sql) for n, sql, _ in ENTRIES} | {n: _script(sql) for n, sql, _ in SCRIPTS} | {f.__name__: f for f, _ in ROUND_TRIPS}


def oracle_sql() -> dict[str, str]:
    return {n: other or sql for n, sql, other in ENTRIES} | {n: other for n, _, other in SCRIPTS} | {f.__name__: sql for f, sql in ROUND_TRIPS}
