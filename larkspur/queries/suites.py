"""The relational surface: queries whose SQL text runs on Spark and on DuckDB.

Grouped by what they exercise: star joins and correlated subqueries, grouping
and windows, wide-table analytics, text filters, nested JSON, time buckets,
lists, and left-join chains. Output columns are named and cast, doubles are
rounded, and every ordering that a limit depends on is total.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, str] = {}

# star joins, subqueries, top-k
SQL |= {
    "star_q1_pricing": f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
               round(sum({_REVENUE}), 4) AS sum_disc, round(sum({_REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
               round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    "star_q2_min_cost": """
        SELECT s.s_name, n.n_name, s.s_acctbal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
        WHERE s.s_acctbal = (SELECT min(s2.s_acctbal) FROM supplier s2 WHERE s2.s_nationkey = s.s_nationkey)""",
    "star_q3_shipping": f"""
        SELECT o_orderkey, round(sum({_REVENUE}), 4) AS revenue, CAST(o_orderdate AS DATE) AS o_date
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15'
        GROUP BY o_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, o_orderkey LIMIT 10""",
    "star_q4_priority": """
        SELECT o_orderpriority, count(*) AS n FROM orders
        WHERE o_orderdate >= DATE '1993-07-01' AND o_orderdate < DATE '1996-10-01'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority""",
    "star_q5_local": f"""
        SELECT n_name, round(sum({_REVENUE}), 4) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' GROUP BY n_name""",
    "star_q6_forecast": """
        SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
        WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "star_q7_volume": f"""
        SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, round(sum({_REVENUE}), 4) AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey <> n2.n_regionkey AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
        GROUP BY n1.n_name, n2.n_name, CAST(extract(year FROM l_shipdate) AS BIGINT)""",
    "star_q8_share": f"""
        SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year,
               round(sum(CASE WHEN n2.n_regionkey = 2 THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS share
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        JOIN region ON n1.n_regionkey = r_regionkey WHERE r_name = 'AMERICA' GROUP BY CAST(extract(year FROM o_orderdate) AS BIGINT)""",
    "star_q9_profit": f"""
        SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, round(sum({_REVENUE} - p_retailprice * l_quantity * 0.1), 4) AS profit
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY n_name, CAST(extract(year FROM o_orderdate) AS BIGINT)""",
    "star_q10_returns": f"""
        SELECT c_custkey, c_name, round(sum({_REVENUE}), 4) AS revenue, n_name
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "star_q11_important": """
        SELECT l_partkey, round(sum(l_extendedprice), 2) AS worth FROM lineitem GROUP BY l_partkey
        HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem)""",
    "star_q12_modes": """
        SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_count,
               sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1994-01-01' GROUP BY l_linestatus""",
    "star_q13_distribution": """
        SELECT c_count, count(*) AS custdist FROM (
            SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) t
        GROUP BY c_count""",
    "star_q14_promo": f"""
        SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REVENUE} ELSE 0 END) / sum({_REVENUE}), 6) AS promo
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "star_q15_top_supplier": f"""
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REVENUE}), 4) AS total FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM revenue)""",
    "star_q16_parts": """
        SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE p_size IN (1, 9, 14, 23, 36, 45) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_size""",
    "star_q17_small": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON p_partkey = l_partkey
        WHERE l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = part.p_partkey)""",
    "star_q18_large": """
        SELECT c_name, o_orderkey, round(o_totalprice, 2) AS total, round(sum(l_quantity), 2) AS qty
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
        GROUP BY c_name, o_orderkey, round(o_totalprice, 2) ORDER BY total DESC, o_orderkey LIMIT 100""",
    "star_q19_disjunction": f"""
        SELECT round(sum({_REVENUE}), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 20 AND l_quantity BETWEEN 10 AND 20) OR (p_size > 40 AND l_quantity > 40)""",
    "star_q20_nested_in": """
        SELECT s_name FROM supplier WHERE s_suppkey IN (
            SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY l_suppkey HAVING sum(l_quantity) > 100)""",
    "star_q21_waiting": """
        SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
        WHERE o_orderstatus = 'F' AND l1.l_quantity > 30
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 30)
        GROUP BY s_name""",
    "star_q22_no_orders": """
        SELECT substring(c_name, 10, 2) AS code, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
        GROUP BY substring(c_name, 10, 2)""",
}

# grouping, joins of every shape, set operations
SQL |= {
    "groupby_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "rollup_grouping": """
        SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + grouping(l_linestatus) AS BIGINT) AS level, round(sum(l_quantity), 2) AS qty
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "join_inner_star": "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "join_full": """
        SELECT coalesce(a.k, b.k) AS k, a.n AS a_n, b.n AS b_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 3000 GROUP BY c_nationkey) a
        FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) b ON a.k = b.k""",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
    "join_theta": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "join_residual_interval": """
        SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY""",
    "join_self": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "join_cross_scalars": "SELECT a.n AS orders, b.n AS lines FROM (SELECT count(*) AS n FROM orders) a CROSS JOIN (SELECT count(*) AS n FROM lineitem) b",
    "scalar_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)",
    "cte_twice": "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM t WHERE s > (SELECT avg(s) FROM t)",
    "union_all": "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey AS k, 's' AS side FROM supplier",
    "intersect_keys": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier",
    "except_keys": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000",
    "topk_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "order_nulls": """
        SELECT k, v FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'O') AS v FROM orders) t ORDER BY v NULLS LAST, k DESC LIMIT 50""",
    "stddev_group": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag",
    "lateral_topk": """
        SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t""",
}

# windows
SQL |= {
    "window_cumulative": """
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""",
    "window_rank": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS r FROM orders",
    "window_partition_avg": "SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS off FROM supplier",
    "window_ratio": """
        SELECT p_brand, p_type, round(100.0 * sum(p_retailprice) / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand), 6) AS pct FROM part GROUP BY p_brand, p_type""",
}

# wide-table analytics
SQL |= {
    "wide_count": "SELECT count(*) AS n FROM events",
    "wide_filter_count": "SELECT count(*) AS n FROM events WHERE event_type <> 'click'",
    "wide_sums": "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(user_id), 6) AS a, min(value) AS lo, max(value) AS hi FROM events",
    "wide_distinct": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events",
    "wide_top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "wide_user_kind": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 25",
    "wide_minute": "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY user_id, CAST(extract(minute FROM ts) AS BIGINT)",
    "wide_url_like": "SELECT count(*) AS n FROM pages WHERE url LIKE '%www%' OR url LIKE 'https%'",
    "wide_domain": """
        SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+).*$', '\\1') AS host, count(*) AS n, round(avg(length(html)), 4) AS avg_len FROM pages
        GROUP BY regexp_replace(url, '^https?://(?:www\\.)?([^/]+).*$', '\\1')""",
    "wide_case": "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM events GROUP BY 1",
    "wide_having": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 100",
    "wide_point": "SELECT user_id, value FROM events WHERE event_id = 77",
    "wide_many_sums": "SELECT " + ", ".join(f"sum(l_linenumber + {k}) AS s{k}" for k in range(20)) + " FROM lineitem",
}

# text filters
SQL |= {
    "text_lang_count": "SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang",
    "text_contains": "SELECT doc_id FROM documents WHERE text LIKE '%License%'",
    "text_prefix": "SELECT doc_id FROM documents WHERE text LIKE 'The%' AND lang = 'en'",
    "text_ilike": "SELECT doc_id FROM documents WHERE text ILIKE '%licensed under%'",
    "text_long": "SELECT doc_id, n_chars FROM documents WHERE n_chars > 5000 AND source IN ('src1', 'src2')",
    "text_urls": "SELECT page_id FROM pages WHERE html LIKE '%<h1>%' AND url NOT LIKE '%#%'",
    "text_functions": "SELECT doc_id, upper(lang) AS u, lower(source) AS l, length(text) AS n, substring(text, 1, 12) AS head, concat(lang, '-', source) AS tag FROM documents",
    "text_roles": "SELECT role, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY role",
}

# time buckets and left-join chains
SQL |= {
    "time_range": "SELECT event_id, value FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL '1' HOUR AND event_type = 'view'",
    "time_trunc": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR(10)) AS month, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "chain_left": """
        SELECT c.c_custkey, n.n_name, r.r_name, o.n AS orders FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
        LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
        ORDER BY c.c_custkey LIMIT 500""",
    "chain_nested_agg": """
        SELECT seg, count(*) AS n, round(max(total), 2) AS top FROM (
            SELECT c_mktsegment AS seg, c_custkey, sum(o_totalprice) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment, c_custkey) t GROUP BY seg""",
}


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Registers the tables that a statement names."""
    for table in TABLES:
        if re.search(rf"\b{table}\b", sql):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir, sql)
    return spark.sql(sql)


#: Where the dialects differ. Spark numbers the rows of a lateral LIMIT without their ORDER BY when a sort key isn't selected.
SPARK = {
    "wide_domain": SQL["wide_domain"].replace("'\\1'", "'$1'").replace("www\\.", "www\\\\."),
    "lateral_topk": """
        SELECT c_custkey, t.o_orderkey FROM customer JOIN (
            SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS r FROM orders) t
        ON t.o_custkey = c_custkey WHERE t.r <= 2""",
}


def queries():
    return {name: (lambda spark, sf_dir, sql=SPARK.get(name, sql): run_sql(spark, sf_dir, sql)) for name, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
