"""More of the relational surface: wide-table, time-series, nested, list and
spatial analytics, and decision-support shapes. SQL for DuckDB, and for Spark
where its dialect differs."""

from __future__ import annotations

import re

from ..operators import places
from .suites import run_sql

SQL: dict[str, str] = {}
SPARK: dict[str, str] = {}


def both(name: str, duck: str, spark: str | None = None) -> None:
    SQL[name] = duck
    if spark:
        SPARK[name] = spark


# lists: lambdas, unnesting, sums (variant tables hold lists of numbers)
both("lists_lambda_sum", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS s FROM embeddings",
     "SELECT vec_id, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 4) AS s FROM embeddings")
both("lists_filter_count", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n FROM embeddings", "SELECT vec_id, CAST(size(filter(embedding, x -> x > 0)) AS BIGINT) AS n FROM embeddings")
both("lists_unnest_group", "SELECT label, count(*) AS n, round(max(x), 5) AS hi FROM (SELECT label, unnest(embedding) AS x FROM embeddings) t WHERE x > 0.1 GROUP BY label",
     "SELECT label, count(*) AS n, round(max(x), 5) AS hi FROM (SELECT label, explode(embedding) AS x FROM embeddings) t WHERE x > 0.1 GROUP BY label")
both("lists_any_above", "SELECT label, count(*) AS n FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 2.5)) > 0 GROUP BY label", "SELECT label, count(*) AS n FROM embeddings WHERE exists(embedding, x -> x > 2.5) GROUP BY label")
both("lists_element", "SELECT label, round(avg(CAST(embedding[3] AS DOUBLE)), 6) AS m FROM embeddings GROUP BY label", "SELECT label, round(avg(CAST(element_at(embedding, 3) AS DOUBLE)), 6) AS m FROM embeddings GROUP BY label")
both("lists_of_group", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
both("lists_position_range", "SELECT label, count(*) AS n, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings WHERE vec_id BETWEEN 20 AND 180 GROUP BY label")
both("string_agg_ordered", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")

# nested fields
both("nested_json_field", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS s FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 GROUP BY event_type",
     "SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS s FROM events WHERE CAST(get_json_object(props, '$.k') AS BIGINT) >= 3 GROUP BY event_type")
_ACTOR = "(SELECT event_id, struct_pack(kind := event_type, actor := struct_pack(id := user_id, score := value)) AS e FROM events) t"
_ACTOR_SPARK = "(SELECT event_id, named_struct('kind', event_type, 'actor', named_struct('id', user_id, 'score', value)) AS e FROM events) t"
for _name, _sql in {
    "nested_group": "SELECT t.e.kind AS kind, count(*) AS n FROM {} GROUP BY t.e.kind",
    "nested_filter": "SELECT event_id, t.e.actor.id AS actor FROM {} WHERE t.e.kind = 'click' AND t.e.actor.score > 50",
    "nested_deep_max": "SELECT t.e.actor.id AS actor, max(t.e.actor.score) AS top FROM {} GROUP BY t.e.actor.id HAVING count(*) > 5",
    "nested_distinct": "SELECT count(DISTINCT t.e.actor.id) AS actors FROM {} WHERE t.e.kind <> 'view'",
    "nested_top": "SELECT t.e.actor.id AS actor, count(*) AS n FROM {} GROUP BY t.e.actor.id ORDER BY n DESC, actor LIMIT 10",
}.items():
    both(_name, _sql.format(_ACTOR), _sql.format(_ACTOR_SPARK))

# time series
_BUCKET, _BUCKET_SPARK = "CAST(floor(epoch(ts) / {0}) * {0} AS BIGINT)", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 / {0}) * {0} AS BIGINT)"
for _name, _sql in {
    "series_rate": "SELECT {300} AS b, event_type, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1, 2",
    "series_users": "SELECT {3600} AS b, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "series_peak": "SELECT b, n FROM (SELECT {600} AS b, count(*) AS n FROM events GROUP BY 1) t ORDER BY n DESC, b LIMIT 5",
    "series_label_filter": "SELECT {900} AS b, max(value) AS top FROM events WHERE event_type IN ('click', 'view') AND value > 5 GROUP BY 1",
    "series_running": "SELECT b, n, CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS total FROM (SELECT {7200} AS b, count(*) AS n FROM events GROUP BY 1) t",
    "series_step": "SELECT b, n - lag(n) OVER (ORDER BY b) AS step FROM (SELECT {7200} AS b, count(*) AS n FROM events GROUP BY 1) t",
    "series_two_labels": "SELECT a.b AS b, a.n AS clicks, c.n AS views FROM (SELECT {3600} AS b, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) a JOIN (SELECT {3600} AS b, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) c ON a.b = c.b",
}.items():
    both(_name, re.sub(r"\{(\d+)\}", lambda m: _BUCKET.format(m[1]), _sql), re.sub(r"\{(\d+)\}", lambda m: _BUCKET_SPARK.format(m[1]), _sql))
both("series_first_last", "SELECT user_id, arg_min(value, ts) AS first_, arg_max(value, ts) AS last_ FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY user_id, ts) t GROUP BY user_id",
     "SELECT user_id, min_by(value, ts) AS first_, max_by(value, ts) AS last_ FROM (SELECT user_id, ts, max(value) AS value FROM events GROUP BY user_id, ts) t GROUP BY user_id")

# places: points (c_acctbal, c_nationkey), boxes, distances, nearest
both("spatial_join_boxes", """
    SELECT b.name, count(*) AS n FROM customer JOIN (VALUES ('west', 0.0, 3000.0, 0, 12), ('east', 3000.0, 9000.0, 0, 12), ('north', 0.0, 9000.0, 12, 25)) b(name, x0, x1, y0, y1)
    ON c_acctbal >= b.x0 AND c_acctbal < b.x1 AND c_nationkey >= b.y0 AND c_nationkey < b.y1 GROUP BY b.name""")
both("spatial_join_within", """
    SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey
    WHERE sqrt(power(c_acctbal - s_acctbal, 2) + power(c_nationkey - s_nationkey, 2)) <= 150""")
both("spatial_nearest", """
    SELECT c_custkey, t.s_suppkey FROM customer, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey LIMIT 3) t""")
both("spatial_extent", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS width, round(avg(c_acctbal), 4) AS centre FROM customer GROUP BY c_nationkey")

# wide tables
for _name, _sql in {
    "wide_distinct_by_kind": "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "wide_kind_stats": "SELECT event_type, round(sum(value), 2) AS s, count(*) AS c, round(avg(value), 4) AS a, count(DISTINCT user_id) AS u FROM events GROUP BY event_type",
    "wide_non_empty": "SELECT source, count(*) AS c FROM documents WHERE text <> '' GROUP BY source ORDER BY c DESC, source LIMIT 10",
    "wide_source_lang": "SELECT source, lang, count(*) AS c FROM documents WHERE lang <> '' GROUP BY source, lang ORDER BY c DESC, source, lang LIMIT 10",
    "wide_sort_text": "SELECT doc_id, source FROM documents WHERE n_chars > 100 ORDER BY source, doc_id LIMIT 10",
    "wide_sort_two": "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10",
    "wide_len_having": "SELECT source, round(avg(length(text)), 3) AS l, count(*) AS c FROM documents GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25",
    "wide_min_max_url": "SELECT min(url) AS a, max(url) AS b, count(*) AS n FROM pages WHERE url <> ''",
    "wide_offset": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 20",
    "wide_shifted_keys": "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY c DESC, user_id LIMIT 10",
    "wide_constant_key": "SELECT 1 AS one, event_type, count(*) AS c FROM events GROUP BY 1, event_type ORDER BY c DESC, event_type LIMIT 10",
    "wide_case_source": "SELECT CASE WHEN lang = 'en' AND n_chars > 1000 THEN source ELSE '' END AS src, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, src, lang LIMIT 15",
    "wide_title_and_url": "SELECT count(*) AS n FROM pages WHERE html LIKE '%title%' AND url NOT LIKE '%.google.%'",
    "wide_in_list": "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (1, 2, 3, 5, 8, 13, 21) GROUP BY user_id",
    "wide_hour": "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS h, count(*) AS n FROM events GROUP BY 1",
    "wide_days": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS d, count(*) AS n FROM events WHERE value BETWEEN 10 AND 60 GROUP BY 1",
    "wide_approx_equal": "SELECT event_id FROM events WHERE abs(value - 42) < 0.5",
    "wide_nulls": "SELECT count(*) AS n, count(nullif(event_type, 'click')) AS other FROM events",
}.items():
    both(_name, _sql)
both("wide_regex", "SELECT count(*) AS n FROM pages WHERE regexp_matches(url, '/[a-z]+[0-9]+')", "SELECT count(*) AS n FROM pages WHERE url RLIKE '/[a-z]+[0-9]+'")

# decision support
_YEAR = "CAST(extract(year FROM o_orderdate) AS BIGINT)"
for _name, _sql in {
    "ds_year_over_year": f"""WITH y AS (SELECT o_custkey AS k, {_YEAR} AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
        SELECT a.k AS k, a.y AS y, round(b.s / a.s, 6) AS growth FROM y a JOIN y b ON a.k = b.k AND b.y = a.y + 1 WHERE a.s > 0""",
    "ds_above_group_avg": """WITH r AS (SELECT o_custkey AS k, o_orderstatus AS st, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
        SELECT k, st FROM r r1 WHERE s > (SELECT avg(s) * 1.2 FROM r r2 WHERE r1.st = r2.st)""",
    "ds_bands": """SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 1000 THEN (SELECT round(avg(l_discount), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20)
        ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS band1, (SELECT count(*) FROM lineitem WHERE l_quantity > 40) AS band2""",
    "ds_exists_or": """SELECT c_nationkey, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)
        OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9500) GROUP BY c_nationkey""",
    "ds_rollup_rank": """SELECT n, p_brand, p_type, CAST(rank() OVER (PARTITION BY lvl ORDER BY n DESC, p_brand, p_type) AS BIGINT) AS r FROM (
        SELECT p_brand, p_type, count(*) AS n, grouping(p_brand) + grouping(p_type) AS lvl FROM part GROUP BY ROLLUP (p_brand, p_type)) t""",
    "ds_channels": """SELECT side, k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'c' AS side, c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey
        UNION ALL SELECT 's' AS side, s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) t GROUP BY ROLLUP (side, k)""",
    "ds_common_items": """SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 10 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45
        INTERSECT SELECT p_partkey FROM part WHERE p_size > 10) t""",
    "ds_except_items": "SELECT count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09) t",
    "ds_pivot_status": """SELECT c_mktsegment, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o
        FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "ds_moving_avg": """SELECT k, y, round(avg(s) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS m FROM (
        SELECT o_custkey AS k, """ + _YEAR + """ AS y, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) t""",
    "ds_full_cumulative": """SELECT coalesce(a.y, b.y) AS y, a.n AS an, b.n AS bn FROM (SELECT """ + _YEAR + """ AS y, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a
        FULL OUTER JOIN (SELECT """ + _YEAR + """ AS y, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.y = b.y""",
    "ds_top_per_group": """SELECT s_nationkey, s_suppkey FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) t WHERE r <= 2""",
    "ds_ship_lag": """SELECT CASE WHEN CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL '30' DAY THEN '30' WHEN CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) + INTERVAL '60' DAY THEN '60' ELSE 'more' END AS lag_, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "ds_having_scalar": "SELECT l_suppkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > (SELECT 1.1 * avg(q) FROM (SELECT sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) t)",
    "ds_dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r FROM part",
    "ds_distinct_pairs": "SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) t",
}.items():
    both(_name, _sql)


def _places(spark, sf_dir):
    """Customers as points and suppliers as sites, on the line of balances."""
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS point", "c_nationkey AS place", "c_acctbal AS at")
    return points, spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey AS key", "s_nationkey AS place", "s_acctbal AS at")


def spatial_nearest(spark, sf_dir):
    return places.nearest(*_places(spark, sf_dir), 3).toDF("c_custkey", "s_suppkey")


def spatial_join_within(spark, sf_dir):
    # within a nation the second difference is 0
    return places.within(*_places(spark, sf_dir), 150.0, "sqrt(power(p.at - s.at, 2)) <= 150").toDF("c_custkey", "s_suppkey")


def queries():
    found = {name: (lambda spark, sf_dir, sql=SPARK.get(name, sql): run_sql(spark, sf_dir, sql)) for name, sql in SQL.items()}
    return found | {"spatial_nearest": spatial_nearest, "spatial_join_within": spatial_join_within}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
