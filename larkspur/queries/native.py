"""Queries through the library's own expressions, aggregates, scans and proofs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggs, geo, registry
from ..functions import exprs as E
from ..operators import positional
from ..plans import pruning
from ..plans.scan import ROW, RepeatedScan, ScanRequest, Selection
from ..sources import files

col, lit = E.col, E.lit
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, **columns: E.Expr) -> DataFrame:
    return df.select(*(e.bind(df).alias(n) for n, e in columns.items()))


# scans


@query("""SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
    WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24 AND l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01'""")
def scan_filter_project(spark, sf_dir):
    day = lambda y: lit(datetime.datetime(y, 1, 1), "timestamp_ntz")
    wanted = E.between(col("l_discount"), 0.05, 0.07) & (col("l_quantity") < 24.0) & E.between(col("l_shipdate"), day(1994), day(1995), high_strict=True)
    rows = ScanRequest(filter=wanted, projection={"x": col("l_extendedprice") * col("l_discount")}).run(spark, f"{sf_dir}/lineitem.parquet")
    return rows.agg(F.round(F.sum("x"), 4).alias("revenue"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) t WHERE r >= 100 AND r < 350 AND o_totalprice > 50000")
def scan_row_range(spark, sf_dir):
    request = ScanRequest(projection=["o_orderkey", "o_custkey"], filter=col("o_totalprice") > 50000.0, row_range=(100, 350))
    return request.run(spark, f"{sf_dir}/orders.parquet")


@query("SELECT c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) t WHERE r IN (3, 5, 8, 13, 144)")
def scan_select_include(spark, sf_dir):
    return ScanRequest(projection=["c_custkey"], selection=Selection((3, 5, 8, 13, 144))).run(spark, f"{sf_dir}/customer.parquet")


@query("SELECT n_nationkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) t WHERE r NOT IN (0, 7, 24)")
def scan_select_exclude(spark, sf_dir):
    return ScanRequest(projection=["n_nationkey"], selection=Selection((0, 7, 24), exclude=True)).run(spark, f"{sf_dir}/nation.parquet")


@query("SELECT event_id, value FROM events WHERE value > 90 ORDER BY event_id LIMIT 25")
def scan_ordered_limit(spark, sf_dir):
    return ScanRequest(projection=["event_id", "value"], filter=col("value") > 90.0, ordered=True, limit=25).run(spark, f"{sf_dir}/events.parquet")


@query("SELECT count(*) AS n FROM lineitem")
def scan_length_only(spark, sf_dir):
    return ScanRequest(projection=[]).run(spark, f"{sf_dir}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, 0 AS file_index, row_number() OVER (ORDER BY n_nationkey) - 1 AS file_row_number FROM nation")
def scan_provenance(spark, sf_dir):
    df = files.with_provenance(table(spark, sf_dir, "nation"))
    return df.select("n_name", F.col("file_index").cast("int").alias("file_index"), "file_row_number")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 180 AND l_quantity >= 10")
def zone_prune_scan(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    wanted = E.between(col("l_orderkey"), 100, 180) & (col("l_quantity") >= 10.0)
    zones = pruning.zone_map(df, ["l_orderkey", "l_quantity"])
    return pruning.pruned(df, zones, wanted).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS row_count, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(0 AS BIGINT) AS nulls FROM orders")
def file_statistics(spark, sf_dir):
    s = pruning.file_stats(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return s.select("row_count", F.col("o_totalprice__min").alias("low"), F.col("o_totalprice__max").alias("high"), F.col("o_totalprice__nulls").alias("nulls"))


# predicates and projections


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.03 AND l_discount < 0.05")
def between_strict(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where(E.between(col("l_discount"), 0.03, 0.05, True, True).bind(df)).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, p_size = 7 AS eq, p_size <> 7 AS ne, p_size > 7 AS gt, p_size >= 7 AS ge, p_size < 7 AS lt, p_size <= 7 AS le FROM part""")
def comparisons(spark, sf_dir):
    x = col("p_size")
    return project(table(spark, sf_dir, "part"), p_partkey=col("p_partkey"), eq=x == 7, ne=x != 7, gt=x > 7, ge=x >= 7, lt=x < 7, le=x <= 7)


@query("""SELECT doc_id, (toxic = 1) AND (quality = 1) AS both_, (toxic = 1) OR (quality = 1) AS any_, NOT (toxic = 1) AS no_
    FROM (SELECT d.doc_id, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t""")
def kleene_bool(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    a, b = col("toxic") == 1, col("quality") == 1
    return project(df, doc_id=col("doc_id"), both_=a & b, any_=a | b, no_=~a)


@query("""SELECT doc_id, toxic IS NULL AS a, toxic IS NOT NULL AS b, coalesce(toxic, -1) AS c, CASE WHEN quality = 1 THEN toxic END AS d,
    CASE WHEN quality = 0 THEN 'bad' WHEN quality = 1 THEN 'good' ELSE 'none' END AS e, CASE WHEN quality = 1 THEN 'x' ELSE 'y' END AS f
    FROM (SELECT d.doc_id, l.toxic, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t""")
def null_and_case(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q, t = col("quality"), col("toxic")
    return project(df, doc_id=col("doc_id"), a=E.is_null(t), b=E.is_not_null(t), c=E.fill_null(t, -1), d=E.mask(t, q == 1), e=E.case_when([(q == 0, "bad"), (q == 1, "good")], "none"), f=E.zip_(q == 1, "x", "y"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')")
def membership(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    inside = E.list_contains(["F", "P", None], col("o_orderstatus")) & ~E.list_contains(["1-URGENT"], col("o_orderpriority"))
    return df.where(inside.bind(df)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE value >= (SELECT max(value) - 1 FROM events)")
def dynamic_bound(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    bound = lambda: df.agg(F.max("value") - 1).first()[0]
    return df.where(E.dynamic("ge", bound, col("value")).bind(df)).select("event_id")


@query("SELECT c_custkey, c_name, c_nationkey AS nation, c_acctbal AS bal, 'x' AS tag FROM customer")
def struct_pack_get_merge(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    a = E.pack(["k", "name", "tag"], [col("c_custkey"), col("c_name"), lit("old")])
    b = E.pack(["nation", "bal", "tag"], [col("c_nationkey"), col("c_acctbal"), lit("x")])
    m = E.merge([a, b])
    return project(df, c_custkey=m["k"], c_name=m["name"], nation=m["nation"], bal=m["bal"], tag=m["tag"])


@query("SELECT s_name, s_suppkey, s_nationkey FROM supplier")
def struct_select(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    some, rest = E.select(["s_name", "s_suppkey"]), E.select_exclude(["s_name", "s_suppkey", "s_acctbal"])
    return project(df, s_name=some["s_name"], s_suppkey=some["s_suppkey"], s_nationkey=rest["s_nationkey"])


# arithmetic, casts, strings


@query("""SELECT p_partkey, p_size + 5 AS a, p_size - 9 AS b, p_size * 3 AS c, CAST(trunc((p_size - 20) / 7.0) AS INTEGER) AS d,
    CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_retailprice - 1000 > 0 THEN 'Infinity'::DOUBLE WHEN p_retailprice - 1000 < 0 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END ELSE p_retailprice - 1000 END AS e FROM part""")
def arithmetic(spark, sf_dir):
    x, y = col("p_size"), col("p_retailprice")
    df = table(spark, sf_dir, "part").withColumn("odd", (F.col("p_size") % 2).cast("double"))
    return project(df, p_partkey=col("p_partkey"), a=x + 5, b=x - 9, c=x * 3, d=(x - 20) / 7, e=(y - 1000.0) / col("odd"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS m, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
    epoch_us(o_orderdate) AS micros FROM orders""")
def casts(spark, sf_dir):
    return project(table(spark, sf_dir, "orders"), o_orderkey=col("o_orderkey"), s=E.cast(col("o_orderkey"), "string"), m=E.cast(col("o_totalprice"), "decimal(18,2)"), days=E.ext_storage(E.cast(col("o_orderdate"), "date")), micros=E.ext_storage(col("o_orderdate")))


@query("""SELECT p_partkey, p_type LIKE 'PROMO%' AS a, p_type NOT LIKE '%STEEL' AS b, p_name ILIKE '%PART%' AS c, p_name NOT ILIKE '%1%' AS d,
    contains(p_name, '_') AS e, starts_with(p_brand, 'Brand#1') AS f, ends_with(p_type, 'COPPER') AS g, strlen(p_name) AS n FROM part""")
def strings(spark, sf_dir):
    name, kind = col("p_name"), col("p_type")
    return project(table(spark, sf_dir, "part"), p_partkey=col("p_partkey"), a=E.like(kind, "PROMO%"), b=E.like(kind, "%STEEL", negated=True), c=E.like(name, "%PART%", ignore_case=True), d=E.like(name, "%1%", True, True), e=E.contains(name, "_"), f=E.prefix(col("p_brand"), "Brand#1"), g=E.suffix(kind, "COPPER"), n=E.byte_length(name))


@query("SELECT doc_id, strlen(text) AS n FROM documents")
def byte_lengths(spark, sf_dir):
    return project(table(spark, sf_dir, "documents"), doc_id=col("doc_id"), n=E.byte_length(col("text")))


# lists, variants, vectors, geometry, keys


@query("""SELECT vec_id, len(embedding) AS n, coalesce(list_contains(list_filter(v, lambda x: x IS NOT NULL), 3), false) AS has, list_sum([label, 2, label]) AS s
    FROM (SELECT *, [label, NULL, 3 + label % 2] AS v FROM embeddings) t""")
def lists(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("v", F.array("label", F.lit(None).cast("int"), 3 + F.col("label") % 2)).withColumn("w", F.array("label", F.lit(2), "label"))
    return project(df, vec_id=col("vec_id"), n=E.list_length(col("embedding")), has=E.list_contains(col("v"), 3), s=E.list_sum(col("w")))


@query("SELECT vec_id, max(x) AS high, round(sum(x), 4) AS total, count(*) AS n FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) t GROUP BY vec_id")
def list_aggregates(spark, sf_dir):
    x = F.transform("embedding", lambda v: v.cast("double"))
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", aggs.list_aggregate(x, "max").alias("high"), F.round(aggs.list_aggregate(x, "sum"), 4).alias("total"), aggs.list_aggregate(x, "count").cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS missing FROM events")
def variant_get_json(spark, sf_dir):
    v = E.json_to_variant(col("props"))
    return project(table(spark, sf_dir, "events"), event_id=col("event_id"), k=E.variant_get(v, "$.k", "bigint"), missing=E.variant_get(v, "nope[0]", "bigint"))


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"


@query(f"""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(list_inner_product(e, {_QUERY_VECTOR}), 6) AS dot, round(list_cosine_similarity(e, {_QUERY_VECTOR}), 6) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) t""")
def vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    one = df.where("vec_id = 1").select(F.col("e").alias("q"))
    df = df.crossJoin(F.broadcast(one))  # one row
    named = {"norm": E.l2_norm(col("e")), "dot": E.inner_product(col("e"), col("q")), "cosine": E.cosine_similarity(col("e"), col("q"))}
    return df.select("vec_id", *(F.round(x.bind(df), 6).alias(n) for n, x in named.items()))


@query(f"SELECT vec_id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}) > 0.2")
def vector_search(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    wanted = list(df.where("vec_id = 1").first()["e"])
    from ..functions import tensor

    return tensor.search(df, "e", wanted, 0.2).select("vec_id")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * 2.5 * i)), 3) AS x FROM embeddings")
def vector_denorm(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").withColumn("e", F.transform("embedding", lambda v: v.cast("double")))
    made = E.l2_denorm(col("e"), 2.5).bind(df)
    placed = F.transform(made, lambda v, i: v * (i + 1))  # all components, each by its place
    return df.select("vec_id", F.round(F.aggregate(placed, F.lit(0.0), lambda a, v: a + v), 3).alias("x"))


@query("""SELECT c_custkey, round(sqrt(power(c_acctbal / 100 - 30, 2) + power(c_nationkey - 12, 2)), 6) AS d,
    c_acctbal / 100 > 10 AND c_acctbal / 100 < 40 AND c_nationkey > 4.5 AND c_nationkey < 15.5 AS inside FROM customer""")
def geo_points(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("p", geo.point(F.col("c_acctbal") / 100, F.col("c_nationkey")))
    corners = [(10.0, 4.5), (40.0, 4.5), (40.0, 15.5), (10.0, 15.5), (10.0, 4.5)]
    box = F.array(F.array(*(geo.point(F.lit(x), F.lit(y)) for x, y in corners)))
    return df.select("c_custkey", F.round(geo.distance(F.col("p"), geo.point(F.lit(30.0), F.lit(12.0))), 6).alias("d"), geo.within(F.col("p"), box).alias("inside"))


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_regionkey DESC, n_name ASC) AS BIGINT) AS place FROM nation")
def row_encode_order(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    key = E.row_encode([col("n_regionkey"), col("n_name")], [True, False]).bind(df)
    from pyspark.sql import Window

    # a few dozen rows of a lookup table
    return df.select("n_nationkey", F.row_number().over(Window.orderBy(key)).cast("long").alias("place"))


# aggregates

_WITH_NULLS = "SELECT l_returnflag AS g, CASE WHEN l_linenumber > 2 THEN l_quantity END AS x, CASE WHEN l_linenumber > 2 THEN l_linenumber END AS i FROM lineitem"


@query(f"""SELECT g, round(coalesce(sum(x), 0), 2) AS s, coalesce(sum(i), 0)::BIGINT AS si, count(x) AS n, round(sum(x) / count(x), 6) AS m, min(x) AS lo, max(x) AS hi, count(*) - count(x) AS nulls,
    bool_and(x IS NULL) AS an, bool_and(x IS NOT NULL) AS ann FROM ({_WITH_NULLS}) t GROUP BY g""")
def agg_basics(spark, sf_dir):
    some = F.col("l_linenumber") > 2
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.when(some, F.col("l_quantity")).alias("x"), F.when(some, F.col("l_linenumber")).alias("i"))
    x, d = F.col("x"), T.DoubleType()
    return df.groupBy("g").agg(F.round(aggs.sum_(x, d), 2).alias("s"), aggs.sum_(F.col("i"), T.IntegerType()).alias("si"), aggs.count(x, d).alias("n"), F.round(aggs.mean(x, d), 6).alias("m"), aggs.min_(x, d).alias("lo"), aggs.max_(x, d).alias("hi"), aggs.null_count(x).alias("nulls"), aggs.all_null(x).alias("an"), aggs.all_non_null(x).alias("ann"))


@query("""SELECT 0.0::DOUBLE AS s, count(*) FILTER (l_quantity > 1e9) AS n, CAST('NaN' AS DOUBLE) AS m, true AS an, true AS ann, false AS c FROM lineitem""")
def agg_of_nothing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where("l_quantity > 1e9")
    x, d = F.col("l_quantity"), T.DoubleType()
    return df.agg(aggs.sum_(x, d).alias("s"), aggs.count(x, d).alias("n"), aggs.mean(x, d).alias("m"), aggs.all_null(x).alias("an"), aggs.all_non_null(x).alias("ann"), aggs.is_constant(x).alias("c"))


@query("""SELECT event_type, round(sum(CASE WHEN user_id % 3 <> 0 THEN value END), 2) AS s, count(CASE WHEN user_id % 3 <> 0 THEN 1 END) AS n, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS nans,
    CAST('NaN' AS DOUBLE) AS poisoned, max(CASE WHEN user_id % 3 <> 0 THEN value END) AS hi FROM events GROUP BY event_type""")
def agg_nan_policy(spark, sf_dir):
    x = F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    df, d = table(spark, sf_dir, "events").withColumn("x", x), T.DoubleType()
    x = F.col("x")
    return df.groupBy("event_type").agg(F.round(aggs.sum_(x, d), 2).alias("s"), aggs.count(x, d).alias("n"), aggs.nan_count(x).alias("nans"), aggs.sum_(x, d, "include").alias("poisoned"), aggs.max_(x, d).alias("hi"))


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS first_, arg_max(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS last_ FROM orders GROUP BY o_custkey""")
def first_last(spark, sf_dir):
    x = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(aggs.first(x, F.col("o_orderkey")).alias("first_"), aggs.last(x, F.col("o_orderkey")).alias("last_"))


@query("""SELECT o_orderstatus, min(o_orderpriority) = max(o_orderpriority) AS constant, bool_and(o_orderkey = o_custkey) AS same, bool_and(nullif(o_orderstatus, 'O') IS NOT DISTINCT FROM nullif(o_orderstatus, 'O')) AS same_nulls, left(min(o_orderpriority), 3) AS low, 8 * count(*) AS size_ FROM orders GROUP BY o_orderstatus""")
def agg_properties(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(aggs.is_constant(F.col("o_orderpriority")).alias("constant"), aggs.all_non_distinct(k, F.col("o_custkey")).alias("same"), aggs.all_non_distinct(*[F.nullif(F.col("o_orderstatus"), F.lit("O"))] * 2).alias("same_nulls"), aggs.bounded_min(F.col("o_orderpriority"), 3).alias("low"), aggs.uncompressed_size(k, T.LongType()).alias("size_"))


@query("SELECT left(max(o_orderpriority), 2) || chr(ascii(substring(max(o_orderpriority), 3, 1)) + 1) AS high FROM orders")
def bounded_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(aggs.bounded_max(F.col("o_orderpriority"), 3).alias("high"))


@query("SELECT bool_and(p IS NULL OR p < k) AS keys, bool_and(p2 IS NULL OR p2 <= c) AS customers FROM (SELECT o_orderkey AS k, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS p, o_custkey AS c, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p2 FROM orders) t")
def is_sorted(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    a = aggs.is_sorted(df.withColumn("k", F.col("o_orderkey")), "o_orderkey", "k", strict=True, chunk=1024).withColumnRenamed("is_sorted", "keys")
    b = aggs.is_sorted(df, "o_custkey", "o_orderkey", chunk=1024).withColumnRenamed("is_sorted", "customers")
    return a.crossJoin(b)  # one row each


# positions


@query("""SELECT pos, s_suppkey FROM (VALUES (0::BIGINT, 5), (1, 2), (2, 5), (3, NULL), (4, 0)) p(pos, idx)
    LEFT JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) s ON p.idx = s.r""")
def take_rows(spark, sf_dir):
    from ..plans.scan import numbered

    return positional.take(numbered(spark, [f"{sf_dir}/supplier.parquet"]), ROW, [5, 2, 5, None, 0]).select("pos", "s_suppkey")


@query("SELECT count(*) FILTER (o_orderkey < 1000) AS \"index\", bool_or(o_orderkey = 1000) AS \"found\" FROM orders")
def search_sorted(spark, sf_dir):
    return positional.search_sorted(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("""SELECT p.pos, p.side, coalesce(r.r_name, n.n_name) AS name FROM (VALUES (0::BIGINT, 'r', 4), (1, 'n', 20), (2, 'n', 3), (3, 'r', 0), (4, 'n', 20)) p(pos, side, idx)
    LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS i FROM region) r ON p.side = 'r' AND p.idx = r.i
    LEFT JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation) n ON p.side = 'n' AND p.idx = n.i""")
def interleave_rows(spark, sf_dir):
    from ..plans.scan import numbered

    a = numbered(spark, [f"{sf_dir}/region.parquet"]).select(ROW, F.lit("r").alias("side"), F.col("r_name").alias("name"))
    b = numbered(spark, [f"{sf_dir}/nation.parquet"]).select(ROW, F.lit("n").alias("side"), F.col("n_name").alias("name"))
    picks = spark.createDataFrame([(0, 0, 4), (1, 1, 20), (2, 1, 3), (3, 0, 0), (4, 1, 20)], "pos long, array_idx int, row_idx long")
    return positional.interleave([a, b], ROW, picks)


@query("""SELECT p.pos, n.n_nationkey, n.n_name FROM (VALUES (0::BIGINT, 12), (1, 3), (2, 24), (3, 12), (4, 0)) p(pos, idx)
    JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) n ON p.idx = n.r WHERE n.n_nationkey > 10""")
def dataset_take_filtered(spark, sf_dir):
    data = files.Dataset(spark, f"{sf_dir}/nation.parquet", filter=col("n_nationkey") > 10)
    return data.taken([12, 3, 24, 12, 0]).select("pos", "n_nationkey", "n_name")


@query("""SELECT c_custkey, greatest(least(c_acctbal, 5000.0), 0.0) AS held FROM customer""")
def registered_function(spark, sf_dir):
    registry.register_scalar("clamp", lambda x, low, high: F.greatest(F.least(x, high), low))
    return project(table(spark, sf_dir, "customer"), c_custkey=col("c_custkey"), held=E.call("clamp", col("c_acctbal"), 0.0, 5000.0))


@query("SELECT s_nationkey, max(s_acctbal) - min(s_acctbal) AS spread FROM supplier GROUP BY s_nationkey")
def registered_aggregate(spark, sf_dir):
    registry.register_aggregate("spread", lambda x: F.max(x) - F.min(x))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(registry.aggregate("spread", F.col("s_acctbal")).alias("spread"))


@query("SELECT count(*) AS row_count, max(l_quantity) - min(l_quantity) AS width FROM lineitem")
def statistics_expressions(spark, sf_dir):
    s = pruning.file_stats(table(spark, sf_dir, "lineitem"), ["l_quantity"])
    known = project(s, n=E.row_count(), lo=E.stat("l_quantity", "min"), hi=E.stat("l_quantity", "max"))
    return known.agg(F.sum("n").alias("row_count"), (F.max("hi") - F.min("lo")).alias("width"))


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) t WHERE (r BETWEEN 10 AND 29 OR r = 77) AND o_totalprice > 20000")
def repeated_scan(spark, sf_dir):
    scan = RepeatedScan(ScanRequest(projection=["o_orderkey"], filter=col("o_totalprice") > 20000.0), spark, (f"{sf_dir}/orders.parquet",))
    return scan.execute((10, 30)).unionByName(scan.execute((77, 78)))


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def chunk_concat(spark, sf_dir):
    return positional.concat([table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))])


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1")
def time_bucket(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    hour = F.floor(E.ext_storage(col("ts")).bind(df) / 3_600_000_000).alias("bucket")
    return df.groupBy(hour).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s"))


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
