"""Joins, aggregates, windows, set operations, sorting and subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import staged
from deltaloom.sources.tables import dealt, parts_of, table

SET = SqlSet()
for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
    SET.sql(f"join_{kind.lower()}", f"SELECT c_custkey, c_acctbal, o_orderkey, o_totalprice FROM customer c {kind} JOIN orders o ON c_custkey = o_custkey")
SET.sql("join_semi", "SELECT c_custkey FROM customer c LEFT SEMI JOIN orders o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE c_custkey = o_custkey)")
SET.sql("join_anti", "SELECT c_custkey FROM customer c LEFT ANTI JOIN orders o ON c_custkey = o_custkey", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE c_custkey = o_custkey)")
SET.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
SET.sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
SET.sql("join_theta_left", "SELECT a.s_suppkey AS a, count(b.s_suppkey) AS n FROM supplier a LEFT JOIN supplier b ON a.s_acctbal < b.s_acctbal - 5000 GROUP BY a.s_suppkey")
SET.sql("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
SET.sql("join_using", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)")
SET.sql("join_self_range", "SELECT a.event_id AS a, count(b.event_id) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 DAY GROUP BY a.event_id")
for hint, name in (("BROADCAST", "broadcast"), ("SHUFFLE_HASH", "shuffle_hash"), ("MERGE", "merge"), ("SHUFFLE_REPLICATE_NL", "nested_loop")):
    body = "n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
    SET.sql(f"join_{name}", f"SELECT /*+ {hint}(nation) */ {body}", f"SELECT {body}")
SET.sql("join_in_null_aware", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -1 END FROM customer)")
SET.sql("join_null_safe", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k <=> b.k",
        "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
SET.sql("join_exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")

AGG = "l_returnflag, l_linestatus"
SET.sql("agg_basic", f"SELECT {AGG}, count(*) AS n, round(sum(l_tax), 4) AS s, round(avg(l_tax), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY {AGG}")
SET.sql("agg_distinct_multi", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_linenumber) AS l FROM lineitem GROUP BY l_returnflag")
SET.sql("agg_grouping_sets", f"SELECT {AGG}, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
SET.sql("agg_cube", f"SELECT {AGG}, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE ({AGG})")
SET.sql("agg_rollup", f"SELECT {AGG}, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP ({AGG})")
SET.sql("agg_grouping_id", f"SELECT {AGG}, CAST(grouping_id({AGG}) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE ({AGG})", f"SELECT {AGG}, CAST(grouping_id({AGG}) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY CUBE ({AGG})")
SET.sql("agg_stats", "SELECT l_returnflag, round(stddev(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(variance(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(kurtosis(l_extendedprice), 3) AS k FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(kurtosis_pop(l_extendedprice), 3) AS k FROM lineitem GROUP BY l_returnflag")
SET.sql("agg_corr_covar", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs FROM lineitem GROUP BY l_returnflag")
SET.sql("agg_percentile", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS med, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")


def percentiles(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles, interpolated, of a value's rows of each key, without gathering a key's values: rows are counted by
    value, the counts placed by ranges, and the ranks looked up where they lie."""
    counts = staged(dealt(df.filter(F.col(value).isNotNull()).select(key, value), key, value).groupBy(key, value).agg(F.count("*").alias("n")), "counts")
    placed = staged(counts.repartitionByRange(parts_of(counts), key, value).withColumn("part", F.spark_partition_id()), "placed")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, "part").agg(F.sum("n").alias("m"))
    starts = sums.select(F.col(key).alias("_k"), F.col("part").alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy(key)).alias("rows"))
    run = Window.partitionBy("part", key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("end", F.sum("n").over(run)).join(starts, F.col("part").eqNullSafe(F.col("p")) & F.col(key).eqNullSafe(F.col("_k")))
    ranked = ranked.select("_k", value, "rows", (F.col("start") + F.col("end") - F.col("n")).alias("low"), (F.col("start") + F.col("end")).alias("high"))
    found = []
    for name, p in at.items():
        place = (F.col("rows") - 1) * F.lit(p)
        under, over = (F.max(F.when((F.col("low") <= r) & (r < F.col("high")), F.col(value))) for r in (F.floor(place), F.ceil(place)))
        whole = F.max(place)
        found.append(F.when(under == over, under).otherwise((F.ceil(whole) - whole) * under + (whole - F.floor(whole)) * over).alias(name))
    keys = df.select(key).distinct()
    return keys.join(ranked.groupBy("_k").agg(*found), F.col(key).eqNullSafe(F.col("_k")), "left").select(key, *at)


@SET.frame("agg_percentile", SET.oracle["agg_percentile"])
def agg_percentile(spark, sf_dir):
    found = percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return found.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("med", "p90")])


SET.sql("agg_collect_sorted", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names, array_join(array_sort(collect_set(length(n_name))), ',') AS lens FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM unnest(list_distinct(list(length(n_name)))) AS t(x)) AS lens FROM nation GROUP BY n_regionkey")
SET.sql("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0")
SET.sql("agg_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50 AND avg(l_discount) > 0.05")


def exact_mean(c: str) -> Column:
    """A mean whose sum doesn't depend on the order of rows: eight decimals are summed exactly, and what is left of values,
    or values beyond decimals, as doubles."""
    v = F.col(c).cast("double")
    exact = F.when(F.abs(v) < 1e22, v.try_cast("decimal(38,8)"))
    rest = F.sum(F.when(exact.isNull(), v).otherwise(v - exact.cast("double")))
    return (F.coalesce(F.sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))) / F.nullif(F.count(v), F.lit(0))


@SET.frame("agg_having", SET.oracle["agg_having"])
def agg_having(spark, sf_dir):
    """Means of exactly 0.05, where the order of a floating sum would decide, aren't above it."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), exact_mean("l_discount").alias("a"))
    return groups.filter("n > 50 AND a > 0.05D").select("l_suppkey", "n")


SET.sql("agg_filter_clause", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS t FROM lineitem GROUP BY l_returnflag")
SET.sql("agg_bool_bit", "SELECT n_regionkey, bool_and(n_nationkey < 20) AS a, bool_or(n_nationkey > 20) AS o, bit_and(n_nationkey) AS ba, bit_or(n_nationkey) AS bo, bit_xor(n_nationkey) AS bx FROM nation GROUP BY n_regionkey")
SET.sql("agg_min_max_by", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS hi, min_by(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS hi, arg_min(o_orderkey, o_totalprice) AS lo FROM orders GROUP BY o_orderstatus")
SET.sql("agg_expr_keys", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(o_totalprice / 100000 AS INT) % 2 AS k, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(trunc(o_totalprice / 100000) AS INT) % 2 AS k, count(*) AS n FROM orders GROUP BY 1, 2")
SET.sql("agg_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1")
SET.sql("agg_unpivot", "SELECT s_suppkey, name, val FROM (SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS DOUBLE) AS nk FROM supplier) UNPIVOT (val FOR name IN (s_acctbal, nk))",
        "SELECT s_suppkey, 's_acctbal' AS name, s_acctbal AS val FROM supplier UNION ALL SELECT s_suppkey, 'nk', CAST(s_nationkey AS DOUBLE) FROM supplier")


@SET.frame("agg_approx_distinct")
def agg_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"), F.percentile_approx("l_quantity", 0.5).alias("m"))


ORDERED = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
WIN = {
    "rank": "CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS BIGINT)",
    "dense_rank": "CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS BIGINT)",
    "percent_rank": "round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 8)",
    "cume_dist": "round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 8)",
    "ntile": f"CAST(ntile(4) OVER ({ORDERED}) AS BIGINT)",
    "row_number": f"CAST(row_number() OVER ({ORDERED}) AS BIGINT)",
    "lead_lag": f"lead(o_totalprice, 2) OVER ({ORDERED}) - lag(o_totalprice, 1, 0.0) OVER ({ORDERED})",
    "nth_value": f"nth_value(o_orderkey, 2) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "first_last": f"first_value(o_orderkey) OVER ({ORDERED}) + last_value(o_orderkey) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "rows_frame": f"round(sum(o_totalprice) OVER ({ORDERED} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2)",
    "range_frame": "count(*) OVER (PARTITION BY o_orderstatus ORDER BY CAST(floor(o_totalprice) AS BIGINT) RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING)",
    "running_aggs": f"round(avg(o_totalprice) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING), 4)",
    "stddev": f"round(stddev_pop(o_totalprice) OVER ({ORDERED} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 3)",
}
for name, expr in WIN.items():
    SET.sql(f"win_{name}", f"SELECT o_orderkey, {expr} AS x FROM orders")


@SET.frame("win_range_frame", SET.oracle["win_range_frame"])
def win_range_frame(spark, sf_dir):
    """Rows of a frame are those up to its end without those before its start: running counts over the distinct values of
    a status, which one task holds, instead of a frame for each of its orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("long").alias("p"))
    values = o.groupBy(F.col("o_orderstatus").alias("s"), F.col("p").alias("q")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("s").orderBy("q")
    to_end, before = (F.sum("n").over(w.rangeBetween(Window.unboundedPreceding, end)) for end in (1000, -1001))
    counted = values.select("s", "q", F.when(F.col("q").isNull(), F.col("n")).otherwise(to_end - F.coalesce(before, F.lit(0))).alias("x"))  # nulls are a frame
    return o.join(counted, o.o_orderstatus.eqNullSafe(counted.s) & o.p.eqNullSafe(counted.q)).select("o_orderkey", "x")


SET.sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW) AS x FROM events")
SET.sql("win_ignore_nulls", f"SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS x FROM orders", f"SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS x FROM orders")
SET.sql("win_top_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders) t WHERE r <= 2")
SET.sql("win_of_agg", "SELECT l_suppkey, CAST(rank() OVER (ORDER BY round(sum(l_quantity), 2) DESC) AS BIGINT) AS r FROM lineitem GROUP BY l_suppkey")

NULLS = "(SELECT n_nationkey, nullif(n_regionkey, 2) AS k FROM nation)"
for direction in ("ASC", "DESC"):
    for nulls in ("FIRST", "LAST"):
        SET.sql(f"sort_{direction.lower()}_nulls_{nulls.lower()}", f"SELECT n_nationkey, CAST(row_number() OVER (ORDER BY k {direction} NULLS {nulls}, n_nationkey) AS BIGINT) AS place FROM {NULLS} t")
SET.sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
SET.sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
SET.sql("limit_all", "SELECT r_name FROM region LIMIT ALL", "SELECT r_name FROM region")
A, B = "SELECT l_suppkey % 50 AS k FROM lineitem WHERE l_quantity < 10", "SELECT CAST(s_suppkey AS BIGINT) % 70 + 20 AS k FROM supplier"
for name, op in {"union_all": "UNION ALL", "union_distinct": "UNION", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    SET.sql(name, f"({A}) {op} ({B})")
SET.sql("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


@SET.frame("drop_duplicates", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def drop_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@SET.frame("union_by_name", "SELECT c_custkey AS k, NULL::DOUBLE AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("k")), allowMissingColumns=True)


SET.sql("sq_scalar", "SELECT s_suppkey, round(s_acctbal - (SELECT avg(s_acctbal) FROM supplier), 4) AS d FROM supplier")
SET.sql("sq_correlated", "SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
SET.sql("sq_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
SET.sql("sq_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
SET.sql("sq_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)")
SET.sql("sq_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
SET.sql("sq_in_from", "SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) t GROUP BY k")
SET.sql("sq_in_case", "SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 'in' ELSE 'out' END AS w FROM supplier")
SET.sql("sq_in_having", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 2 * avg(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) x)")
SET.sql("cte", "WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT max(n) AS m FROM a) SELECT n_regionkey, n, m FROM a CROSS JOIN b")
SET.sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t")
SET.sql("lateral_join", "SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_orderkey) AS m FROM orders WHERE o_custkey = c_custkey)")

SET.sql("filter_in_like_between", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_name LIKE '%a%' AND p_size BETWEEN 5 AND 30 AND p_type IS NOT NULL")
SET.sql("project_case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, nullif(o_orderstatus, 'F') AS st FROM orders")
SET.sql("values_inline", "SELECT a, b FROM VALUES (1, 'x'), (2, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL)) AS t(a, b)")
SET.sql("range_tvf", "SELECT id FROM range(3, 30, 4)", "SELECT range AS id FROM range(3, 30, 4)")
SET.sql("lateral_explode", "SELECT vec_id, pos, col AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, col",
        "SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) t")


@SET.frame("sample_rows")
def sample_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").sample(0.1, seed=7)


@SET.frame("stat_crosstab", "SELECT o_orderstatus AS st, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY 1")
def stat_crosstab(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    c = df.groupBy("o_orderstatus").pivot("p", ["1"]).count()
    return c.select(F.col("o_orderstatus").alias("st"), F.coalesce(F.col("1"), F.lit(0)).alias("urgent"))


@SET.frame("na_fill_drop", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), -1) AS k FROM nation WHERE nullif(n_regionkey, 3) IS NOT NULL")
def na_fill_drop(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("k"), F.expr("nullif(n_regionkey, 3)").alias("m"))
    return n.na.drop(subset=["m"]).na.fill({"k": -1}).select("n_nationkey", "k")


@SET.frame("repartition_range", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM orders")
def repartition_range(spark, sf_dir):
    df = table(spark, sf_dir, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey").coalesce(3)
    return df.agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("d"))
