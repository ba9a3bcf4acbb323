"""More of the relational surface: outer natural joins, hints and build sides, named windows and what is refused, keys of
several columns in subqueries, typed records, user aggregates in SQL, and graph programs with any message."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.operators.dataflow import EDGES, both_ways, edges
from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import staged
from deltaloom.sources.tables import parts_of, table, views

SET = SqlSet()

# joins
_N, _S = "(SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 20) a", "(SELECT nullif(s_nationkey, 3) AS k, s_name FROM supplier) b"
for kind in ("LEFT", "RIGHT", "FULL"):
    SET.sql(f"join_natural_{kind.lower()}", f"SELECT k, n_name, s_name FROM {_N} NATURAL {kind} JOIN {_S}", f"SELECT k, n_name, s_name FROM {_N} {kind} JOIN {_S} USING (k)")
_BODY = "s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey"
for hint in ("BROADCASTJOIN", "MAPJOIN"):
    SET.sql(f"join_hint_{hint.lower()}", f"SELECT /*+ {hint}(nation) */ {_BODY}", f"SELECT {_BODY}")


def planned(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def with_setting(spark: SparkSession, settings: dict[str, str], run: Callable[[], DataFrame]) -> DataFrame:
    """run's rows, staged while the settings hold."""
    was = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return staged(run(), "with-setting")
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@SET.frame("join_build_left", "SELECT n_name, count(*) AS n FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def join_build_left(spark, sf_dir):
    """The left side, 25 rows, is the one that is built; the plan says so."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    joined = n.hint("broadcast").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "right")
    if "BuildLeft" not in planned(joined):
        raise ValueError("the left side isn't built")
    return joined.groupBy("n_name").agg(F.count("*").alias("n"))


@SET.frame("join_skewed", "SELECT CASE WHEN o_orderkey % 10 < 7 THEN 0 ELSE o_custkey END AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = CASE WHEN o_orderkey % 10 < 7 THEN 0 ELSE o_custkey END GROUP BY 1")
def join_skewed(spark, sf_dir):
    """Seven of ten rows have one key; adaptive execution splits their partition."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB"}
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 < 7, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return with_setting(spark, settings, lambda: o.join(c, "k").groupBy("k").agg(F.count("*").alias("n")))


@SET.frame("join_skewed_salted", "SELECT CASE WHEN o_orderkey % 10 < 7 THEN 0 ELSE o_custkey END AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = CASE WHEN o_orderkey % 10 < 7 THEN 0 ELSE o_custkey END GROUP BY 1")
def join_skewed_salted(spark, sf_dir):
    """The same by salt: the hot key's rows are dealt to eight keys, and its one row of the other side is copied to each."""
    hot = F.col("k") == 0
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 < 7, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("k"))
    o = o.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("o_orderkey"), F.lit(8))).otherwise(F.lit(0)).cast("long"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return o.join(c, ["k", "salt"]).groupBy("k").agg(F.count("*").alias("n"))


#: Runs that a spilled partition has at most: a merge of runs holds a buffer of 1 MB and two of reading ahead for each.
RUNS = 32


def spill_after(rows: DataFrame, least: int = 1000) -> str:
    """Rows after which a run goes to disk: a thousand, and of larger tables so many that RUNS are enough for all rows."""
    return str(max(least, -(-rows.count() // RUNS)))


@SET.frame("join_spilling", "SELECT o_orderpriority AS k, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
def join_spilling(spark, sf_dir):
    """A merge join whose matches of a key, a fifth of all orders, go to disk beyond a thousand rows, in a bounded number
    of runs."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold": "1000", "spark.sql.sortMergeJoinExec.buffer.spill.threshold": spill_after(o)}
    keys = o.select(F.col("o_orderpriority").alias("k")).distinct()
    return with_setting(spark, settings, lambda: keys.hint("merge").join(o, F.col("o_orderpriority") == F.col("k")).groupBy("k").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s")))


# subqueries
SET.sql("sq_in_pairs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
SET.sql("sq_not_in_pairs", "SELECT p_partkey FROM part WHERE (p_brand, p_type) NOT IN (SELECT p_brand, p_type FROM part WHERE p_size > 45)")
SET.sql("sq_limit_inside", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) ORDER BY 1")
SET.sql("sort_ordinal", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 50")
SET.sql("limit_expression", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 2 * 3 + 1")
SET.sql("sq_exists_two_columns", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")


@SET.frame("sq_reused", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size < (SELECT avg(p_retailprice) FROM part)")
def sq_reused(spark, sf_dir):
    """One subquery in two places runs once; the plan says so."""
    views(spark, sf_dir, "part")
    bar = "(SELECT avg(p_retailprice) FROM part)"
    df = spark.sql(f"SELECT p_partkey FROM part WHERE p_retailprice > {bar} AND p_size < {bar}")
    df.collect()
    if "ReusedSubquery" not in planned(df):
        raise ValueError("the subquery runs twice")
    return df


def refused(spark: SparkSession, sf_dir: str, cases: dict[str, str], tables: tuple[str, ...]) -> DataFrame:
    """Each case with the class of the error that analysis gives."""
    views(spark, sf_dir, *tables)
    out = []
    for name, text in cases.items():
        try:
            spark.sql(text).schema  # noqa: B018
            out.append((name, None))
        except Exception as e:  # noqa: BLE001  any of the engine's analysis errors
            out.append((name, (e.getCondition() or "").partition(".")[0] if hasattr(e, "getCondition") else type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


_FRAMES = {
    "rows backwards": "SELECT sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM orders",
    "range of two keys": "SELECT sum(o_totalprice) OVER (ORDER BY o_orderkey, o_custkey RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM orders",
    "range without order": "SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM orders",
    "window in where": "SELECT 1 FROM orders WHERE sum(o_totalprice) OVER (ORDER BY o_orderkey) > 1",
    "rank without order": "SELECT rank() OVER (PARTITION BY o_custkey) FROM orders",
}
_WRONG = {
    "two columns of a scalar": "SELECT (SELECT n_name, n_regionkey FROM nation) AS x",
    "pairs in single values": "SELECT r_name FROM region WHERE (r_regionkey, r_name) IN (SELECT n_regionkey FROM nation)",
    "an aggregate of outer rows in where": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE sum(r_regionkey) > n_regionkey)",
    "a name that neither side has": "SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_other = r_regionkey)",
}


def _rejections(cases: dict[str, str], tables: tuple[str, ...]):
    def run(spark, sf_dir):
        return refused(spark, sf_dir, cases, tables).select("what", F.col("error").isNotNull().alias("refused"))

    return run


SET.queries["win_refused_frames"] = _rejections(_FRAMES, ("orders",))
SET.oracle["win_refused_frames"] = " UNION ALL ".join(f"SELECT '{k}' AS what, true AS refused" for k in _FRAMES)
SET.queries["sq_refused"] = _rejections(_WRONG, ("region", "nation"))
SET.oracle["sq_refused"] = " UNION ALL ".join(f"SELECT '{k}' AS what, true AS refused" for k in _WRONG)

# windows
SET.sql("win_named", """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, row_number() OVER w AS i, count(*) OVER v AS n FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey)""")
SET.sql("win_aggregates", """SELECT o_orderkey, max(o_totalprice) OVER w AS hi, min(o_totalprice) OVER w AS lo, round(var_pop(o_totalprice) OVER w, 2) AS v, round(corr(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey), 6) AS c,
array_join(array_sort(collect_set(o_orderpriority) OVER w), ',') AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        """SELECT o_orderkey, max(o_totalprice) OVER w AS hi, min(o_totalprice) OVER w AS lo, round(var_pop(o_totalprice) OVER w, 2) AS v, round(corr(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey), 6) AS c,
array_to_string(list_sort(list_distinct(list(o_orderpriority) OVER w)), ',') AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")  # fmt: skip


@SET.frame("win_spilling", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders")
def win_spilling(spark, sf_dir):
    """Partitions of a window go to disk beyond a thousand rows, in a bounded number of runs."""
    o = table(spark, sf_dir, "orders")
    settings = {"spark.sql.windowExec.buffer.in.memory.threshold": "1000", "spark.sql.windowExec.buffer.spill.threshold": spill_after(o)}
    w = Window.partitionBy("o_orderpriority")
    return with_setting(spark, settings, lambda: o.select("o_orderkey", F.row_number().over(w.orderBy("o_orderkey")).alias("i"), F.count("*").over(w).alias("n")))


@SET.frame("win_pandas", "SELECT o_orderkey, round(avg(o_totalprice) OVER w, 4) AS m, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def win_pandas(spark, sf_dir):
    """User aggregates over bounded and unbounded frames."""

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(x.mean())

    @F.pandas_udf("double")
    def total(x: pd.Series) -> float:
        return float(x.sum())

    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(mean("o_totalprice").over(w.orderBy("o_orderkey").rowsBetween(-1, 1)), 4).alias("m"), F.round(total("o_totalprice").over(w), 2).alias("s"))


# user functions and typed records
@SET.frame("udaf_in_sql", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, round(max(l_extendedprice) - min(l_extendedprice), 2) AS width FROM lineitem GROUP BY l_returnflag")
def udaf_in_sql(spark, sf_dir):
    """User aggregates that SQL texts call by name. A user's aggregate holds all rows of its group, so those of a flag are
    taken in blocks, and the blocks' results together."""

    @F.pandas_udf("double")
    def own_total(x: pd.Series) -> float:
        return float(np.asarray(x.dropna()).sum())

    @F.pandas_udf("long")
    def own_rows(x: pd.Series) -> int:
        return int(x.count())

    @F.pandas_udf("double")
    def own_mean(totals: pd.Series, rows: pd.Series) -> float:
        return float(totals.sum() / rows.sum()) if rows.sum() else float("nan")

    @F.pandas_udf("double")
    def own_high(x: pd.Series) -> float:
        return float(x.max())

    @F.pandas_udf("double")
    def own_low(x: pd.Series) -> float:
        return float(x.min())

    @F.pandas_udf("double")
    def own_width(high: pd.Series, low: pd.Series) -> float:
        return float(high.max() - low.min())

    views(spark, sf_dir, "lineitem")
    for name, own in {"total": own_total, "rows": own_rows, "mean": own_mean, "high": own_high, "low": own_low, "width": own_width}.items():
        spark.udf.register(f"deltaloom_{name}", own)
    blocks = parts_of(table(spark, sf_dir, "lineitem"))
    return spark.sql(f"""SELECT l_returnflag, round(deltaloom_mean(t, n), 6) AS a, round(deltaloom_width(high, low), 2) AS width FROM (
        SELECT l_returnflag, deltaloom_total(l_quantity) AS t, deltaloom_rows(l_quantity) AS n, deltaloom_high(l_extendedprice) AS high, deltaloom_low(l_extendedprice) AS low
        FROM (SELECT l_returnflag, l_quantity, l_extendedprice, pmod(xxhash64(l_orderkey, l_linenumber, l_partkey), {blocks}L) AS block FROM lineitem) GROUP BY l_returnflag, block) GROUP BY l_returnflag""")


@SET.frame("udf_iterator", "SELECT p_partkey, p_size * 3 AS x FROM part")
def udf_iterator(spark, sf_dir):
    """A user function that is set up once for many batches."""

    @F.pandas_udf("int")
    def tripled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        factor = 3
        for x in batches:
            yield x * factor

    return table(spark, sf_dir, "part").select("p_partkey", tripled("p_size").alias("x"))


@SET.frame("udtf_in_sql", "SELECT p_partkey, i, p_name AS name FROM part, range(0, 2) r(i) WHERE i < p_size % 3")
def udtf_in_sql(spark, sf_dir):
    """A user's table function, called laterally."""

    @F.udtf(returnType="i long, name string")
    class Copies:
        def eval(self, n: int, name: str):
            for i in range(min(n, 2)):
                yield i, name

    views(spark, sf_dir, "part")
    spark.udtf.register("deltaloom_copies", Copies)
    return spark.sql("SELECT p_partkey, i, name FROM part, LATERAL deltaloom_copies(p_size % 3, p_name)")


@SET.frame("typed_records", "SELECT n_regionkey AS k, count(*) AS n, sum(n_nationkey) AS s, avg(n_nationkey) AS a, max(n_name) AS longest FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def typed_records(spark, sf_dir):
    """Records as objects: filtered and mapped by functions, then reduced by key with typed sum, count and mean."""
    records = table(spark, sf_dir, "nation").rdd.filter(lambda r: r.n_nationkey % 2 == 0).map(lambda r: (r.n_regionkey, (1, r.n_nationkey, r.n_name)))
    merged = records.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])))
    return spark.createDataFrame(merged.map(lambda x: (x[0], x[1][0], x[1][1], x[1][1] / x[1][0], x[1][2])), "k int, n long, s long, a double, longest string")


@SET.frame("rdd_sort_by_key", "SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation")
def rdd_sort_by_key(spark, sf_dir):
    keyed = table(spark, sf_dir, "nation").rdd.map(lambda r: (r.n_name, None)).sortByKey(numPartitions=3)
    return spark.createDataFrame(keyed.zipWithIndex().map(lambda x: (x[0][0], x[1])), "n_name string, i long")


@SET.frame("rdd_same_partitioner_union", "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) t GROUP BY k")
def rdd_same_partitioner_union(spark, sf_dir):
    """Two sides dealt alike are put together and counted without another exchange."""
    a = table(spark, sf_dir, "nation").rdd.map(lambda r: (r.n_regionkey, 1)).partitionBy(4)
    b = table(spark, sf_dir, "region").rdd.map(lambda r: (r.r_regionkey, 1)).partitionBy(4)
    both = a.union(b)
    if both.getNumPartitions() != 4:
        raise ValueError("the union dealt its sides anew")
    return spark.createDataFrame(both.reduceByKey(lambda x, y: x + y, 4), "k int, n long")


@SET.frame("sort_within", "SELECT count(*) AS n, true AS rising, true AS together FROM orders")
def sort_within(spark, sf_dir):
    """DISTRIBUTE BY and SORT BY: each partition is in order and no key is in two."""
    views(spark, sf_dir, "orders")
    dealt = spark.sql("SELECT * FROM orders DISTRIBUTE BY o_custkey SORT BY o_custkey, o_orderkey")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n, rising, keys = None, 0, True, set()
        for x in batches:
            pairs = list(zip(x["o_custkey"].tolist(), x["o_orderkey"].tolist(), strict=True))
            rising = rising and pairs == sorted(pairs) and (last is None or not pairs or last <= pairs[0])
            last, n = (pairs[-1] if pairs else last), n + len(pairs)
            keys |= set(x["o_custkey"])
        yield pd.DataFrame({"n": [n], "rising": [rising], "keys": [len(keys)]})

    found = dealt.mapInPandas(check, "n long, rising boolean, keys long")
    every = table(spark, sf_dir, "orders").agg(F.countDistinct("o_custkey").alias("all"))
    return found.agg(F.sum("n").alias("n"), F.bool_and("rising").alias("rising"), F.sum("keys").alias("keys")).crossJoin(every).select("n", "rising", (F.col("keys") == F.col("all")).alias("together"))


# graph programs
def pregel(e: DataFrame, state: DataFrame, message: Column, merge: Callable[[Column], Column], accept: Column, most: int) -> DataFrame:
    """Vertices v, x and edges src, dst, w: in each round every edge sends message (over x of its source, w), merge makes
    one value of those that reach a vertex, and accept (over x and m) gives the vertex's new value. Ends when no vertex
    changes or after `most` rounds."""
    n = parts_of(e)
    for _ in range(most):
        sent = e.repartition(n, "src").join(state, F.col("src") == F.col("v")).select("dst", message.alias("m")).groupBy("dst").agg(merge(F.col("m")).alias("m"))
        after = staged(state.join(sent, F.col("v") == F.col("dst"), "left").select("v", "x", F.when(F.col("m").isNull(), F.col("x")).otherwise(accept).alias("y")), "pregel")
        state = after.select("v", F.col("y").alias("x"))
        if not after.filter(~F.col("x").eqNullSafe(F.col("y"))).take(1):
            break
    return state


@SET.frame("gr_pregel_max", f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT src AS v, src AS x FROM e UNION SELECT e.dst, r.x FROM r JOIN e ON e.src = r.v) SELECT v, max(x) AS x FROM r GROUP BY v")
def gr_pregel_max(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = both_ways(e).withColumn("w", F.lit(1))
    return pregel(both, both.select(F.col("src").alias("v"), F.col("src").alias("x")).distinct(), F.col("x"), F.max, F.greatest("x", "m"), 50)


@SET.frame("gr_pregel_sum", f"""WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), a AS (SELECT src AS v, CAST(count(*) AS BIGINT) AS x FROM e GROUP BY src)
SELECT e.dst AS v, CAST(sum(a.x) AS BIGINT) AS x FROM e JOIN a ON a.v = e.src GROUP BY e.dst""")
def gr_pregel_sum(spark, sf_dir):
    """Messages that add up: after two rounds from 1, the number of walks of two steps that end in a vertex."""
    e = edges(spark, sf_dir)
    both = both_ways(e).withColumn("w", F.lit(1))
    ones = both.select(F.col("src").alias("v")).distinct().withColumn("x", F.lit(1).cast("long"))
    return pregel(both, ones, F.col("x"), F.sum, F.col("m"), 2)


def _ranks_sql(rounds: int) -> str:
    steps = ", ".join(
        f"r{i + 1} AS (SELECT r{i}.v, 0.15 + 0.85 * coalesce(s, 0) AS r FROM r{i} LEFT JOIN (SELECT dst, sum(r / deg) AS s FROM e JOIN d USING (src) JOIN r{i} ON r{i}.v = e.src GROUP BY dst) t ON t.dst = r{i}.v)" for i in range(rounds)
    )
    return f"WITH e AS (SELECT * FROM {EDGES}), d AS (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS (SELECT v, CAST(1 AS DOUBLE) AS r FROM (SELECT src AS v FROM e UNION SELECT dst FROM e)), {steps} SELECT v, round(r, 6) AS r FROM r{rounds}"


def _labels_sql(rounds: int) -> str:
    steps = ", ".join(
        f"l{i + 1} AS (SELECT dst AS v, arg_max(-m, (n, m)) AS x FROM (SELECT dst, -x AS m, count(*) AS n FROM e JOIN l{i} ON l{i}.v = e.src GROUP BY dst, x) t GROUP BY dst)" for i in range(rounds)
    )
    return f"WITH e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), l0 AS (SELECT DISTINCT src AS v, src AS x FROM e), {steps} SELECT v, x FROM l{rounds}"


#: Fixed rounds are within SQL.
PAGE_RANK_SQL, LABELS_SQL = _ranks_sql(5), _labels_sql(4)


@SET.frame("gr_svd_plus_plus")
def gr_svd_plus_plus(spark, sf_dir):
    """Ratings of suppliers by parts from biases and two latent factors, fitted by full-gradient steps; the rows are the
    mean squared error after each step, which falls."""
    rank, rate, decay, rounds = 2, 0.3, 0.02, 6
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("i")).agg(F.avg("l_quantity").alias("y"))
    ratings = staged(lines, "ratings")
    mean = ratings.agg(F.avg("y")).first()[0] or 0.0
    start = lambda k: [F.lit(0.0).alias("b"), *[((F.pmod(F.xxhash64(F.col(k), F.lit(f)), F.lit(1000)) - 500) / 5000.0).alias(f"p{f}") for f in range(rank)]]
    users, items = (ratings.select(F.col(k).alias("k")).distinct().select("k", *start("k")) for k in "ui")
    out = []
    for step in range(rounds):
        named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
        both = ratings.join(named(users, "u"), F.col("u") == F.col("u_k")).join(named(items, "i"), F.col("i") == F.col("i_k"))
        guess = F.lit(mean) + F.col("u_b") + F.col("i_b") + sum((F.col(f"u_p{f}") * F.col(f"i_p{f}") for f in range(rank)), F.lit(0.0))
        wrong = staged(both.withColumn("e", F.col("y") - guess), "wrong")
        out.append((step, wrong.agg(F.avg(F.col("e") * F.col("e"))).first()[0]))

        def moved(mine: str, other: str) -> DataFrame:
            pull = [(F.first(f"{mine}_b") + rate * (F.avg("e") - decay * F.first(f"{mine}_b"))).alias("b")]
            pull += [(F.first(f"{mine}_p{f}") + rate * (F.avg(F.col("e") * F.col(f"{other}_p{f}")) - decay * F.first(f"{mine}_p{f}"))).alias(f"p{f}") for f in range(rank)]
            return staged(wrong.groupBy(F.col(f"{mine}_k").alias("k")).agg(*pull), "factors")

        users, items = moved("u", "i"), moved("i", "u")
    return spark.createDataFrame(out, "step int, mse double")
