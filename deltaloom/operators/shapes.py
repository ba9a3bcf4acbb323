"""Record-at-a-time shapes as DataFrame programs: positions, sliding windows, zips, ranges, barriers, edge placement."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import staged
from deltaloom.sources.tables import table

SET = SqlSet()
LOCAL_BITS = 33  # monotonically_increasing_id: the partition above, the place within it below


def zip_with_index(df: DataFrame, *order: str, index: str = "index") -> DataFrame:
    """Gapless positions from 0 in the order of some columns, without gathering rows into one task.

    Rows are range-partitioned and sorted; a partition's start is the number of rows before it. What is broadcast
    has one row a partition. Ties fall in any order; an empty frame gives an empty frame."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = staged(placed, "indexed").withColumn("_part", F.shiftright("_at", LOCAL_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1)) + F.col("_start")
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, place.alias(index))


@SET.frame("rdd_zip_with_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders")
def rdd_zip_with_index(spark, sf_dir):
    return zip_with_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", index="i")


@SET.frame("rdd_sliding", "SELECT * FROM (SELECT row_number() OVER w - 1 AS start, round(o_totalprice + lead(o_totalprice) OVER w + lead(o_totalprice, 2) OVER w, 2) AS s FROM orders WINDOW w AS (ORDER BY o_orderkey)) t WHERE s IS NOT NULL")
def rdd_sliding(spark, sf_dir):
    """Windows of three consecutive rows: each row goes to the three windows that hold it."""
    rows = zip_with_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", index="i")
    spread = rows.select("o_totalprice", F.explode(F.sequence(F.col("i") - 2, F.col("i"))).alias("start")).filter("start >= 0")
    return spread.groupBy("start").agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.count("*").alias("n")).filter("n = 3").drop("n")


@SET.frame("rdd_zip", "SELECT n_name, s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) b USING (i)")
def rdd_zip(spark, sf_dir):
    a = zip_with_index(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    b = zip_with_index(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return a.join(b, "index").select("n_name", "s_name")


@SET.frame("rdd_subtract", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rdd_subtract(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@SET.frame("rdd_filter_by_range", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def rdd_filter_by_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").filter(F.col("o_orderkey").between(100, 900))


@SET.frame("rdd_top_by_key", "SELECT l_suppkey, l_extendedprice FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS r FROM lineitem) t WHERE r <= 3")
def rdd_top_by_key(spark, sf_dir):
    """The limit on the rank goes below the shuffle, so a task sends three rows a key at most."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"))
    ranked = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice", F.row_number().over(w).alias("r"))
    return ranked.filter("r <= 3").drop("r")


@SET.frame("rdd_fold_by_key", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '>' ORDER BY o_orderkey) AS path FROM orders GROUP BY o_custkey")
def rdd_fold_by_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    folded = F.aggregate("ks", F.lit(""), lambda s, k: F.concat(s, F.when(s == "", "").otherwise(">"), k.cast("string")))
    return orders.select("o_custkey", folded.alias("path"))


@SET.frame("rdd_partition_pruning", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey * 4 // (SELECT count(*) FROM supplier) >= 2")
def rdd_partition_pruning(spark, sf_dir):
    """Records dealt to four partitions by the range of their key; tasks run for the last two alone."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = max(rows.count(), 1)
    dealt = rows.rdd.map(lambda r: (r.s_suppkey, r.s_name)).partitionBy(4, lambda k: k * 4 // n)
    return spark.createDataFrame(spark.sparkContext.runJob(dealt, list, [2, 3]), "s_suppkey long, s_name string")


@SET.frame("rdd_barrier", "SELECT n_nationkey FROM nation")
def rdd_barrier(spark, sf_dir):
    """All tasks of the stage start together and wait for each other."""

    def meet(parts):
        from pyspark import BarrierTaskContext

        BarrierTaskContext.get().barrier()
        yield from parts

    return table(spark, sf_dir, "nation").select("n_nationkey").repartition(2).mapInPandas(meet, "n_nationkey int", barrier=True)


@SET.frame("script_transform", "SELECT CAST(n_nationkey AS VARCHAR) AS k, lower(n_name) AS name FROM nation")
def script_transform(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_in")
    return spark.sql("SELECT TRANSFORM(n_nationkey, n_name) USING 'tr A-Z a-z' AS (k STRING, name STRING) FROM nation_in")


#: Where an edge goes among n partitions; vertices are src and dst.
EDGE_STRATEGIES = {
    "source": lambda n: F.pmod(F.xxhash64("src"), F.lit(n)),
    "pair": lambda n: F.pmod(F.xxhash64("src", "dst"), F.lit(n)),
    "canonical_pair": lambda n: F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(n)),
    # a vertex's edges are in one row and one column of a square that is dealt to n, whether n is a square or not
    "grid": lambda n: F.pmod(F.pmod(F.xxhash64("src"), F.lit(math.isqrt(n - 1) + 1)) * (math.isqrt(n - 1) + 1) + F.pmod(F.xxhash64("dst"), F.lit(math.isqrt(n - 1) + 1)), F.lit(n)),
}
TANGLE = "(SELECT DISTINCT CAST(l_partkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst FROM lineitem)"


def tangle(spark, sf_dir) -> DataFrame:
    """A directed graph with cycles: from every part's key to the keys of its suppliers, which are parts' keys as well."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("src"), F.col("l_suppkey").cast("long").alias("dst")).distinct()


@SET.frame("gr_edge_partitions", f"SELECT s AS strategy, count(*) AS edges, true AS bounded FROM {TANGLE} e, (VALUES ('source'), ('pair'), ('canonical_pair'), ('grid')) v(s) GROUP BY s")
def gr_edge_partitions(spark, sf_dir):
    """Edges placed by each strategy, and whether no vertex has copies in more partitions than it allows out of 16."""
    e = tangle(spark, sf_dir)
    tables = []
    for name, where in EDGE_STRATEGIES.items():
        placed = e.withColumn("p", where(16))
        sources = placed.groupBy("src").agg(F.countDistinct("p").alias("n")).agg(F.max("n").alias("most"))
        limit = {"source": 1, "grid": 4}.get(name, 16)
        tables.append(placed.agg(F.count("*").alias("edges")).crossJoin(sources).select(F.lit(name).alias("strategy"), "edges", (F.col("most") <= limit).alias("bounded")))
    return tables[0].union(tables[1]).union(tables[2]).union(tables[3])


def _reach(e: DataFrame, state: DataFrame) -> DataFrame:
    """The greatest label that reaches each vertex along edges; state: v, x. Only vertices whose label has changed send it."""
    state = state.select("v", "x", F.lit(True).alias("moved"))
    while True:
        sent = e.join(state.filter("moved"), F.col("src") == F.col("v")).select(F.col("dst").alias("v"), "x", F.lit(None).cast("long").alias("was"))
        both = state.select("v", "x", F.col("x").alias("was")).unionByName(sent).groupBy("v").agg(F.max("x").alias("x"), F.max("was").alias("was"))
        state = staged(both.select("v", "x", (F.col("was").isNull() | (F.col("x") > F.col("was"))).alias("moved")), "reach")
        if not state.filter("moved").take(1):
            return state.drop("moved")


def strongly_connected(e: DataFrame) -> DataFrame:
    """v and the greatest vertex x of its strongly connected component; e: src, dst.

    A vertex takes the greatest vertex that reaches it as its colour; those of a colour from which its own vertex can be
    reached form a component. They leave the graph, and the rest is coloured again. Rounds: at most one a component on a
    path of components; each removes a component of every colour."""
    e = staged(e.filter("src <> dst").distinct(), "edges")
    left = staged(e.select(F.col("src").alias("v")).union(e.select("dst")).distinct(), "vertices")
    found = None
    while not left.isEmpty():
        colour = _reach(e, left.select("v", F.col("v").alias("x")))
        own = e.join(colour.select(F.col("v").alias("src"), F.col("x").alias("a")), "src").join(colour.select(F.col("v").alias("dst"), F.col("x").alias("b")), "dst").filter("a = b")
        back = staged(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "own")
        mine = fresh = colour.filter("v = x")
        while fresh.take(1):  # those that came last go on
            sent = back.join(fresh, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), "x").distinct()
            fresh = staged(sent.join(mine, ["v", "x"], "left_anti"), "component")
            mine = mine.unionByName(fresh)
        mine = staged(mine, "component")
        found = mine if found is None else found.unionByName(mine)
        left = staged(left.join(mine, "v", "left_anti"), "vertices")
        gone = mine.select("v")
        e = staged(e.join(gone, e.src == gone.v, "left_anti").join(gone, F.col("dst") == gone.v, "left_anti"), "edges")
    return found if found is not None else left.select("v", F.col("v").alias("x"))


@SET.frame(
    "gr_strongly_connected",
    f"WITH RECURSIVE e AS (SELECT src, dst FROM {TANGLE} t WHERE src <> dst), vs AS (SELECT src AS v FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT v, v FROM vs UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT f.a AS v, max(f.b) AS x FROM r f JOIN r g ON f.a = g.b AND f.b = g.a GROUP BY f.a",
)
def gr_strongly_connected(spark, sf_dir):
    return strongly_connected(tangle(spark, sf_dir))
