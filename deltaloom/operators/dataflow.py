"""User functions, and the record-at-a-time and graph operators as DataFrame programs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import staged
from deltaloom.sources.tables import dealt, parts_of, table

SET = SqlSet()


@SET.frame("udf_scalar", "SELECT n_nationkey, upper(n_name) || '!' AS shout FROM nation")
def udf_scalar(spark, sf_dir):
    shout = F.udf(lambda s: None if s is None else s.upper() + "!", "string")
    return table(spark, sf_dir, "nation").select("n_nationkey", shout("n_name").alias("shout"))


@SET.frame("udf_pandas", "SELECT s_suppkey, round(s_acctbal * 2 + 1, 4) AS x FROM supplier")
def udf_pandas(spark, sf_dir):
    @F.pandas_udf("double")
    def line(s):
        return s * 2 + 1

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(line("s_acctbal"), 4).alias("x"))


@SET.frame("udaf_avg_quantity", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
def udaf_avg_quantity(spark, sf_dir):
    # (count, sum) buffers that a delete can take back: sums of weights and of weighted values
    df = table(spark, sf_dir, "lineitem").withColumn("_w", F.lit(1))
    return df.groupBy("l_returnflag").agg(F.round(F.sum(F.col("_w") * F.col("l_quantity")) / F.sum("_w"), 6).alias("a"))


@SET.frame("udaf_sum_disc_price", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS s FROM lineitem GROUP BY l_linestatus")
def udaf_sum_disc_price(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("s"))


@SET.frame("udaf_pandas", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS width FROM nation GROUP BY n_regionkey")
def udaf_pandas(spark, sf_dir):
    import pandas as pd

    @F.pandas_udf("long")
    def width(s: pd.Series) -> int:
        return int(s.max() - s.min())

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(width("n_nationkey").alias("width"))


@SET.frame("apply_in_pandas", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS width FROM nation GROUP BY n_regionkey")
def apply_in_pandas(spark, sf_dir):
    import pandas as pd

    return table(spark, sf_dir, "nation").groupBy("n_regionkey").applyInPandas(lambda p: pd.DataFrame({"n_regionkey": [p.n_regionkey.iloc[0]], "width": [p.n_nationkey.max() - p.n_nationkey.min()]}), "n_regionkey int, width long")


@SET.frame("udtf_custom", "SELECT n_nationkey, i FROM nation, range(1, 4) r(i) WHERE i <= n_nationkey % 3")
def udtf_custom(spark, sf_dir):
    from pyspark.sql.functions import udtf

    @udtf(returnType="i bigint")
    class UpTo:
        def eval(self, n: int):
            for i in range(1, n + 1):
                yield (i,)

    spark.udtf.register("deltaloom_up_to", UpTo)
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_in")
    return spark.sql("SELECT n_nationkey, i FROM nation_in, LATERAL deltaloom_up_to(n_nationkey % 3)")


@SET.frame("map_in_pandas", "SELECT s_suppkey, s_acctbal > 0 AS pos FROM supplier")
def map_in_pandas(spark, sf_dir):
    def run(parts):
        for p in parts:
            yield p.assign(pos=p.s_acctbal > 0)[["s_suppkey", "pos"]]

    return table(spark, sf_dir, "supplier").mapInPandas(run, "s_suppkey long, pos boolean")


@SET.frame("cogroup_in_pandas", "SELECT n_nationkey AS k, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def cogroup_in_pandas(spark, sf_dir):
    import pandas as pd

    def both(a, b):
        return pd.DataFrame({"k": a.n_nationkey, "n": len(b)}) if len(a) else pd.DataFrame({"k": [], "n": []})

    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.groupBy("n_nationkey").cogroup(s.groupBy("s_nationkey")).applyInPandas(both, "k int, n long")


def edges(spark, sf_dir) -> DataFrame:
    """A two-sided graph: every part with each supplier that any order's line has it from, suppliers below zero."""
    lines = table(spark, sf_dir, "lineitem")
    return dealt(lines.select(F.col("l_partkey").cast("long").alias("src"), (-1 - F.col("l_suppkey").cast("long")).alias("dst")), "src", "dst").distinct()


def both_ways(e: DataFrame) -> DataFrame:
    """Edges and their reverse, staged; each round deals them anew, in partitions of a size that doesn't grow."""
    once = staged(e, "edges")
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return staged(dealt(once.select(ends.alias("e")).select("e.*"), "src", "dst").distinct(), "edges")


EDGES = "(SELECT DISTINCT CAST(l_partkey AS BIGINT) AS src, -1 - CAST(l_suppkey AS BIGINT) AS dst FROM lineitem)"


@SET.frame("gr_degrees", f"SELECT v, count(*) AS degree FROM (SELECT src AS v FROM {EDGES} UNION ALL SELECT dst FROM {EDGES}) t GROUP BY v")
def gr_degrees(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.select(F.col("src").alias("v")).unionAll(e.select("dst")).groupBy("v").agg(F.count("*").alias("degree"))


@SET.frame("gr_triangle_count", f"WITH e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM {EDGES} UNION SELECT src, src + 1 FROM {EDGES}) SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b")
def gr_triangle_count(spark, sf_dir):
    e = edges(spark, sf_dir)
    e = staged(dealt(e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).union(e.select("src", F.col("src") + 1)), "a", "b").distinct(), "edges")
    n = parts_of(e)
    x, y, z = (e.select(F.col("a").alias(f"{x}a"), F.col("b").alias(f"{x}b")) for x in "xyz")
    x, y = x.repartition(n, "xb"), y.repartition(n, "ya")
    return x.join(y, F.col("xb") == F.col("ya")).join(z, (F.col("za") == F.col("xa")) & (F.col("zb") == F.col("yb"))).agg(F.count("*").alias("n"))


def _spread(e: DataFrame, state: DataFrame, step) -> DataFrame:
    """Pregel by joins: messages along edges, the least one wins, until no value changes."""
    n = parts_of(e)
    while True:
        sent = e.repartition(n, "src").join(state, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), step(F.col("x")).alias("x"))
        new = staged(state.unionByName(sent).groupBy("v").agg(F.min("x").alias("x")), "pregel")
        before, after = (s.agg(F.count("*"), F.sum("x")).first() for s in (state, new))
        if before == after:
            return new
        state = new


@SET.frame("gr_connected_components", f"WITH RECURSIVE e AS (SELECT src, dst FROM {EDGES} UNION SELECT dst, src FROM {EDGES}), r AS (SELECT src AS v, src AS x FROM e UNION SELECT e.dst, r.x FROM r JOIN e ON e.src = r.v) SELECT v, min(x) AS x FROM r GROUP BY v")
def gr_connected_components(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = both_ways(e)
    return _spread(both, both.select(F.col("src").alias("v"), F.col("src").alias("x")).distinct(), lambda x: x)


# Paths without a bound on their length are beyond recursive SQL; tests hold them against a plain search.
@SET.frame("gr_shortest_paths")
def gr_shortest_paths(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = both_ways(e)
    return _spread(both, spark.range(1, 2).select(F.col("id").alias("v"), F.lit(0).cast("long").alias("x")), lambda x: x + 1)


@SET.frame("gr_page_rank")
def gr_page_rank(spark, sf_dir):
    e = staged(edges(spark, sf_dir), "edges")
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    ranks = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct().withColumn("r", F.lit(1.0))
    for _ in range(5):
        sent = e.join(out, "src").join(ranks, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("t")).agg(F.sum(F.col("r") / F.col("deg")).alias("s"))
        ranks = staged(ranks.join(sent, F.col("v") == F.col("t"), "left").select("v", (0.15 + 0.85 * F.coalesce("s", F.lit(0.0))).alias("r")), "ranks")
    return ranks.select("v", F.round("r", 6).alias("r"))


@SET.frame("gr_label_propagation")
def gr_label_propagation(spark, sf_dir):
    e = edges(spark, sf_dir)
    both = both_ways(e)
    labels = both.select(F.col("src").alias("v"), F.col("src").alias("x")).distinct()
    n = parts_of(both)
    for _ in range(4):
        sent = both.repartition(n, "src").join(labels, F.col("src") == F.col("v")).select("dst", "x")
        votes = sent.repartition(n, "dst").groupBy("dst", "x").agg(F.count("*").alias("n"))
        labels = staged(votes.groupBy(F.col("dst").alias("v")).agg(F.max(F.struct("n", F.negative("x").alias("m"))).alias("b")).select("v", F.negative("b.m").alias("x")), "labels")
    return labels


@SET.frame("word_count", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) t GROUP BY w")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
