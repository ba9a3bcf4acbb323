"""Feature, statistics and mining stages from Spark's machine-learning library, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import staged
from deltaloom.sources.tables import parts_of, table

SET = SqlSet()


@SET.frame("ml_sql_transformer", "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier WHERE s_acctbal > 0")
def ml_sql_transformer(spark, sf_dir):
    from pyspark.ml.feature import SQLTransformer

    return SQLTransformer(statement="SELECT s_suppkey, s_acctbal * 2 AS twice FROM __THIS__ WHERE s_acctbal > 0").transform(table(spark, sf_dir, "supplier"))


@SET.frame("ml_ngram", "SELECT w[i] || ' ' || w[i + 1] AS gram, count(*) AS n FROM (SELECT string_split(lower(p_name), ' ') AS w, unnest(range(1, len(string_split(p_name, ' ')))) AS i FROM part) t GROUP BY 1")
def ml_ngram(spark, sf_dir):
    from pyspark.ml.feature import NGram, Tokenizer

    words = Tokenizer(inputCol="p_name", outputCol="w").transform(table(spark, sf_dir, "part"))
    return NGram(n=2, inputCol="w", outputCol="g").transform(words).select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@SET.frame("ml_tf_idf")
def ml_tf_idf(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [Tokenizer(inputCol="p_name", outputCol="w"), HashingTF(inputCol="w", outputCol="tf", numFeatures=256), IDF(inputCol="tf", outputCol="x")]
    part = table(spark, sf_dir, "part")
    return Pipeline(stages=stages).fit(part).transform(part).select("p_partkey", F.round(F.aggregate(vector_to_array("x"), F.lit(0.0), lambda s, x: s + x), 6).alias("weight"))


def _vectors(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["l_quantity", "l_extendedprice", "l_discount"], outputCol="x").transform(table(spark, sf_dir, "lineitem"))


@SET.frame("ml_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd FROM lineitem")
def ml_correlation(spark, sf_dir):
    from pyspark.ml.stat import Correlation

    m = Correlation.corr(_vectors(spark, sf_dir), "x").first()[0].toArray()
    return spark.createDataFrame([(round(float(m[0, 1]), 6), round(float(m[0, 2]), 6))], "qp double, qd double")


@SET.frame("ml_chi_square", "SELECT CAST((SELECT count(DISTINCT l_returnflag) - 1 FROM lineitem) * (SELECT count(DISTINCT l_linenumber) - 1 FROM lineitem) AS BIGINT) AS freedom, round(sum((o - e) * (o - e) / e), 4) AS statistic FROM (SELECT coalesce(c.n, 0) AS o, f.n * g.n / (SELECT count(*) FROM lineitem) AS e FROM (SELECT l_returnflag AS a, count(*) AS n FROM lineitem GROUP BY 1) f CROSS JOIN (SELECT l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1) g LEFT JOIN (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) c ON c.a = f.a AND c.b = g.b) t")
def ml_chi_square(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    df = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").cast("double").alias("label"), "l_linenumber")
    r = ChiSquareTest.test(VectorAssembler(inputCols=["l_linenumber"], outputCol="x").transform(df), "x", "label", flatten=True).select("degreesOfFreedom", "statistic")
    return r.select(F.col("degreesOfFreedom").cast("long").alias("freedom"), F.round("statistic", 4).alias("statistic"))


@SET.frame("ml_ks_test")
def ml_ks_test(spark, sf_dir):
    from pyspark.ml.stat import KolmogorovSmirnovTest

    return KolmogorovSmirnovTest.test(table(spark, sf_dir, "events").select("value"), "value", "norm", 50.0, 30.0).select(F.round("statistic", 6).alias("statistic"))


@SET.frame("ml_min_hash_lsh")
def ml_min_hash_lsh(spark, sf_dir):
    """Pairs of parts whose name words differ by a Jaccard distance under 0.4, among those that share a hash.

    Parts of the same words are a class: classes are hashed and compared by their numbers and words alone, once each, and
    pairs of classes give those of their parts, which grow with the square of a class."""
    from pyspark.ml.feature import HashingTF, MinHashLSH, Tokenizer

    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("p_name"))
    words = Tokenizer(inputCol="p_name", outputCol="w").transform(named.select("p_name").distinct())
    x = HashingTF(inputCol="w", outputCol="x", binary=True, numFeatures=1 << 16).transform(words)
    places = F.udf(lambda v: sorted(int(i) for i in v.indices), "array<int>")
    texts = staged(x.select("p_name", "x", places("x").alias("i")), "texts")
    classes = texts.groupBy("i").agg(F.min("p_name").alias("p_name"))
    model = MinHashLSH(inputCol="x", outputCol="h", numHashTables=4, seed=7).fit(texts)
    hashes = F.udf(lambda h: [float(v[0]) for v in h], "array<double>")
    hashed = staged(model.transform(classes.join(texts.drop("i"), "p_name")).select(F.col("p_name").alias("c"), "i", hashes("h").alias("h")), "classes")
    spread = hashed.select("c", "i", F.posexplode("h").alias("t", "v")).repartition(parts_of(hashed, 100), "t", "v")
    a, b = (spread.select(F.col("c").alias(f"c{n}"), F.col("i").alias(f"i{n}"), "t", "v") for n in "ab")
    both = F.size(F.array_intersect("ia", "ib"))
    d = 1 - both / (F.size("ia") + F.size("ib") - both)
    near = a.join(b, ["t", "v"]).filter("ca < cb").select("ca", "cb", d.alias("d")).filter("d < 0.4D").distinct()
    near = near.unionByName(hashed.select(F.col("c").alias("ca"), F.col("c").alias("cb"), F.lit(0.0).alias("d")))
    class_of = texts.join(classes.withColumnRenamed("p_name", "c"), "i").select("p_name", "c")
    parts = staged(named.join(class_of, "p_name").select("c", "p_partkey").distinct(), "members")
    n = parts_of(parts, 20_000)  # a task's pairs are its parts times those of their classes
    left, right = (parts.select(F.col("c").alias(f"c{x}"), F.col("p_partkey").alias(x)).repartition(n, f"c{x}") for x in "ab")
    pairs = left.join(near, "ca").join(right, "cb").filter("ca <> cb AND a <> b OR a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("d", 6).alias("d"))


@SET.frame("ml_prefix_span", "WITH s AS (SELECT DISTINCT user_id, event_type, ts, event_id FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM events), f AS (SELECT event_type AS p, count(DISTINCT user_id) AS freq FROM s GROUP BY 1 UNION ALL SELECT a.event_type || '>' || b.event_type, count(DISTINCT a.user_id) FROM s a JOIN s b ON a.user_id = b.user_id AND (a.ts, a.event_id) < (b.ts, b.event_id) GROUP BY 1) SELECT p AS pattern, freq FROM f, n WHERE freq >= ceil(0.5 * n)")
def ml_prefix_span(spark, sf_dir):
    """Sequences of up to two event types that half of the users show in this order."""
    from pyspark.ml.fpm import PrefixSpan

    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    sequences = per.select(F.transform("e", lambda x: F.array(x.event_type)).alias("sequence"))
    found = PrefixSpan(minSupport=0.5, maxPatternLength=2).findFrequentSequentialPatterns(sequences)
    single = F.size(F.flatten("sequence")) == F.size("sequence")
    return found.filter(single).select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), "freq")


@SET.frame("ml_power_iteration")
def ml_power_iteration(spark, sf_dir):
    from pyspark.ml.clustering import PowerIterationClustering

    ring = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 5) % 25).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    return PowerIterationClustering(k=2, maxIter=5, weightCol="weight").assignClusters(ring).select("id", "cluster")


@SET.frame("ml_matrix_factors")
def ml_matrix_factors(spark, sf_dir):
    """Latent factors of customers and priorities fitted to mean prices by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("int").alias("user"), F.substring("o_orderpriority", 1, 1).cast("int").alias("item")).agg((F.avg("o_totalprice") / 100000).alias("rating"))
    return ALS(rank=4, maxIter=3, seed=1, coldStartStrategy="drop").fit(o).transform(o).select("user", "item", F.round("prediction", 2).alias("p"))
