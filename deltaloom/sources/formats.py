"""Sources and sinks: each query writes a table in a format to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import shared_dir
from deltaloom.sources.tables import table

SET = SqlSet()
SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/formats/{name}-{uuid.uuid4().hex}"


def _round_trip(fmt: str, **options: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "supplier")
        path = scratch(spark, fmt)
        df.write.format(fmt).options(**options).save(path)
        return spark.read.format(fmt).options(**options).schema(df.schema).load(path)

    return run


for fmt, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"sep": "|", "header": "true"}), ("xml", {"rowTag": "row"})):
    SET.queries[f"io_{fmt}"], SET.oracle[f"io_{fmt}"] = _round_trip(fmt, **options), SUPPLIER


@SET.frame("scan_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 40")
def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP '1998-01-01' AND l_quantity > 40").select("l_orderkey", "l_quantity")


@SET.frame("io_text", "SELECT n_name AS value FROM nation")
def io_text(spark, sf_dir):
    path = scratch(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").write.text(path)
    return spark.read.text(path)


@SET.frame("io_binary_file", "SELECT CAST(1 AS BIGINT) AS n")
def io_binary_file(spark, sf_dir):
    return spark.read.format("binaryFile").load(f"{sf_dir}/region.parquet").filter("length > 0").agg(F.count("*").alias("n"))


@SET.frame("io_partitioned", "SELECT count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation WHERE n_regionkey = 2")
def io_partitioned(spark, sf_dir):
    path = scratch(spark, "partitioned")
    table(spark, sf_dir, "nation").write.partitionBy("n_regionkey").parquet(path)
    return spark.read.parquet(path).filter("n_regionkey = 2").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@SET.frame("io_bucketed_join", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def io_bucketed_join(spark, sf_dir):
    names = []
    for source, key in (("supplier", "s_nationkey"), ("nation", "n_nationkey")):
        name = f"{source}_{uuid.uuid4().hex}"
        table(spark, sf_dir, source).write.option("path", scratch(spark, name)).bucketBy(4, key).sortBy(key).saveAsTable(name)
        names.append(name)
    s, n = (spark.table(x) for x in names)
    return s.join(n.hint("merge"), s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"))


@SET.frame("io_save_modes", "SELECT r_regionkey FROM region UNION ALL SELECT r_regionkey FROM region")
def io_save_modes(spark, sf_dir):
    path = scratch(spark, "modes")
    r = table(spark, sf_dir, "region").select("r_regionkey")
    r.limit(1).write.mode("overwrite").parquet(path)
    r.write.mode("overwrite").parquet(path)
    r.write.mode("ignore").parquet(path)
    r.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@SET.frame("io_bad_records", "SELECT * FROM (VALUES (1, NULL), (NULL, 'x,y')) t(a, bad)")
def io_bad_records(spark, sf_dir):
    path = scratch(spark, "bad")
    spark.createDataFrame([("1",), ("x,y",)], "value string").coalesce(1).write.text(path)
    found = spark.read.csv(path, schema="a INT, bad STRING", mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return found.select("a", "bad")


@SET.frame("io_insert_into", "SELECT r_regionkey, r_name FROM region")
def io_insert_into(spark, sf_dir):
    name = f"region_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (r_regionkey INT, r_name STRING) USING parquet LOCATION '{scratch(spark, name)}'")
    table(spark, sf_dir, "region").createOrReplaceTempView("region_in")
    spark.sql(f"INSERT INTO {name} SELECT r_regionkey, r_name FROM region_in")
    return spark.table(name)


@SET.frame("cmd_catalog", "SELECT CAST(1 AS BIGINT) AS views, CAST(2 AS BIGINT) AS cols")
def cmd_catalog(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceTempView("deltaloom_region_v")
    views = spark.sql("SHOW VIEWS").filter("viewName = 'deltaloom_region_v'").agg(F.count("*").alias("views"))
    cols = spark.sql("DESCRIBE deltaloom_region_v").agg(F.count("*").alias("cols"))
    return views.crossJoin(cols)


@SET.frame("cmd_cache", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cmd_cache(spark, sf_dir):
    df = table(spark, sf_dir, "nation").cache()
    return df.groupBy("n_regionkey").agg(F.count("*").alias("n"))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def kafka(spark: SparkSession, servers: str, topic: str, per_batch: int | None = None) -> DataFrame:
    """A topic as a stream from its first offsets; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return (reader.option("maxOffsetsPerTrigger", per_batch) if per_batch else reader).load()


def avro(spark: SparkSession, path: str) -> DataFrame:
    """Avro files; needs Spark's Avro package."""
    return spark.read.format("avro").load(path)
