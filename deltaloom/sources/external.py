"""More formats and their options, databases, and sources and sinks that users write in Python."""

from __future__ import annotations

import os
import uuid
import zipfile
from contextlib import closing
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import shared_dir
from deltaloom.sources.formats import jdbc, scratch
from deltaloom.sources.tables import table

SET = SqlSet()
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _written(fmt: str, **options: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "nation")
        path = scratch(spark, fmt)
        df.write.format(fmt).options(**options).save(path)
        return spark.read.format(fmt).options(**options).schema(df.schema).load(path)

    return run


for name, fmt, options in (
    ("csv_gzip", "csv", {"compression": "gzip"}),
    ("csv_quoted", "csv", {"sep": ";", "quote": "'", "quoteAll": "true", "escape": "\\", "nullValue": "-", "header": "true"}),
    ("json_gzip", "json", {"compression": "gzip", "ignoreNullFields": "false"}),
    ("json_line_sep", "json", {"lineSep": "|"}),
    ("orc_zlib", "orc", {"compression": "zlib"}),
    ("parquet_zstd", "parquet", {"compression": "zstd"}),
):
    SET.queries[f"io_{name}"], SET.oracle[f"io_{name}"] = _written(fmt, **options), NATION


@SET.frame("io_csv_infer", NATION)
def io_csv_infer(spark, sf_dir):
    path = scratch(spark, "infer")
    table(spark, sf_dir, "nation").write.csv(path, header=True)
    return spark.read.csv(path, header=True, inferSchema=True)


@SET.frame("io_json_infer", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def io_json_infer(spark, sf_dir):
    path = scratch(spark, "infer")
    table(spark, sf_dir, "nation").write.json(path)
    return spark.read.json(path)


@SET.frame("io_json_multiline", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x'), (2, 'y')) t(a, b)")
def io_json_multiline(spark, sf_dir):
    path = scratch(spark, "multiline")
    spark.createDataFrame([('[\n{"a": 1,\n"b": "x"},\n{"a": 2, "b": "y"}]',)], "value string").coalesce(1).write.text(path)
    return spark.read.json(path, multiLine=True)


@SET.frame("io_drop_malformed", "SELECT * FROM (VALUES (1), (3)) t(a)")
def io_drop_malformed(spark, sf_dir):
    path = scratch(spark, "malformed")
    spark.createDataFrame([("1",), ("two",), ("3",)], "value string").write.text(path)
    return spark.read.csv(path, schema="a INT", mode="DROPMALFORMED")


@SET.frame("io_whole_text", "SELECT CAST(1 AS BIGINT) AS files, CAST(sum(length(n_name) + 1) AS BIGINT) AS chars FROM nation")
def io_whole_text(spark, sf_dir):
    path = scratch(spark, "whole")
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.text(path)
    return spark.read.text(path, wholetext=True).agg(F.count("*").alias("files"), F.sum(F.length("value")).alias("chars"))


@SET.frame("io_merge_schema", "SELECT n_nationkey AS k, n_name AS a, CAST(NULL AS INTEGER) AS b FROM nation UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def io_merge_schema(spark, sf_dir):
    path = scratch(spark, "merge")
    n = table(spark, sf_dir, "nation")
    n.selectExpr("n_nationkey AS k", "n_name AS a").write.parquet(path)
    n.selectExpr("n_nationkey AS k", "n_regionkey AS b").write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("k", "a", "b")


@SET.frame("io_partition_pruning", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def io_partition_pruning(spark, sf_dir):
    path = scratch(spark, "pruned")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).filter("o_orderstatus = 'F' AND o_totalprice > 200000").select("o_orderkey")


@SET.frame("io_libsvm", "SELECT CAST(s_nationkey AS DOUBLE) AS label, round(s_acctbal, 2) AS x FROM supplier")
def io_libsvm(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    path = scratch(spark, "libsvm")
    df = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("double").alias("label"), "s_acctbal", F.lit(1.0).alias("one"))
    VectorAssembler(inputCols=["s_acctbal", "one"], outputCol="features").transform(df).select("label", "features").write.format("libsvm").save(path)
    found = spark.read.format("libsvm").option("numFeatures", "2").load(path)
    return found.select("label", F.round(vector_to_array("features")[0], 2).alias("x"))


@SET.frame("io_file_metadata", "SELECT count(*) AS n, true AS named FROM region")
def io_file_metadata(spark, sf_dir):
    df = table(spark, sf_dir, "region").select("r_name", "_metadata.file_name")
    return df.agg(F.count("*").alias("n"), F.bool_and(F.col("file_name") == "region.parquet").alias("named"))


@SET.frame("io_jdbc", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def io_jdbc(spark, sf_dir):
    """A table written to a database and read back over four ranges of its key, the filter pushed into its queries.

    The embedded database belongs to one process: the driver makes it in the shared folder, loads what executors wrote
    there, and packs it into an archive, which all executors read at once."""
    where = unquote(urlparse(shared_dir(spark)).path)
    if urlparse(shared_dir(spark)).scheme not in ("", "file"):
        raise ValueError("an embedded database has to be in a folder of the file system")
    name = f"deltaloom{uuid.uuid4().hex}"
    os.makedirs(f"{where}/formats", exist_ok=True)
    path = f"{where}/formats/{name}"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("S_SUPPKEY"), F.col("s_name").alias("S_NAME"), F.col("s_acctbal").alias("S_ACCTBAL"))
    written = {"url": f"jdbc:derby:{path};create=true", "dbtable": "SUPPLIER", "createTableColumnTypes": "S_NAME VARCHAR(64)", **driver}
    s.limit(0).write.format("jdbc").options(**written).mode("append").save()  # makes the table; no task opens the database
    s.write.option("escape", '"').csv(f"file://{path}-rows")
    properties = spark._jvm.java.util.Properties()
    database = spark._jvm.org.apache.derby.jdbc.EmbeddedDriver()
    with closing(database.connect(f"jdbc:derby:{path}", properties)) as connection:
        for rows in sorted(Path(f"{path}-rows").glob("part-*")):
            connection.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'SUPPLIER', '{rows}', NULL, NULL, 'UTF-8', 0)")
    try:
        database.connect(f"jdbc:derby:{path};shutdown=true", properties)
    except Py4JJavaError as e:  # so Derby says that a database is closed
        if e.java_exception.getSQLState() != "08006":
            raise
    with zipfile.ZipFile(f"{path}.jar", "w", zipfile.ZIP_STORED) as z:
        for p in sorted(Path(path).rglob("*")):
            if p.is_file() and p.suffix != ".lck":
                z.write(p, f"{name}/{p.relative_to(path)}")
    top = s.agg(F.max("S_SUPPKEY")).first()[0]
    found = jdbc(spark, f"jdbc:derby:jar:({path}.jar){name}", "SUPPLIER", partitionColumn="S_SUPPKEY", lowerBound="0", upperBound=str(top or 1), numPartitions="4", **driver)
    return found.filter("S_ACCTBAL > 0").select(F.col("S_SUPPKEY").alias("s_suppkey"), F.col("S_NAME").alias("s_name"), F.col("S_ACCTBAL").alias("s_acctbal"))


def squares_source():
    """A source of (id, square): partitions, and a lower bound on id that is taken into the plan of the scan."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThanOrEqual, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.low, self.high, self.parts = 0, int(options.get("rows", 100)), int(options.get("parts", 4))

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, GreaterThanOrEqual) and f.attribute == ("id",):
                    self.low = max(self.low, f.value)
                else:
                    yield f

        def partitions(self):
            step = -(-(self.high - self.low) // self.parts)
            return [InputPartition((i, min(i + step, self.high))) for i in range(self.low, self.high, max(step, 1))]

        def read(self, partition):
            for i in range(*partition.value):
                yield i, i * i

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "deltaloom_squares"

        def schema(self):
            return "id bigint, square bigint"

        def reader(self, schema):
            return Reader(self.options)

    return Squares


@SET.frame("ds_python_read", "SELECT range AS id, range * range AS square FROM range(40, 100)")
def ds_python_read(spark, sf_dir):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(squares_source())
    return spark.read.format("deltaloom_squares").option("rows", 100).load().filter("id >= 40")


def counter_source():
    """A stream of consecutive numbers, five a batch up to a last one; its offset is the next number."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, last):
            self.last = last

        def initialOffset(self):
            return {"next": 0}

        def read(self, start):
            end = min(start["next"] + 5, self.last)
            return iter([(i,) for i in range(start["next"], end)]), {"next": end}

        def readBetweenOffsets(self, start, end):
            return iter([(i,) for i in range(start["next"], end["next"])])

        def commit(self, end):
            pass

    class Counter(DataSource):
        @classmethod
        def name(cls):
            return "deltaloom_counter"

        def schema(self):
            return "i bigint"

        def simpleStreamReader(self, schema):
            return Reader(int(self.options.get("last", 20)))

    return Counter


@SET.frame("ds_python_stream", "SELECT range AS i FROM range(0, 20)")
def ds_python_stream(spark, sf_dir):
    spark.dataSource.register(counter_source())
    stream = spark.readStream.format("deltaloom_counter").option("last", 20).load()
    path = scratch(spark, "counter")
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("i bigint").parquet(path)


@SET.frame("st_noop_sink", "SELECT count(*) AS n FROM events")
def st_noop_sink(spark, sf_dir):
    """A sink that takes all rows and keeps none; the count is what it reports to have taken."""
    from deltaloom.streaming.native import events

    q = events(spark, sf_dir).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", scratch(spark, "noop")).start()
    q.awaitTermination()
    return spark.createDataFrame([(sum(p["numInputRows"] for p in q.recentProgress),)], "n long")
