"""More sources, sinks and commands: writers in Python, columnar readers, images, partitioned catalogue tables, options of
formats, statistics, and what a session tells of itself."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import shared_dir, ship_package
from deltaloom.sources.commands import created, fresh
from deltaloom.sources.formats import scratch
from deltaloom.sources.tables import table, views
from deltaloom.streaming.native import finished

SET = SqlSet()
NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def hadoop_write(spark: SparkSession, path: str, content: bytes) -> None:
    """A file written by the driver through the file system that executors share."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()


class _Message(WriterCommitMessage):
    def __init__(self, rows: list):
        self.rows = rows


class TallyWriter(DataSourceWriter):
    """Counts rows and sums of the first column by task; the commit leaves one record in a folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        n = s = 0
        for row in rows:
            n, s = n + 1, s + row[0]
        return _Message([n, s])

    def commit(self, messages: list) -> None:
        done = [m.rows for m in messages if m is not None]
        with open(f"{self.path}/{uuid.uuid4().hex}.json", "w", encoding="utf-8") as f:
            json.dump({"n": sum(x[0] for x in done), "s": sum(x[1] for x in done), "tasks": len(done)}, f)

    def abort(self, messages: list) -> None:
        return None


class TallyArrowWriter(TallyWriter, DataSourceArrowWriter):
    def write(self, batches: Iterator) -> WriterCommitMessage:
        n = s = 0
        for batch in batches:
            n, s = n + len(batch), s + sum(batch.column(0).to_pylist())
        return _Message([n, s])


class TallyStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        got = [row[0] for row in rows]
        return _Message([len(got), sum(got)])

    def commit(self, messages: list, batchId: int) -> None:
        done = [m.rows for m in messages if m is not None]
        with open(f"{self.path}/{batchId}.json", "w", encoding="utf-8") as f:  # a batch that comes again replaces itself
            json.dump({"n": sum(x[0] for x in done), "s": sum(x[1] for x in done)}, f)

    def abort(self, messages: list, batchId: int) -> None:
        return None


class TallySource(DataSource):
    """A sink that keeps a tally of what was written, for batches and streams."""

    @classmethod
    def name(cls):
        return "deltaloom_tally"

    def writer(self, schema, overwrite):
        return (TallyArrowWriter if self.options.get("arrow") == "true" else TallyWriter)(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return TallyStreamWriter(self.options)


class ColumnsReader(DataSourceReader):
    """Rows as Arrow batches, one partition for each part."""

    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 100)), int(options.get("parts", 4))

    def partitions(self):
        step = -(-self.rows // self.parts)
        return [InputPartition((i, min(i + step, self.rows))) for i in range(0, self.rows, max(step, 1))]

    def read(self, partition):
        import pyarrow as pa

        low, high = partition.value
        ids = pa.array(range(low, high), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array([f"row {i}" for i in range(low, high)])], names=["id", "name"])


class ColumnsSource(DataSource):
    @classmethod
    def name(cls):
        return "deltaloom_columns"

    def schema(self):
        return "id bigint, name string"

    def reader(self, schema):
        return ColumnsReader(self.options)


def local_folder(spark: SparkSession) -> str:
    """A new shared folder that this driver can open by path, as commits in Python run in the driver's machine."""
    path = f"{shared_dir(spark)}/tally/{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path.removeprefix("file://")


def _tally(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n long, s long").json(f"file://{path}")


for kind, arrow in (("rows", "false"), ("arrow", "true")):

    def _batch(spark, sf_dir, arrow=arrow):
        ship_package(spark)
        spark.dataSource.register(TallySource)
        path = local_folder(spark)
        table(spark, sf_dir, "orders").select("o_orderkey").repartition(5).write.format("deltaloom_tally").option("path", path).option("arrow", arrow).mode("append").save()
        return _tally(spark, path)

    SET.queries[f"ds_python_write_{kind}"] = _batch
    SET.oracle[f"ds_python_write_{kind}"] = "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders"


@SET.frame("ds_python_stream_write", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events")
def ds_python_stream_write(spark, sf_dir):
    from deltaloom.streaming.native import events

    ship_package(spark)
    spark.dataSource.register(TallySource)
    path = local_folder(spark)
    q = events(spark, sf_dir).select("event_id").writeStream.format("deltaloom_tally").option("path", path).option("checkpointLocation", f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")
    q.trigger(availableNow=True).start().awaitTermination()
    return _tally(spark, path).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@SET.frame("ds_python_columns", "SELECT range AS id, 'row ' || range AS name FROM range(0, 1000)")
def ds_python_columns(spark, sf_dir):
    """Arrow batches from seven partitions; the plan reports them."""
    ship_package(spark)
    spark.dataSource.register(ColumnsSource)
    df = spark.read.format("deltaloom_columns").option("rows", 1000).option("parts", 7).load()
    if df.rdd.getNumPartitions() != 7:
        raise ValueError("the source's partitions aren't those of the scan")
    return df


def png(width: int, height: int, color: tuple[int, int, int]) -> bytes:
    """A picture of one colour."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + bytes(color) * width) * height
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@SET.frame("io_image", "SELECT r_regionkey + 2 AS width, 3 AS height, 3 AS channels, r_regionkey * 10 AS red FROM region")
def io_image(spark, sf_dir):
    """Decoded pictures: sizes, channels, and the first pixel's red, which is the last of blue, green and red."""
    path = scratch(spark, "image")
    for r in table(spark, sf_dir, "region").collect():
        hadoop_write(spark, f"{path}/{r['r_regionkey']}.png", png(r["r_regionkey"] + 2, 3, (r["r_regionkey"] * 10, 20, 30)))
    found = spark.read.format("image").load(path).select("image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return found.select("width", "height", "channels", F.conv(F.hex(F.expr("substring(data, 3, 1)")), 16, 10).cast("int").alias("red"))


# options of formats
@SET.frame("io_json_options", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey + 0.5 AS VARCHAR) AS x FROM nation")
def io_json_options(spark, sf_dir):
    """Comments, unquoted names and single quotes allowed, numbers kept as strings, and UTF-16 text."""
    path = scratch(spark, "json")
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("/* c */ {k: "), "n_nationkey", F.lit(", 'name': '"), "n_name", F.lit("', \"x\": "), (F.col("n_regionkey") + 0.5).cast("string"), F.lit("}")).alias("value"))
    raw = "\n".join(r[0] for r in lines.collect())  # 25 rows
    hadoop_write(spark, f"{path}/rows.json", raw.encode("utf-16-le"))
    return spark.read.json(path, primitivesAsString=True, allowComments=True, allowUnquotedFieldNames=True, allowSingleQuotes=True, encoding="UTF-16LE", lineSep="\n")


@SET.frame("io_json_decimals", "SELECT CAST(n_nationkey + 0.25 AS DECIMAL(4, 2)) AS x FROM nation")
def io_json_decimals(spark, sf_dir):
    path = scratch(spark, "json")
    table(spark, sf_dir, "nation").select(F.concat(F.lit('{"x": '), (F.col("n_nationkey") + 0.25).cast("string"), F.lit("}")).alias("value")).write.text(path)
    found = spark.read.json(path, prefersDecimal=True)
    if "decimal" not in found.dtypes[0][1]:
        raise ValueError("the numbers weren't read as decimals")
    return found.select(F.col("x").cast("decimal(4,2)").alias("x"))


@SET.frame("io_text_line_sep", "SELECT n_name AS value FROM nation")
def io_text_line_sep(spark, sf_dir):
    path = scratch(spark, "text")
    table(spark, sf_dir, "nation").select("n_name").write.option("lineSep", "~").text(path)
    return spark.read.text(path, lineSep="~")


@SET.frame("io_orc_merge_schema", "SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS INT) AS r FROM nation UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation")
def io_orc_merge_schema(spark, sf_dir):
    path, n = scratch(spark, "orc"), table(spark, sf_dir, "nation")
    n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.orc(f"{path}/p=1")
    n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")).write.orc(f"{path}/p=2")
    return spark.read.orc(path, mergeSchema=True).select("k", "name", "r")


@SET.frame("io_error_mode", "SELECT count(*) AS n, true AS refused FROM nation")
def io_error_mode(spark, sf_dir):
    path, n = scratch(spark, "mode"), table(spark, sf_dir, "nation")
    n.write.parquet(path)
    try:
        n.write.mode("error").parquet(path)
        refused = False
    except Exception as e:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.lit(refused).alias("refused"))


# commands
@SET.frame("cmd_partitioned_table", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 9, 1")
def cmd_partitioned_table(spark, sf_dir):
    """A table whose partitions the catalogue keeps: one added, one dropped and recovered from its files, all shown, and
    pruned by a filter."""
    name = created(spark, "k INT, r INT", "PARTITIONED BY (r)")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.insertInto(name)
    spark.sql(f"ALTER TABLE {name} DROP PARTITION (r = 2)")
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (r = 9)")
    spark.sql(f"INSERT INTO {name} PARTITION (r = 9) VALUES (99)")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    shown = spark.sql(f"SHOW PARTITIONS {name}").count()
    pruned = spark.table(name).filter("r = 1")
    if shown != spark.table(name).select("r").distinct().count() or "PartitionFilters: [isnotnull(r" not in pruned._jdf.queryExecution().executedPlan().toString():
        raise ValueError("the catalogue's partitions aren't used")
    return spark.table(name).groupBy("r").agg(F.count("*").alias("n"))


@SET.frame("cmd_analyze_partition", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def cmd_analyze_partition(spark, sf_dir):
    name = created(spark, "k INT, r INT", "PARTITIONED BY (r)")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.insertInto(name)
    spark.sql(f"ANALYZE TABLE {name} PARTITION (r = 1) COMPUTE STATISTICS")
    told = spark.sql(f"DESCRIBE EXTENDED {name} PARTITION (r = 1)").filter("col_name = 'Partition Statistics'")
    return told.select(F.regexp_extract("data_type", "([0-9]+) rows", 1).cast("long").alias("n"))


@SET.frame("cmd_reset", "SELECT 'set' AS step, 'x' AS v UNION ALL SELECT 'reset', 'none'")
def cmd_reset(spark, sf_dir):
    spark.sql("SET deltaloom.sample = x")
    first = spark.conf.get("deltaloom.sample", "none")
    spark.sql("RESET deltaloom.sample")
    return spark.createDataFrame([("set", first), ("reset", spark.conf.get("deltaloom.sample", "none"))], "step string, v string")


@SET.frame("cmd_use_database", "SELECT n_nationkey AS k FROM nation")
def cmd_use_database(spark, sf_dir):
    """A table found by its short name in the database in use, and by its long one from outside."""
    base, was = fresh("base"), spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE {base} LOCATION '{scratch(spark, 'base')}'")
    try:
        spark.sql(f"USE {base}")
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).write.saveAsTable("mine")
        inside = spark.table("mine").count()
        spark.sql(f"USE {was}")
        rows = spark.table(f"{base}.mine").collect()
    finally:
        spark.sql(f"USE {was}")
        spark.sql(f"DROP DATABASE IF EXISTS {base} CASCADE")
    return spark.createDataFrame(rows if inside == len(rows) else [], "k int")


@SET.frame("cmd_add_file", "SELECT n_nationkey, n_name || '!' AS name FROM nation")
def cmd_add_file(spark, sf_dir):
    """A file that every executor gets, listed by the session and read in a task."""
    from pyspark import SparkFiles

    path = f"{scratch(spark, 'added')}/mark-{uuid.uuid4().hex}.txt"
    hadoop_write(spark, path, b"!")
    spark.sql(f"ADD FILE '{path}'")
    name = path.rpartition("/")[2]
    if not [r for r in spark.sql("LIST FILES").collect() if r[0].endswith(name)]:
        raise ValueError("the file isn't listed")
    mark = F.udf(lambda x: x + open(SparkFiles.get(name), encoding="utf-8").read(), "string")
    return table(spark, sf_dir, "nation").select("n_nationkey", mark("n_name").alias("name"))


@SET.frame("cmd_explain_kinds", "SELECT * FROM (VALUES ('EXTENDED', true), ('CODEGEN', true), ('COST', true), ('FORMATTED', true)) t(kind, told)")
def cmd_explain_kinds(spark, sf_dir):
    views(spark, sf_dir, "orders")
    holds = {"EXTENDED": "Optimized Logical Plan", "CODEGEN": "WholeStageCodegen", "COST": "Statistics(sizeInBytes", "FORMATTED": "ReadSchema"}
    text = "SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey"
    rows = [(k, mark in spark.sql(f"EXPLAIN {k} {text}").first()[0]) for k, mark in holds.items()]
    return spark.createDataFrame(rows, "kind string, told boolean")


#: Filters of each kind that a source is handed, and how the plan shows them.
PUSHED = {
    "=": ("n_nationkey = 3", "EqualTo(n_nationkey,3)"), "<=>": ("n_nationkey <=> 3", "EqualNullSafe(n_nationkey,3)"), ">": ("n_nationkey > 3", "GreaterThan(n_nationkey,3)"), ">=": ("n_nationkey >= 3", "GreaterThanOrEqual(n_nationkey,3)"),
    "<": ("n_nationkey < 3", "LessThan(n_nationkey,3)"), "<=": ("n_nationkey <= 3", "LessThanOrEqual(n_nationkey,3)"), "in": ("n_nationkey IN (1, 2, 3)", "In(n_nationkey, [1,2,3])"), "is null": ("n_name IS NULL", "IsNull(n_name)"),
    "is not null": ("n_name IS NOT NULL", "IsNotNull(n_name)"), "or": ("n_nationkey = 1 OR n_name = 'x'", "Or(EqualTo(n_nationkey,1),EqualTo(n_name,x))"), "not": ("n_name <> 'x'", "Not(EqualTo(n_name,x))"),
    "starts": ("n_name LIKE 'NA%'", "StringStartsWith(n_name,NA)"), "ends": ("n_name LIKE '%_1'", "StringEndsWith"), "contains": ("n_name LIKE '%ION%'", "StringContains(n_name,ION)"), "and": ("n_nationkey = 1 OR (n_nationkey = 2 AND n_name = 'x')", "And(EqualTo(n_nationkey,2),EqualTo(n_name,x))"),
}


@SET.frame("cmd_pushed_filters", " UNION ALL ".join(f"SELECT '{k}' AS kind, {'false' if k == 'ends' else 'true'} AS pushed, count(*) AS n FROM nation WHERE {c.replace('<=>', 'IS NOT DISTINCT FROM')}" for k, (c, _) in PUSHED.items()))
def cmd_pushed_filters(spark, sf_dir):
    """Each kind of filter in the scan, with what it lets through (a pattern with a placeholder isn't handed on)."""
    n, rows = table(spark, sf_dir, "nation"), []
    for kind, (condition, mark) in PUSHED.items():
        df = n.filter(condition)
        rows.append((kind, mark in df._jdf.queryExecution().executedPlan().toString(), df.count()))
    return spark.createDataFrame(rows, "kind string, pushed boolean, n long")


@SET.frame("cmd_observed", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, max(o_orderkey) AS hi FROM orders")
def cmd_observed(spark, sf_dir):
    """Metrics taken by the way while another query runs."""
    from pyspark.sql import Observation

    seen = Observation()
    o = table(spark, sf_dir, "orders").observe(seen, F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.max("o_orderkey").alias("hi"))
    o.groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["s"], seen.get["hi"])], "n long, s double, hi long")


@SET.frame("cmd_clear_cache", "SELECT 2 AS held, 0 AS after")
def cmd_clear_cache(spark, sf_dir):
    views(spark, sf_dir, "region")
    names = [fresh("cached") for _ in range(2)]
    for x in names:
        spark.sql(f"CACHE TABLE {x} AS SELECT * FROM region")
    held = sum(spark.catalog.isCached(x) for x in names)
    spark.sql("CLEAR CACHE")
    return spark.createDataFrame([(held, sum(spark.catalog.isCached(x) for x in names))], "held int, after int")


@SET.frame("cmd_catalog_api", "SELECT 'n_nationkey' AS name, 'int' AS type UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def cmd_catalog_api(spark, sf_dir):
    views(spark, sf_dir, "nation")
    if not spark.catalog.tableExists("nation") or not spark.catalog.functionExists("count") or "default" not in [d.name for d in spark.catalog.listDatabases()]:
        raise ValueError("the catalogue doesn't know what is there")
    return spark.createDataFrame([(c.name, c.dataType) for c in spark.catalog.listColumns("nation")], "name string, type string")


@SET.frame("st_csv_sink", "SELECT event_id, event_type FROM events")
def st_csv_sink(spark, sf_dir):
    from deltaloom.streaming.native import events

    path = scratch(spark, "csv")
    out = events(spark, sf_dir).select("event_id", "event_type")
    out.writeStream.format("csv").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").csv(path)


@SET.frame("io_tpch_stream_loader", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def io_tpch_stream_loader(spark, sf_dir):
    """Tables loaded as streams of bar-separated text, as a loader of files would put them out."""
    out = None
    for name in ("orders", "customer", "supplier"):
        df, path = table(spark, sf_dir, name), scratch(spark, name)
        df.write.option("sep", "|").csv(path)
        stream = spark.readStream.schema(df.schema).option("sep", "|").csv(path)
        rows = finished(stream).agg(F.lit(name).alias("t"), F.count("*").alias("n"))
        out = rows if out is None else out.unionAll(rows)
    return out
