"""Structured Streaming operators, run to the end of a split table and read back from the sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import shared_dir
from deltaloom.sources.tables import table

SET = SqlSet()


#: Rows that a file of a split table has at most, about.
ROWS = 500_000


def split_stream(spark: SparkSession, df: DataFrame, files: int, order: str) -> DataFrame:
    """A table as a stream of so many micro-batches in the order of a column; each is a file, or of a large table several
    of ROWS rows, as one task writes and reads a file."""
    each = max(1, -(-df.count() // (files * ROWS)))
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    place = F.col(order).cast("double") if dict(df.dtypes)[order] != "timestamp" else F.unix_micros(order).cast("double")
    cuts = df.agg(F.percentile_approx(place, [i / files for i in range(1, files)]).alias("c")).first()["c"] or []
    edges = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(edges, edges[1:], strict=False):  # one after the other: a stream takes files by age
        part = df.filter((place > low) & (place <= high))
        (part.coalesce(1) if each == 1 else part.repartition(each)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", each).option("latestFirst", "false").parquet(path)


def finished(stream: DataFrame, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> DataFrame | None:
    """Run a stream over all that is there; the rows of the sink, unless a function takes the batches."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}-log")
    if each:
        writer.foreachBatch(each).start().awaitTermination()
        return None
    writer.format("parquet").option("path", base).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def _last_versions(stream: DataFrame, keys: list[str]) -> DataFrame:
    """A sink for update mode: every batch's rows with its number; the last version of each key counts."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}-updates"
    schema = stream.schema

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/b={number}")

    finished(stream, each, "update")
    rows = spark.read.parquet(path).drop("b")
    values = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("x")).select(*keys, "x.*")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_stream(spark, table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), 4, "ts")


@SET.frame("st_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st_tumbling(spark, sf_dir):
    out = events(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return _last_versions(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), ["start", "event_type"])


@SET.frame("st_sliding", "SELECT b + o * INTERVAL 1 HOUR AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR AS b FROM events) t, range(0, 2) r(o) GROUP BY 1")
def st_sliding(spark, sf_dir):
    out = events(spark, sf_dir).groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n"))
    return _last_versions(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), ["start"])


@SET.frame("st_watermark_append", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) AND time_bucket(INTERVAL 1 DAY, max(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_watermark_append(spark, sf_dir):
    out = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return finished(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"))


@SET.frame("st_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st_dedup(spark, sf_dir):
    return finished(events(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"))


@SET.frame("st_stream_static_join", "SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def st_stream_static_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return finished(events(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name"))


@SET.frame("st_interval_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")
def st_interval_join(spark, sf_dir):
    a = events(spark, sf_dir).select(F.col("event_id").alias("a"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "1 day")
    b = events(spark, sf_dir).select(F.col("event_id").alias("b"), "user_id", "ts").withWatermark("ts", "1 day")
    return finished(a.join(b, F.expr("u = user_id AND ts > t AND ts <= t + INTERVAL 6 HOURS")).select("a", "b"))


@SET.frame("st_update_mode", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY user_id")
def st_update_mode(spark, sf_dir):
    return _last_versions(events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")), ["user_id"])


@SET.frame("st_stateful", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def st_stateful(spark, sf_dir):
    """Rows are counted where they lie, so a user's function takes a few numbers of a batch instead of all its rows."""

    def together(batches):
        for x in batches:
            yield x.groupby("user_id", dropna=False, sort=False).size().rename("m").reset_index()

    def count(key, parts, state):
        n = (state.get[0] if state.exists else 0) + sum(int(p["m"].sum()) for p in parts)
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    partial = events(spark, sf_dir).select("user_id").mapInPandas(together, "user_id long, m long")
    out = partial.groupBy("user_id").applyInPandasWithState(count, "user_id long, n long", "n long", "update", "NoTimeout")
    return _last_versions(out, ["user_id"])


@SET.frame("st_foreach_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_foreach_batch(spark, sf_dir):
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}-batches"

    def each(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/b={number}")

    finished(events(spark, sf_dir), each)
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


@SET.frame("st_rate", "SELECT CAST(1 AS BIGINT) AS ok")
def st_rate(spark, sf_dir):
    name = f"rate_{uuid.uuid4().hex}"
    q = spark.readStream.format("rate").option("rowsPerSecond", 100).load().writeStream.format("memory").queryName(name).start()
    while not q.lastProgress or not spark.table(name).take(1):
        q.processAllAvailable()
    q.stop()
    return spark.table(name).agg((F.min("value") >= 0).cast("long").alias("ok"))
