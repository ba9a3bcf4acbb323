"""Streaming beyond windows: state with timeouts, outer joins, modes, sinks, restarts and progress.

Streams that keep state until a watermark passes get one closing row a year on, which moves the watermark past
all others; it is taken out of the result."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.session import shared_dir
from deltaloom.sources.tables import table
from deltaloom.streaming.native import events, finished, split_stream

SET = SqlSet()
GAP = 12 * 3600 * 1_000_000
SESSIONS = (
    "SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM "
    "(SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events) t) u GROUP BY user_id, s"
)


def closed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, and a closing row of user -1."""
    df = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    last = df.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("value"))
    return split_stream(spark, df.unionByName(last), 4, "ts")


@SET.frame("st_state_sessions", SESSIONS)
def st_state_sessions(spark, sf_dir):
    """A session ends when 12 hours pass without an event; event-time timeouts close those of silent users."""

    def step(key, parts, state):
        out = []
        if state.hasTimedOut:
            out.append(state.get)
            state.remove()
        else:
            held = state.get if state.exists else None
            for at in sorted(x for p in parts for x in p.u):
                if held and at - held[1] < GAP:
                    held = (held[0], at, held[2] + 1)
                else:
                    out += [held] if held else []
                    held = (at, at, 1)
            state.update(held)
            state.setTimeoutTimestamp((held[1] + GAP) // 1000)
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "start": [x[0] for x in out], "n": [x[2] for x in out]})

    stream = closed_events(spark, sf_dir).withWatermark("ts", "0 seconds").select("user_id", "ts", F.unix_micros("ts").alias("u"))
    found = stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, start long, n long", "start long, last long, n long", "append", "EventTimeTimeout")
    return finished(found).filter("user_id >= 0")


def _outer(spark, sf_dir, how: str) -> DataFrame:
    a = closed_events(spark, sf_dir).select(F.col("event_id").alias("a"), F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "1 day")
    b = closed_events(spark, sf_dir).select(F.col("event_id").alias("b"), "user_id", "ts").withWatermark("ts", "1 day")
    joined = a.join(b, F.expr("u = user_id AND ts > t AND ts <= t + INTERVAL 6 HOURS"), how)
    return finished(joined.select("a", "b") if how != "leftSemi" else joined.select("a"))


ON = "a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR"


@SET.frame("st_left_outer_join", f"SELECT a.event_id AS a, b.event_id AS b FROM events a LEFT JOIN events b ON {ON}")
def st_left_outer_join(spark, sf_dir):
    return _outer(spark, sf_dir, "leftOuter").filter("a >= 0")


@SET.frame("st_right_outer_join", f"SELECT a.event_id AS a, b.event_id AS b FROM events a RIGHT JOIN events b ON {ON}")
def st_right_outer_join(spark, sf_dir):
    return _outer(spark, sf_dir, "rightOuter").filter("b >= 0")


@SET.frame("st_semi_join", f"SELECT a.event_id AS a FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE {ON})")
def st_semi_join(spark, sf_dir):
    return _outer(spark, sf_dir, "leftSemi").filter("a >= 0")


def _last_whole(stream: DataFrame) -> DataFrame:
    """Complete mode: each batch gives the whole result, the last one counts."""
    spark, schema = stream.sparkSession, stream.schema
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}-whole"
    done = []

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/b={number}")
        done.append(number)

    finished(stream, each, "complete")
    return spark.read.schema(schema).parquet(f"{path}/b={max(done)}")


@SET.frame("st_complete_mode", "SELECT event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY event_type")
def st_complete_mode(spark, sf_dir):
    return _last_whole(events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("hi")))


@SET.frame("st_session", SESSIONS)
def st_session(spark, sf_dir):
    out = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return _last_whole(out.select("user_id", F.unix_micros("session_window.start").alias("start"), "n"))


@SET.frame("st_sorted_complete", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def st_sorted_complete(spark, sf_dir):
    return _last_whole(events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(5))


@SET.frame("st_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st_memory_sink(spark, sf_dir):
    name = f"memory_{uuid.uuid4().hex}"
    counts = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@SET.frame("st_limit", "SELECT CAST(10 AS BIGINT) AS n")
def st_limit(spark, sf_dir):
    return finished(events(spark, sf_dir).select("event_id").limit(10)).agg(F.count("*").alias("n"))


@SET.frame("st_union", "SELECT event_id FROM events WHERE value > 50 UNION ALL SELECT event_id FROM events WHERE value < 20")
def st_union(spark, sf_dir):
    a, b = events(spark, sf_dir), events(spark, sf_dir)
    return finished(a.filter("value > 50").select("event_id").union(b.filter("value < 20").select("event_id")))


@SET.frame("st_restart", "SELECT event_id FROM events")
def st_restart(spark, sf_dir):
    """A query that stops and goes on from its log sees each file once, those that came meanwhile as well."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "events").select("event_id")
    for part in range(3):
        df.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{base}-in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}-in")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}-log").format("parquet").option("path", base).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(base)


@SET.frame("st_progress", "SELECT count(*) AS n, CAST(4 AS BIGINT) AS batches FROM events")
def st_progress(spark, sf_dir):
    """Rows and batches as the query itself reports them."""
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = events(spark, sf_dir).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}-log").format("noop").start()
    q.awaitTermination()
    reports = [p for p in q.recentProgress if p["numInputRows"]]
    return spark.createDataFrame([(sum(p["numInputRows"] for p in reports), len(reports))], "n long, batches long")


@SET.frame("st_listener", "SELECT CAST(1 AS BIGINT) AS started, CAST(1 AS BIGINT) AS ended")
def st_listener(spark, sf_dir):
    import time

    from pyspark.sql.streaming import StreamingQueryListener

    seen = {"started": 0, "ended": 0}
    mine = f"listened_{uuid.uuid4().hex}"
    ids = set()

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            if event.name == mine:
                ids.add(event.runId)
                seen["started"] += 1

        def onQueryProgress(self, event):
            pass

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            seen["ended"] += event.runId in ids

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        events(spark, sf_dir).writeStream.queryName(mine).trigger(availableNow=True).format("noop").start().awaitTermination()
        until = time.time() + 20
        while not seen["ended"] and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(seen["started"], seen["ended"])], "started long, ended long")


@SET.frame("st_processing_time", "SELECT count(*) AS n FROM events")
def st_processing_time(spark, sf_dir):
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    q = events(spark, sf_dir).select("event_id").writeStream.trigger(processingTime="100 milliseconds").option("checkpointLocation", f"{path}-log").format("parquet").option("path", path).start()
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("event_id long").parquet(path).agg(F.count("*").alias("n"))


@SET.frame("st_foreach_writer", "SELECT CAST(sum(event_id) AS BIGINT) AS s FROM events")
def st_foreach_writer(spark, sf_dir):
    """A row writer: rows of a partition go to a sum that a counter of the job takes on."""
    total = spark.sparkContext.accumulator(0)

    class Writer:
        def open(self, partition, epoch):
            self.sum = 0
            return True

        def process(self, row):
            self.sum += row.event_id

        def close(self, error):
            if error is None:
                total.add(self.sum)

    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events(spark, sf_dir).writeStream.foreach(Writer()).trigger(availableNow=True).option("checkpointLocation", f"{path}-log").start().awaitTermination()
    return spark.createDataFrame([(total.value,)], "s long")
