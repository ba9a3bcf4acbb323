"""Session factory and the two things every distributed operator needs from a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE = Path(__file__).resolve().parent

#: Settings with the meaning the query corpus was written for: nulls instead of errors, UTC, adaptive plans.
DEFAULTS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all
    tasks run in this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='deltaloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind; what they wrote needs none."""
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if was is None else spark.conf.set(SHUFFLE_CLEANUP, was)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path, partitionBy=partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(staged_table: DataFrame, part: str = "") -> None:
    """Delete a staged table that nothing reads any more, or one partition folder of it."""
    name = getattr(staged_table, "_staged_as", None)  # of tables that the catalogue knows
    if name and not part:
        staged_table.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    spark, path = staged_table.sparkSession, f"{staged_table._staged_at}/{part}".rstrip("/")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_deltaloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="deltaloom-code-")
    target = os.path.join(folder, "deltaloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    sc.addPyFile(target)
    sc._deltaloom_shipped = True
