"""The test tables as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str, rows: int | None = None) -> None:
    """rows: that a partition has at most, about; else a table is read as its files lie."""
    for name in names or NAMES:
        df = table(spark, sf_dir, name)
        (df if rows is None else df.repartition(parts_of(df, rows))).createOrReplaceTempView(name)


def parts_of(df: DataFrame, rows: int = 200_000) -> int:
    """Partitions of so many rows at most; no more than the session's number where a tenth of them are enough."""
    n = df.count()  # of a table from its files' footers
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-n // rows), min(usual, -(-10 * n // rows)), 1)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A table's rows by keys, in partitions whose size doesn't grow with the table; the session's number of partitions is
    fixed, and adaptive execution only makes fewer of them."""
    return df.repartition(parts_of(df), *keys)
