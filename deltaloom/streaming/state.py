"""State of maintained views: changes by batch in the folder of a view, which outlives its driver.

A relation's state is a base and the changes of the batches after it, each a Parquet folder partitioned by a hash of the
relation's keys. Batch n reads what was there before n and writes its own changes under its number, so a batch that is
given again replaces what it wrote, and a new driver goes on where the last one stopped. A batch reads only the
partitions of the keys that it touches; every COMPACT batches the changes are merged into a new base and dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from deltaloom.session import shared_dir, shuffles_dropped

W, PART = "_w", "_part"
#: Partitions of a state, and batches after which changes become part of the base.
PARTITIONS, COMPACT = 16, 8


def consolidate(changes: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of their weights; rows of weight 0 vanish."""
    columns = [c for c in changes.columns if c != W]
    return changes.groupBy(*columns).agg(F.sum(W).alias(W)).filter(f"{W} <> 0").select(*columns, W)


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Keys that are equal, nulls included."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def having(df: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """The rows of df whose keys, null or not, are among touched."""
    if not keys:
        return df
    named = touched.select(*[F.col(k).alias(f"_t_{k}") for k in keys])
    return df.join(named, reduce(lambda x, y: x & y, [df[k].eqNullSafe(named[f"_t_{k}"]) for k in keys]), "left_semi")


@dataclass
class At:
    """A batch of a view: its number, and the folder that holds the view's state and output."""

    spark: SparkSession
    root: str
    batch: int

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that several operators of a step read, made once; those of the batch before go."""
        path = f"{self.root}/kept/{name}"
        with shuffles_dropped(self.spark):
            rows.write.mode("overwrite").parquet(f"{path}/{self.batch}")
        Folder(self.spark, path).delete(str(self.batch - 1))
        return self.spark.read.schema(rows.schema).parquet(f"{path}/{self.batch}")


class Folder:
    """Complete tables in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.hadoop = path, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        root = self.hadoop(self.path)
        if not self.fs.exists(root):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(root) if s.isDirectory()]
        return sorted(n for n in found if self.fs.exists(self.hadoop(f"{self.path}/{n}/_SUCCESS")))

    def partitions(self, name: str) -> list[int]:
        found = [s.getPath().getName() for s in self.fs.listStatus(self.hadoop(f"{self.path}/{name}"))]
        return [int(n.partition("=")[2]) for n in found if n.startswith(f"{PART}=")]

    def delete(self, name: str) -> None:
        self.fs.delete(self.hadoop(f"{self.path}/{name}"), True)


class State:
    """The state of one relation of a view. merge: makes rows of base and changes one relation again."""

    def __init__(self, at: At, name: str, keys: list[str], schema: StructType, merge: Callable[[DataFrame], DataFrame] = consolidate, partitions: int = PARTITIONS, compact: int = COMPACT):
        self.at, self.keys, self.schema, self.merge, self.n, self.most = at, keys, schema, merge, partitions, compact
        self.folder = Folder(at.spark, f"{at.root}/state/{name}")
        self.parts: list[int] = []

    def _names(self) -> list[str]:
        """The newest base that has nothing of this batch or later ones, and the changes between."""
        number = lambda x: int(x.partition("-")[2])
        found = [x for x in self.folder.names() if number(x) < self.at.batch or (x[0] == "b" and number(x) == self.at.batch)]
        bases = [x for x in found if x.startswith("base-")]
        start = number(bases[-1]) if bases else -1
        return bases[-1:] + [x for x in found if x.startswith("changes-") and number(x) >= start]

    def _read(self, names: list[str], parts: list[int] | None = None) -> DataFrame:
        spark, whole = self.at.spark, StructType([*self.schema.fields, StructField(PART, IntegerType())])
        if not names:
            return spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, [spark.read.schema(whole).parquet(f"{self.folder.path}/{x}") for x in names])
        return (rows if parts is None else rows.filter(F.col(PART).isin(parts))).drop(PART)

    def new(self) -> bool:
        """Whether no batch before this one wrote anything."""
        return not self._names()

    def write(self, delta: DataFrame) -> DataFrame:
        """Keep the changes of this batch; gives them back as written."""
        names = self._names()
        if len(names) > self.most:
            base = f"base-{self.at.batch:09d}"
            self._write(self.merge(self._read(names)), base)
            for x in names:
                self.folder.delete(x)
        own = f"changes-{self.at.batch:09d}"
        self._write(delta, own)
        self.parts = self.folder.partitions(own)
        return self._read([own])

    def part(self) -> Column:
        return (F.pmod(F.hash(*self.keys), F.lit(self.n)) if self.keys else F.lit(0)).cast("int")

    def _write(self, rows: DataFrame, name: str) -> None:
        with shuffles_dropped(self.at.spark):
            rows.select(*[f.name for f in self.schema]).withColumn(PART, self.part()).hint("rebalance", F.col(PART)).write.mode("overwrite").partitionBy(PART).parquet(f"{self.folder.path}/{name}")

    def before(self, parts: list[int] | None = None) -> DataFrame:
        """What batches before this one left, base and changes not merged; parts: of these partitions alone."""
        return self._read(self._names(), parts)


class View:
    """A view that a step function maintains: of the changes of its inputs in a batch it makes those of its output.

    root: the view's folder; given again, to a new driver too, it goes on with the state that is there."""

    def __init__(self, spark: SparkSession, step: Callable[..., DataFrame], root: str | None = None):
        self.spark, self.step, self.root = spark, step, root or f"{shared_dir(spark)}/views/{uuid.uuid4().hex}"

    def feed(self, batch: int, *inputs: DataFrame) -> DataFrame:
        """Take a batch of changes, or the same one again; gives the changes of the output."""
        delta = self.step(At(self.spark, self.root, batch), *inputs)
        path = f"{self.root}/output/batch={batch}"
        with shuffles_dropped(self.spark):
            delta.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(delta.schema).parquet(path)

    def rows(self, schema: StructType) -> DataFrame:
        """The multiset that all output changes add up to."""
        whole = consolidate(self.spark.read.schema(schema).parquet(f"{self.root}/output/*"))
        return whole.filter(f"{W} > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(W)))).drop("_i", W)
