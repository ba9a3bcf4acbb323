"""Sharding by longest-processing-time scheduling (LPT).

Rows that must stay together form a group. Groups go to the least-loaded shard, largest first, through a heap.
Groups of one size are interchangeable, so the driver schedules sizes with their counts: the heap says how many
groups of a size each shard gets, many at a time where it would go round all shards, and a group's number among
those of its size tells its shard. The loads are those of scheduling every group by itself. n bytes in all have at
most sqrt(2 * n) distinct sizes; that bounds what the driver holds (14 million numbers for 100 TB, if every size
occurred).

Defined results: a null text counts as empty and groups with empty texts; a group that is null is a group; equal rows
are of one group and get slots of their own; an empty table gives no rows; columns other than the id and the text are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.session import staged
from deltaloom.sources.tables import table

#: Rows that one task numbers, about.
SLOT_ROWS = 250_000


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """Sizes with their counts to how many groups of the size each shard gets; equally loaded shards by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, count in sorted(sizes, reverse=True):
        given = out[size] = [0] * shards
        while count:
            if count >= shards and max(heap)[0] - heap[0][0] < size:  # the next pops take each shard once
                rounds = count // shards
                heap = [(load + rounds * size, s) for load, s in heap]
                given[:] = [n + rounds for n in given]
                count -= rounds * shards
                continue
            load, s = heapq.heappop(heap)
            n = count
            if heap and size:  # as many as it takes while it is still the least loaded
                n = min(count, 1 + max(0, heap[0][0] - load - (s > heap[0][1])) // size)
            given[s] += n
            count -= n
            heapq.heappush(heap, (load + n * size, s))
    return out


def numbered(rows: DataFrame, by: list[str], order: list[str], n_rows: int, name: str) -> DataFrame:
    """rows with one more column: 0, 1, ... among the rows that agree in `by`.

    Rows are numbered in buckets of about SLOT_ROWS, and each bucket starts where the buckets before it end, so rows
    that all agree in `by` still go to many tasks.
    """
    buckets = max(32, n_rows // SLOT_ROWS)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        dealt.withColumn("_place", place)
        .join(starts, [*by, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_bucket", "_place", "_start")
    )


def with_shards(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """rows with a column shard; rows of a group get the same one."""
    groups = staged(rows.groupBy(F.col(group).alias("_group")).agg(F.sum(size).alias("_bytes")), "groups")
    sizes = [tuple(r) for r in groups.groupBy("_bytes").count().collect()]
    given = schedule(sizes, shards)
    cuts = [(s, list(accumulate(n[:-1]))) for s, n in given.items()]
    of_size = rows.sparkSession.createDataFrame(cuts, "_bytes long, _cuts array<long>")
    known = numbered(groups, ["_bytes"], ["_group"], sum(n for _, n in sizes), "_number").join(of_size, "_bytes")
    placed = known.select("_group", F.size(F.filter("_cuts", lambda c: c <= F.col("_number"))).alias("shard"))
    return rows.join(placed, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes, equal texts together."""
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("text_key"),
        ),
        "shard-rows",
    )
    placed = with_shards(rows, "text_key", "size", 8)
    slotted = numbered(placed, ["shard"], ["doc_id", "text_key"], rows.count(), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
