"""Connected components of a link table, by alternating large and small stars.

Each step takes the least neighbour of every node by a partial aggregate and joins it back; that join brings a node's
links to one partition, which adaptive execution splits where it is skewed. Tables stay in the shared folder.

Defined results: repeated links and links of a node with itself count for nothing more; a node without links to others has
no row; links with a null are to be left out by the caller; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.session import staged


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every greater neighbour of u is tied to the least of u and its neighbours; small: u and its lesser
    neighbours are tied to the least of them."""
    side = _both(links) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = side.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = side.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links u, v of one type to rows node, component, for nodes with links; a component is named by its least node."""
    now = staged(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        after = staged(_star(_star(now, True), False), "stars")
        # stars are stable once every node hangs on one root; count and content tell
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            break
        now, state = after, sums
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
