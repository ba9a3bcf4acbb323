"""The named queries of the engine's own operators and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.functions import columns, scalar
from deltaloom.operators import dataflow, learning, more, relational, shapes
from deltaloom.plans import tpch
from deltaloom.sources import commands, external, formats
from deltaloom.sources import more as more_sources
from deltaloom.streaming import incremental, native, stateful
from deltaloom.streaming import more as more_streams
from deltaloom.streaming import tpch as streamed_tpch

SETS = [tpch.SET, relational.SET, scalar.SET, columns.SET, formats.SET, commands.SET, external.SET, more_sources.SET, dataflow.SET, shapes.SET, learning.SET, more.SET, native.SET, stateful.SET, more_streams.SET, incremental.SET, streamed_tpch.SET]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for s in SETS for name, fn in s.queries.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: text for s in SETS for name, text in s.oracle.items()}
    return found | {"gr_page_rank": more.PAGE_RANK_SQL, "gr_label_propagation": more.LABELS_SQL}
