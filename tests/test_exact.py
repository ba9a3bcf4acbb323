"""Results that the order of rows must not decide."""

import math

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from deltaloom import catalog
from deltaloom.operators import relational
from deltaloom.streaming import native

QUERIES = catalog.queries()


def test_a_mean_at_the_bar_is_not_above_it(spark, tmp_path):
    """Each supplier's discounts have a mean of exactly 0.05 but in the last one's; floating sums of some are above it."""
    rows = [(s, (i % 11 if (i + s) % 2 else 10 - i % 11) / 100) for s in range(40) for i in range(660 + 22 * s)]
    rows += [(99, 0.05)] * 60 + [(99, 0.06)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["agg_having"](spark, str(tmp_path)).collect()] == [(99, 61)]


def test_exact_means_of_odd_values(spark):
    df = spark.createDataFrame([(1, 1e300), (1, 1e300), (2, math.inf), (2, 1.0), (3, None), (4, 1e-12), (4, 3e-12), (5, math.nan)], "k int, x double")
    found = {r["k"]: r["a"] for r in df.groupBy("k").agg(relational.exact_mean("x").alias("a")).collect()}
    assert found[1] == 1e300 and found[2] == math.inf and found[3] is None and found[4] == pytest.approx(2e-12) and math.isnan(found[5])


def test_a_failing_stream_gives_no_result(spark, sf, monkeypatch):
    """A count by the clock ends with all rows or with an error, never with what came until some deadline."""
    from types import SimpleNamespace

    from deltaloom.streaming import more

    def broken(x):
        raise ValueError("as meant")

    failing = lambda spark, sf_dir: native.events(spark, sf_dir).select(F.udf(broken, "long")("user_id").alias("user_id"))
    with monkeypatch.context() as m:
        m.setattr(more, "events", failing)
        with pytest.raises(StreamingQueryException):
            QUERIES["st_clock_timeout"](spark, sf)
    idle = SimpleNamespace(isActive=True, lastProgress={"batchId": 3}, exception=lambda: None)
    with pytest.raises(TimeoutError):
        more.counted_out(idle, lambda: 7, 8, patience=1)
    more.counted_out(SimpleNamespace(isActive=True, lastProgress={"batchId": 900}, recentProgress=[]), lambda: 8, 8)
