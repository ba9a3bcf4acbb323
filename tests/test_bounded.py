"""What tasks hold and read stays bounded as tables grow."""

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from deltaloom import catalog
from deltaloom.operators import more

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def orders(spark, sf, tmp_path_factory):
    """100 times the orders of the smallest tables."""
    d = str(tmp_path_factory.mktemp("orders"))
    spark.read.parquet(f"{sf}/orders.parquet").crossJoin(spark.range(100).withColumnRenamed("id", "i")).selectExpr("o_orderkey + i * 10000 AS o_orderkey", "o_orderpriority").write.parquet(f"{d}/orders.parquet")
    return d


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "setting"), [("join_spilling", "sortMergeJoinExec"), ("win_spilling", "windowExec")])
def test_rows_spill_in_a_bounded_number_of_runs(spark, orders, monkeypatch, name, setting):
    settings = {}
    monkeypatch.setattr(more, "with_setting", lambda spark, given, run: settings.update(given) or run())
    more.SET.queries[name](spark, orders)
    rows = spark.read.parquet(f"{orders}/orders.parquet").count()
    assert rows / int(settings[f"spark.sql.{setting}.buffer.spill.threshold"]) <= 64
    assert settings[f"spark.sql.{setting}.buffer.in.memory.threshold"] == "1000"


def test_no_sketch_is_kept_for_each_distinct_value(spark, sf):
    """An aggregate over distinct values beside others groups all of them by these values."""
    for x in plan(QUERIES["fc_agg_bounds"](spark, sf)).splitlines():
        assert "l_orderkey" not in x.partition("keys=[")[2].partition("]")[0] or "approx" not in x


def test_no_task_slides_a_frame_over_all_orders_of_a_status(spark, tmp_path):
    rows = [(1, "F", 10.5), (2, "F", 1010.2), (3, "F", 1011.0), (4, "F", None), (5, "F", None), (6, None, 10.0), (7, "O", -3.5), (8, "F", 10.9)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = QUERIES["win_range_frame"](spark, str(tmp_path))
    assert dict(map(tuple, df.collect())) == {1: 3, 8: 3, 2: 4, 3: 2, 4: 2, 5: 2, 6: 1, 7: 1}
    inside = plan(df).partition("Window")[2]
    assert "HashAggregate" in inside  # what goes into the window is a row for each distinct value


def test_copies_of_parts_are_compared_once(spark, tmp_path, monkeypatch):
    from pyspark.ml.feature import MinHashLSHModel

    def compared(*_):
        raise AssertionError("every part is compared with all others of its buckets")

    monkeypatch.setattr(MinHashLSHModel, "approxSimilarityJoin", compared)
    names = ["a b c d e f g h", "h g f e d c b a a", "a b c d e f g x", "q r s"]
    rows = [(i, names[i % 4], None, None) for i in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = {(r["a"], r["b"]): r["d"] for r in QUERIES["ml_min_hash_lsh"](spark, str(tmp_path)).collect()}
    same = {(a, b): 0.0 for a in range(40) for b in range(a + 1, 40) if {a % 4, b % 4} <= {0, 1} or a % 4 == b % 4}
    near = {(a, b): round(1 - 7 / 9, 6) for a in range(40) for b in range(a + 1, 40) if (a % 4 in (0, 1) and b % 4 == 2) or (b % 4 in (0, 1) and a % 4 == 2)}
    assert found == same | near


def test_a_batch_of_a_large_table_has_several_files(spark, sf, monkeypatch):
    from deltaloom.streaming import native

    monkeypatch.setattr(native, "ROWS", 100, raising=False)
    df = spark.range(1200).select(F.col("id").cast("double").alias("x"))
    batches = {}
    native.finished(native.split_stream(spark, df, 4, "x"), lambda batch, i: batches.update({i: (batch.select(F.input_file_name()).distinct().count(), batch.agg(F.min("x"), F.max("x"), F.count("*")).first())}))
    assert [n for n, _ in batches.values()] == [3] * 4
    assert sum(r[2] for _, r in batches.values()) == 1200 and all(a[1] < b[0] for (_, a), (_, b) in zip(batches.values(), list(batches.values())[1:], strict=False))


def test_the_console_collects_numbers_of_rows(spark, sf, monkeypatch):
    import pandas as pd

    frame = type(spark.range(0))
    given, was = [], frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, fn, schema, *a: given.append(fn) or was(self, fn, schema, *a))
    assert QUERIES["st_console"](spark, sf).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    assert sum(len(x) for x in given[0](iter([pd.DataFrame({"event_id": range(1000)})]))) == 1


def test_user_state_takes_counts_and_not_rows(spark, sf, monkeypatch):
    taken, was = [], GroupedData.applyInPandasWithState
    monkeypatch.setattr(GroupedData, "applyInPandasWithState", lambda self, *a: taken.append(self._df.columns) or was(self, *a))
    QUERIES["st_stateful"](spark, sf)
    assert taken == [["user_id", "m"]]


def test_costly_expressions_run_in_many_tasks(spark, orders, tmp_path):
    part = spark.range(200_000).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "'SMALL' AS p_type")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert QUERIES["fc_xpath"](spark, str(tmp_path)).rdd.getNumPartitions() >= 10


def test_edges_are_dealt_by_their_number(spark, tmp_path):
    """The session's number of partitions (4 here) doesn't decide how many edges a task holds."""
    from deltaloom.operators import dataflow

    spark.range(2_000_000).selectExpr("id % 1000 AS l_partkey", "id % 7 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert dataflow.edges(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert {r["degree"] for r in QUERIES["gr_degrees"](spark, str(tmp_path)).collect()} == {7, 1000}


def test_a_user_aggregate_takes_a_flag_in_blocks(spark, tmp_path):
    rows = spark.range(600_000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 9 AS l_partkey", "'R' AS l_returnflag", "CAST(id % 50 AS DOUBLE) AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["udaf_in_sql"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("R", 24.5, 599999.0)] and "block" in plan(df)


def test_percentiles_of_values_that_no_task_holds(spark):
    from deltaloom.operators import relational

    df = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", 1.0), ("b", 2.0), ("b", 2.0), ("c", None), (None, 5.0)], "k string, x double")
    found = {r["k"]: (r["m"], r["q"]) for r in relational.percentiles(df, "k", "x", {"m": 0.5, "q": 0.9}).collect()}
    assert found == {r["k"]: (r["m"], r["q"]) for r in df.groupBy("k").agg(F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.9).alias("q")).collect()}


def test_no_partial_aggregate_holds_the_values_of_a_flag(spark, sf):
    assert "percentile(" not in plan(QUERIES["agg_percentile"](spark, sf))


def test_only_vertices_that_changed_send_their_label(spark, monkeypatch):
    from deltaloom.operators import shapes

    rounds, was = [], shapes.staged
    monkeypatch.setattr(shapes, "staged", lambda df, name, *a: rounds.append(out := was(df, name, *a)) or out)
    e = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(9, 0)], "src long, dst long")
    start = spark.createDataFrame([(i, i) for i in (*range(7), 9)], "v long, x long")
    found = {r["v"]: r["x"] for r in shapes._reach(e, start).collect()}
    assert found == {i: 9 for i in (*range(7), 9)}
    assert [df.filter("moved").count() for df in rounds] == [1] * 7 + [0]
