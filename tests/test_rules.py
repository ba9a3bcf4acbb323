"""Queries whose results depend on the engine's rules, in a session that has the others."""

import duckdb
import pytest
from test_catalog import ORACLE, QUERIES, table_of

ANSI = "spark.sql.ansi.enabled"


@pytest.mark.parametrize("rules", ["true", "false"])
def test_nulls_instead_of_errors_in_any_session(spark, sf, rules):
    before = spark.conf.get(ANSI)
    spark.conf.set(ANSI, rules)
    try:
        df = QUERIES["fc_math"](spark, sf)
        rows = df.collect()
        assert spark.conf.get(ANSI) == rules
    finally:
        spark.conf.set(ANSI, before)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{sf}/part.parquet'")
    found = duck.execute(ORACLE["fc_math"])
    assert table_of(df.columns, rows) == table_of([d[0] for d in found.description], found.fetchall())
