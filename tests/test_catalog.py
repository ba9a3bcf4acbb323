"""Every registered query of the engine's own operators against an independent SQL engine."""

import math
from decimal import Decimal

import duckdb
import pytest

from deltaloom import catalog
from deltaloom.sources.tables import NAMES

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf}/{n}.parquet'")
    return c


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert df.columns and rows
        return
    found = duck.execute(ORACLE[name])
    assert table_of(df.columns, rows) == table_of([d[0] for d in found.description], found.fetchall())
