"""Queries over whole tables, against plain Python."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from deltaloom import catalog

QUERIES = catalog.queries()


def read(sf, name, *columns):
    t = pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*[t[c] for c in columns], strict=True))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_joins_take_all_rows(spark, sf, how):
    customers, orders = {c for (c,) in read(sf, "customer", "c_custkey")}, Counter(c for (c,) in read(sf, "orders", "o_custkey"))
    inner, idle, lost = sum(n for c, n in orders.items() if c in customers), len(customers - set(orders)), sum(n for c, n in orders.items() if c not in customers)
    want = {"inner": inner, "left": inner + idle, "right": inner + lost, "full": inner + idle + lost, "semi": len(customers) - idle, "anti": idle}
    assert QUERIES[f"join_{how}"](spark, sf).count() == want[how]


@pytest.mark.parametrize("name", [f"sort_{d}_nulls_{n}" for d in ("asc", "desc") for n in ("first", "last")])
def test_sorts_give_all_rows(spark, sf, name):
    descending, first = "desc" in name, "first" in name
    key = lambda r: ((r[1] == 2) != first, -r[1] if descending else r[1], r[0])  # noqa: E731  region 2 counts as null
    order = sorted(read(sf, "nation", "n_nationkey", "n_regionkey"), key=key)
    assert {tuple(r) for r in QUERIES[name](spark, sf).collect()} == {(k, i + 1) for i, (k, _) in enumerate(order)}


def test_explode_gives_all_places(spark, sf):
    want = {(i, p): x for i, v in read(sf, "embeddings", "vec_id", "embedding") for p, x in enumerate(v)}
    assert {(r[0], r[1]): r[2] for r in QUERIES["lateral_explode"](spark, sf).collect()} == want
