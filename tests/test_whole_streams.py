"""Joins maintained and streamed over whole tables, against plain Python."""

from datetime import timedelta

import pytest
from test_whole_tables import QUERIES, read


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "semi", "anti"])
def test_maintained_joins_take_all_rows(spark, sf, how):
    customers, orders = read(sf, "customer", "c_custkey"), read(sf, "orders", "o_custkey", "o_orderkey")
    known, busy = {c for (c,) in customers}, {c for c, _ in orders}
    inner, idle, lost = [x for x in orders if x[0] in known], [(c, None) for c in known - busy], [x for x in orders if x[0] not in known]
    want = {"inner": inner, "left": inner + idle, "right": inner + lost, "full": inner + idle + lost, "semi": [(c,) for c in known & busy], "anti": [(c,) for c in known - busy]}
    columns = ["k"] if how in ("semi", "anti") else ["k", "o_orderkey"]
    assert sorted((tuple(r) for r in QUERIES[f"inc_{how}"](spark, sf).select(*columns).collect()), key=repr) == sorted(want[how], key=repr)


@pytest.mark.parametrize("how", ["left_outer", "right_outer", "semi"])
def test_streamed_joins_take_all_events(spark, sf, how):
    rows, by_user = read(sf, "events", "event_id", "user_id", "ts"), {}
    for i, u, t in rows:
        by_user.setdefault(u, []).append((i, t))
    pairs = [(i, j) for i, u, t in rows for j, s in by_user[u] if t < s <= t + timedelta(hours=6)]
    left, right = {a for a, _ in pairs}, {b for _, b in pairs}
    want = {"left_outer": pairs + [(i, None) for i, _, _ in rows if i not in left], "right_outer": pairs + [(None, i) for i, _, _ in rows if i not in right], "semi": [(i,) for i in left]}
    assert sorted((tuple(r) for r in QUERIES[f"st_{how}_join"](spark, sf).collect()), key=repr) == sorted(want[how], key=repr)
