"""Graph queries over the graph of all lines, against plain Python."""

from collections import Counter

import pytest
from test_whole_tables import QUERIES, read


@pytest.fixture(scope="module")
def edges(sf):
    return {(p, -1 - s) for p, s in read(sf, "lineitem", "l_partkey", "l_suppkey")}


@pytest.fixture(scope="module")
def near(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


def got(spark, sf, name):
    return {tuple(r) for r in QUERIES[name](spark, sf).collect()}


def searched(near, start):
    """Vertices that can be reached, with the least number of steps."""
    found, now = {start: 0}, [start]
    for v in now:
        for w in near.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                now.append(w)
    return found


def test_degrees(spark, sf, near):
    assert got(spark, sf, "gr_degrees") == {(v, len(n)) for v, n in near.items()}


def test_triangles(spark, sf, near, edges):
    assert got(spark, sf, "gr_triangle_count") == {(sum(s in near.get(p + 1, ()) for p, s in edges),)}


def test_connected_components(spark, sf, near):
    assert got(spark, sf, "gr_connected_components") == {(v, min(searched(near, v))) for v in near}


def test_shortest_paths(spark, sf, near):
    assert got(spark, sf, "gr_shortest_paths") == set(searched(near, 1).items())


def test_page_rank(spark, sf, edges, near):
    ranks, out = dict.fromkeys(near, 1.0), Counter(a for a, _ in edges)
    for _ in range(5):
        sent = Counter()
        for a, b in edges:
            sent[b] += ranks[a] / out[a]
        ranks = {v: 0.15 + 0.85 * sent[v] for v in ranks}
    assert dict(got(spark, sf, "gr_page_rank")) == pytest.approx(ranks, abs=2e-6)


def test_label_propagation(spark, sf, near):
    labels = {v: v for v in near}
    for _ in range(4):
        votes = {v: Counter(labels[w] for w in n) for v, n in near.items()}
        labels = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
    assert got(spark, sf, "gr_label_propagation") == set(labels.items())


def test_directed(spark, sf, edges):
    directed = {}
    for p, s in edges:
        directed.setdefault(p, set()).add(-1 - s)
    assert got(spark, sf, "gr_edge_partitions") == {(k, len(edges), True) for k in ("source", "pair", "canonical_pair", "grid")}
    vertices = {v for p, n in directed.items() for s in n if s != p for v in (p, s)}
    reach = {v: set(searched(directed, v)) for v in vertices}
    assert got(spark, sf, "gr_strongly_connected") == {(v, max(w for w in reach[v] if v in reach[w])) for v in vertices}
