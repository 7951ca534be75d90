"""Walks as a level a node and what single keys have over it, and what transport costs make of them."""

import numpy as np
import pytest

from kinmap.operators import blocks, propagate
from kinmap.operators import transport as ot

N = 40
#: Directed, so walks come to nodes without edges: 38 and 39.
EDGES = [(k, (k + 1) % 38, 1.0 + k % 3) for k in range(38)] + [(3, 38, 2.0), (5, 38, 1.0), (7, 20, 1.0)]
STARTS = [(3, 3), (5, 5), (5, 9), (11, 11), (38, 38)]
KEYS = [3, 5, 9, 11, 38]


def dense_walk(steps, connected):
    a = np.zeros((N, N))
    for s, d, w in EDGES:
        a[s, d] += w
    if connected:
        a[a.sum(1) == 0] = 1
    p = np.divide(a, a.sum(1, keepdims=True), out=np.zeros_like(a), where=a.sum(1, keepdims=True) > 0)
    e = np.zeros((N, len(KEYS)))
    for node, key in STARTS:
        e[node, KEYS.index(key)] += 1
    r = np.ones_like(e)
    for _ in range(steps):
        before, r = r, 0.85 * p.T @ r + 0.15 * e
    return r, np.abs(r - before).max()


@pytest.fixture
def tables(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long, w double")
    nodes = spark.range(N).withColumnRenamed("id", "node")
    return edges, nodes, spark.createDataFrame(STARTS, "node long, key long")


def as_dense(rows):
    out = np.full((N, len(KEYS)), np.nan)
    for node, key, value in rows:
        assert np.isnan(out[node, KEYS.index(key)])
        out[node, KEYS.index(key)] = value
    return out


@pytest.mark.parametrize("connected", [False, True])
@pytest.mark.parametrize("steps", [1, 2, 6])
def test_walks_to_nodes_without_edges(tables, connected, steps):
    got = propagate.restart_walk(*tables, iterations=steps, tolerance=0, connect_isolated=connected)
    assert np.allclose(as_dense(got.collect()), dense_walk(steps, connected)[0])


@pytest.mark.parametrize("connected", [False, True])
def test_walks_end_by_the_greatest_change(tables, connected):
    tolerance = (dense_walk(5, connected)[1] * dense_walk(10, connected)[1]) ** 0.5  # changes are looked at every 5 steps
    got = propagate.restart_walk(*tables, iterations=100, tolerance=tolerance, connect_isolated=connected)
    assert np.allclose(as_dense(got.collect()), dense_walk(10, connected)[0])


def test_only_what_walks_reach_is_a_row(tables):
    """All nodes times all keys were shuffled in every step before."""
    walk = propagate.levelled_walk(*tables, iterations=2)
    assert walk.levels.count() == N and walk.own.count() <= 3 * len(STARTS)
    assert walk.rows().count() == N * len(KEYS)


def raised(walk, rows):
    ids = np.arange(N)
    own = blocks.entries(walk.own, "node", "key", "value", ids, np.array(KEYS))
    levels = walk.levels.selectExpr("node", "0L AS key", "value")
    return ot.Raised.of(own, blocks.entries(levels, "node", "key", "value", ids, np.array(KEYS)), rows, len(KEYS))


def test_costs_of_levelled_walks_are_the_dense_ones(spark, tables):
    edges = tables[0]
    x = dense_walk(2, True)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    unit = propagate.levelled_walk(*tables, iterations=2, connect_isolated=True).units()
    assert np.allclose(as_dense(unit.rows().collect()), x)
    rows, ids = raised(unit, N), np.arange(N)
    placed = blocks.entries(edges, "src", "dst", "w", ids, ids)
    cost = ot.edge_cost(ot.cosines(rows, rows), placed).collect()
    assert len(cost) == len(EDGES)
    w = {(s, d): w for s, d, w in EDGES}
    assert all(np.isclose(c.w, w[c.r, c.c] * np.exp(-x[c.r] @ x[c.c])) for c in cost)
    both = ot.cosines(rows, rows, "walk").map(lambda first, m: {"walk": m["walk"], "attr": 2 * m["walk"]}, ("walk", "attr"))
    a = np.zeros((N, N))
    for s, d, v in EDGES:
        a[s, d] = v
    got = np.zeros((N, N))
    for r in ot.unlinked_cost(both, placed, 0.5).pairs("cost", ids, ids).collect():
        got[r.u, r.v] = r.value
    assert np.allclose(got, np.maximum(0, 1.5 * (x @ x.T) * (1 - a)))
