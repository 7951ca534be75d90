"""Iterations that send on only what moved, and attributed alignment, against dense numpy."""

import numpy as np
import pytest

from kinmap.operators import align, propagate

N = 12


def made(seed, attributes=3):
    """Two graphs with binary edge and node attributes: edge rows, node rows, and their matrices."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(2):
        links = {(int(a), int(b)) for a, b in rng.integers(0, N, (30, 2)) if a != b}
        links |= {(b, a) for a, b in links}
        edges = [(0, a, b, 1.0, (rng.random(attributes) < 0.6).astype(float).tolist()) for a, b in sorted(links)]
        nodes = [(0, i, [*(rng.random(attributes) < 0.7).astype(float).tolist(), 1.0]) for i in range(N)]
        out.append((edges, nodes))
    return out


def frames(spark, made):
    return [(spark.createDataFrame(n, "gid int, node long, x array<double>"), spark.createDataFrame(e, "gid int, src long, dst long, w double, edge_attr array<double>")) for e, n in made]


ANCHORS = [(1, 2), (3, 3), (7, 10)]


def matrix(rows):
    out = np.zeros((N, N))
    for r in rows:
        out[r.u, r.v] += r.score
    return out


def column_stochastic(edges):
    a = np.zeros((N, N))
    for _, s, d, w, _ in edges:
        a[s, d] += w
    return np.divide(a, a.sum(0), out=np.zeros_like(a), where=a.sum(0) > 0)


@pytest.mark.parametrize("bound,merge_every", [(1e-9, 4), (1e-3, 3), (0.05, 4), (0.0, 1)])
def test_consistency_by_change(spark, bound, merge_every):
    graphs = made(1)
    (_, e1), (_, e2) = frames(spark, graphs)
    anchors = spark.createDataFrame(ANCHORS + ANCHORS[:1], "u long, v long")
    w1, w2 = (column_stochastic(e) for e, _ in graphs)
    h = np.zeros((N, N))
    for u, v in ANCHORS:
        h[u, v] = 1
    s = h
    for _ in range(100):
        s = 0.4 * w1 @ s @ w2.T + 0.6 * h
    got = matrix(align.consistency_by_change(e1, e2, anchors, bound=bound, merge_every=merge_every).collect())
    # What was never sent on is at most the bound for each pair, and is missed 0.4 / 0.6 times at most in all.
    assert np.abs(got - s).sum() <= max(1e-8, N * N * bound * 0.4 / 0.6)
    assert (got <= s + 1e-9).all()


def dense_attributed(graphs, alpha, use_attr, steps):
    parts, units = [], []
    for edges, nodes in graphs:
        e = np.zeros((len(edges[0][4]) if use_attr else 1, N, N))
        for _, s, d, _, attr in edges:
            if not use_attr:
                e[0, s, d] += 1
            elif any(attr):
                e[:, s, d] = np.array(attr) / np.linalg.norm(attr)
        x = np.array([n[2] for n in nodes]) if use_attr else np.ones((N, 1))
        parts.append(e)
        units.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    cosine = units[0] @ units[1].T
    degree = sum((e1 @ units[0][:, a]).reshape(-1, 1) * (e2 @ units[1][:, a]).reshape(1, -1) for a in range(units[0].shape[1]) for e1, e2 in zip(*parts))
    product = cosine * degree
    n = np.where(product > 0, cosine / np.sqrt(np.where(product > 0, product, 1)), cosine * product)
    h = np.zeros((N, N))
    for u, v in ANCHORS:
        h[u, v] = 1
    s = h
    for _ in range(steps):
        moved = sum(e1.T @ (n * s) @ e2.T for e1, e2 in zip(*parts))
        s = (1 - alpha) * h + alpha * n * moved
    return s


@pytest.mark.parametrize("use_attr", [True, False])
def test_attributed_alignment(spark, use_attr):
    graphs = made(2)
    (n1, e1), (n2, e2) = frames(spark, graphs)
    anchors = spark.createDataFrame(ANCHORS, "u long, v long")
    few = matrix(align.attributed(n1, e1, n2, e2, anchors, iterations=2, use_attr=use_attr).collect())
    assert np.allclose(few, dense_attributed(graphs, 0.5, use_attr, 2))
    want = dense_attributed(graphs, 0.5, use_attr, 200)
    changed = matrix(align.attributed_by_change(n1, e1, n2, e2, anchors, bound=1e-8, use_attr=use_attr).collect())
    assert np.abs(changed - want).max() < 1e-5


def test_attributed_stops_and_limits(spark):
    graphs = made(3)
    (n1, e1), (n2, e2) = frames(spark, graphs)
    anchors = spark.createDataFrame(ANCHORS, "u long, v long")
    got = matrix(align.attributed(n1, e1, n2, e2, anchors, tolerance=0.02).collect())
    want = dense_attributed(graphs, 0.5, True, 200)
    assert 0 < np.abs(got - want).max() < 0.05
    top = align.attributed(n1, e1, n2, e2, anchors, iterations=3, top_k=2).collect()
    assert max(sum(r.u == u for r in top) for u in range(N)) <= 2
    assert all(r.score >= 0.01 for r in align.attributed(n1, e1, n2, e2, anchors, iterations=3, min_score=0.01).collect())
    with pytest.raises(MemoryError):
        align.attributed(n1, e1, n2, e2, anchors, most_pairs=3)
    with pytest.raises(MemoryError):
        align.attributed_by_change(n1, e1, n2, e2, anchors, most_pairs=3)


@pytest.mark.parametrize("bound", [1e-6, 1e-2])
def test_pushed_walks(spark, bound):
    edges, _ = made(4)[0]
    edges = [e for e in edges if 0 not in e[1:3] and e[1] != 5]  # node 0 has no edges, node 5 none that leave it
    p = np.zeros((N, N))
    for _, s, d, w, _ in edges:
        p[s, d] += w
    lone = p.sum(1) == 0
    p = np.divide(p, p.sum(1, keepdims=True), out=np.zeros_like(p), where=~lone[:, None])
    keys = [(1, 0), (4, 1), (0, 2), (0, 2)]
    e = np.zeros((N, 3))
    for n, k in keys:
        e[n, k] += 1
    frame = spark.createDataFrame([x[:4] for x in edges], "gid int, src long, dst long, w double")
    nodes, anchors = spark.range(N).withColumnRenamed("id", "node"), spark.createDataFrame(keys, "node long, key long")
    walk = np.zeros((N, 3))
    for r in propagate.pushed_walk(frame, anchors, 0.5, bound).collect():
        walk[r.node, r.key] = r.value
    most = max(1e-8, N * bound)
    want = 0.5 * np.linalg.inv(np.eye(N) - 0.5 * p.T) @ e
    assert np.abs(walk - want).sum(0).max() <= most and (walk <= want + 1e-9).all()
    sparse, spread, even = propagate.pushed_walk_connected(frame, nodes, anchors, 0.5, bound)
    got, share = np.zeros((N, 3)), np.zeros(N)
    for r in sparse.collect():
        got[r.node, r.key] = r.value
    for r in even.collect():
        share[r.node] = r.share
    for r in spread.collect():
        got[:, r.key] += r.times * share
    p[lone] = 1 / N
    want = 0.5 * np.linalg.inv(np.eye(N) - 0.5 * p.T) @ e
    assert np.abs(got - want).sum(0).max() <= max(1e-7, 40 * most)
