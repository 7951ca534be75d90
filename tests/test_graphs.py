"""Graph operators on small graphs: merging, validation, propagation and alignment against dense formulas."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap.operators import align, graph, noise, propagate, sampling
from kinmap.operators import transport as ot
from kinmap.sources.fixtures import NetworkSet
from kinmap.sources.networks import ANCHORS, EDGES, NODES

PAIRS = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)]


def network(spark, anchors, graphs=2, size=5):
    nodes = [(g, n, [float(n % 2), 1.0]) for g in range(graphs) for n in range(size)]
    edges = [(g, a, b, 1.0, None) for g in range(graphs) for s, d in PAIRS for a, b in ((s, d), (d, s))]
    return NetworkSet(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(anchors, ANCHORS))


def dense(rows, n, m=None):
    out = np.zeros((n, m or n))
    for r in rows:
        out[r[0], r[1]] = r[2]
    return out


def test_chained_anchors_resolve_to_the_lowest_graph(spark):
    net = network(spark, [(0, [1, 2, -1], "train"), (1, [-1, 2, 3], "train"), (2, [-1, -1, -1], "train")], graphs=3)
    node_map, edges, _, merged = graph.merge_on_anchors(net)
    ids = {(r.gid, r.node): r.mid for r in node_map.collect()}
    assert ids[0, 1] == ids[1, 2] == ids[2, 3] and len(set(ids.values())) == 13
    assert set(ids.values()) == set(range(13)) and edges.count() == 30 and merged.count() == 1


def test_a_set_of_one_graph_with_bad_ids_is_not_valid(spark):
    net = network(spark, [(0, [9], "train"), (1, [0, 1], "train")], graphs=1)
    rules = {r.rule for r in graph.violations(net, [0]).collect()}
    assert rules == {"two_graphs", "anchor_width", "anchor_range"}


def test_multiway_anchors_reject_what_misses_a_graph(spark):
    net = network(spark, [(0, [1, -1, 2], "train")], graphs=3)
    with pytest.raises(Exception, match="misses a graph"):
        graph.multiway_anchors(net.anchors, [0, 1]).collect()


def test_dense_ids_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = graph.dense_ids(rows, ["k"], per_part=100).orderBy("k").collect()
    assert [r.id for r in got] == list(range(1000))


def test_restart_walk_is_the_dense_walk(spark):
    net = network(spark, [(0, [1, 1], "train"), (1, [4, 4], "train")])
    a = dense([(s, d, 1.0) for x, y in PAIRS for s, d in ((x, y), (y, x))], 5)
    keys = spark.createDataFrame([(1, 0), (4, 1)], "node long, key long")
    e = np.zeros((5, 2))
    e[1, 0] = e[4, 1] = 1
    for connected in (False, True):
        p = a.copy()
        if connected:
            p[p.sum(1) == 0] = 1
        p = np.divide(p, p.sum(1, keepdims=True), out=np.zeros_like(p), where=p.sum(1, keepdims=True) > 0)
        r = np.ones((5, 2))
        for _ in range(7):
            r = 0.85 * p.T @ r + 0.15 * e
        got = propagate.restart_walk(net.graph(0), net.nodes.where("gid = 0"), keys, iterations=7, tolerance=0, connect_isolated=connected)
        assert np.allclose(dense([(x.node, x.key, x.value) for x in got.collect()], 5, 2), r)


def test_consistency_is_the_dense_iteration(spark):
    net = network(spark, [(0, [0, 0], "train"), (1, [2, 2], "train")])
    a = dense([(s, d, 1.0) for x, y in PAIRS for s, d in ((x, y), (y, x))], 5)
    w = np.divide(a, a.sum(0), out=np.zeros_like(a), where=a.sum(0) > 0)
    h = np.zeros((5, 5))
    h[0, 0] = h[2, 2] = 1
    s = h
    for _ in range(4):
        s = 0.4 * w @ s @ w.T + 0.6 * h
    got = align.consistency(net.graph(0), net.graph(1), net.pairs(), iterations=4)
    assert np.allclose(dense([(r.u, r.v, r.score) for r in got.collect()], 5), s)


def test_greedy_dedup_follows_the_sequence(spark):
    rows = [(0, 1, 1), (1, 1, 2), (2, 2, 2), (3, 2, 3), (4, -1, 5), (5, 4, 3), (6, 5, 5)]
    got = noise.one_to_one(spark.createDataFrame(rows, "id long, u long, v long")).collect()
    us, vs, want = set(), set(), set()
    for i, u, v in rows:
        if -1 not in (u, v) and u not in us and v not in vs:
            us.add(u), vs.add(v), want.add(i)
    assert {r.id for r in got} == want


def greedy(rows):
    us, vs, want = set(), set(), set()
    for i, u, v in sorted(rows):
        if -1 not in (u, v) and u not in us and v not in vs:
            us.add(u), vs.add(v), want.add(i)
    return want


def test_long_chains_settle_in_few_rounds(spark):
    """A zigzag of 10,000 pairs, each of which shares a node with the one before."""
    rows = [(k, (k + 1) // 2, k // 2) for k in range(10_000)]
    got = noise.one_to_one(spark.createDataFrame(rows, "id long, u long, v long"), rounds=3).collect()
    assert {r.id for r in got} == greedy(rows) and len(got) == 5000


def test_greedy_dedup_on_random_pairs(spark):
    rng = np.random.default_rng(3)
    for n, ends in ((60, 12), (200, 150), (40, 4)):
        rows = [(int(i), int(u), int(v)) for i, (u, v) in zip(rng.permutation(n), rng.integers(-1, ends, (n, 2)))]
        got = noise.one_to_one(spark.createDataFrame(rows, "id long, u long, v long")).collect()
        assert {r.id for r in got} == greedy(rows)


def test_noise_ratios_zero_and_one(spark):
    net = network(spark, [])
    same = noise.flip_attributes(net.nodes, 0.0).select("gid", "node", F.to_json("x").alias("x"))
    assert same.exceptAll(net.nodes.select("gid", "node", F.to_json("x").alias("x"))).isEmpty()
    flipped = {(r.gid, r.node): list(r.x) for r in noise.flip_attributes(net.nodes, 1.0).collect()}
    assert flipped == {(r.gid, r.node): [1 - v for v in r.x] for r in net.nodes.collect()}
    kept = {(r.src, r.dst) for r in noise.perturb_edges(net.graph(0), 5, 0.0).collect()}
    assert kept == {(r.src, r.dst) for r in net.graph(0).collect()}
    with pytest.raises(Exception, match="not binary"):
        noise.flip_attributes(net.nodes.withColumn("x", F.array(F.lit(0.5))), 1.0).collect()


def test_distinct_negatives(spark):
    pairs = spark.createDataFrame([(u, u % 6) for u in range(30)], "u long, v long")
    rows = sampling.distinct_negatives(pairs, 6, 5).groupBy("u", "v").agg(F.collect_set("negative").alias("s")).collect()
    assert all(set(r.s) == set(range(6)) - {r.v} for r in rows)


def test_quotas_and_simplex():
    assert noise.quotas(10, {"a": 0.25, "b": 0.25, "c": 0.5}) == {"a": 2, "b": 2, "c": 6}
    with pytest.raises(ValueError):
        noise.quotas(10, {"a": 0.5})
    w = ot.simplex(np.array([0.5, 0.9, -0.2]))
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and np.allclose(w, [0.3, 0.7, 0])


def test_multi_marginal_plan_against_loops():
    """Losses and margins of three graphs by plain loops, and that the plan beats the even one."""
    rng = np.random.default_rng(3)
    shape = (3, 4, 2)
    cross, costs = rng.random(shape), [rng.random((n, n)) for n in shape]
    even = np.full(shape, 1 / np.prod(shape))
    plan = rng.random(shape)
    plan /= plan.sum()
    want = np.zeros(shape)
    for at in itertools.product(*map(range, shape)):
        for other in itertools.product(*map(range, shape)):
            for i, j in itertools.combinations(range(3), 2):
                gap = costs[i][at[i], other[i]] ** 2 + costs[j][at[j], other[j]] ** 2 - 2 * costs[i][at[i], other[i]] * costs[j][at[j], other[j]]
                want[at] += gap * plan[other]
    assert np.allclose(ot.pair_losses(plan, costs), want)

    found = ot.proximal_plan(cross, costs, 0.5, 0.1, 50, 200, 1e-9)
    for k, n in enumerate(shape):
        assert np.allclose(found.sum(axis=tuple(i for i in range(3) if i != k)), 1 / n, atol=1e-6)
    value = lambda p: float(((0.5 * cross + 0.25 * ot.pair_losses(p, costs)) * p).sum())
    assert value(found) < value(even) - 1e-3


def test_consistency_to_tolerance_and_pruned(spark):
    rng = np.random.default_rng(5)
    graphs = [{(int(a), int(b)) for a, b in rng.integers(0, 8, (20, 2)) if a != b} for _ in range(2)]
    graphs = [g | {(b, a) for a, b in g} for g in graphs]
    frames = [spark.createDataFrame([(0, a, b, 1.0) for a, b in sorted(g)], "gid int, src long, dst long, w double") for g in graphs]
    anchors = spark.createDataFrame([(1, 2), (3, 3)], "u long, v long")
    w = [np.zeros((8, 8)), np.zeros((8, 8))]
    for m, g in zip(w, graphs):
        for a, b in g:
            m[a, b] = 1
        m /= np.maximum(m.sum(0), 1)
    h = np.zeros((8, 8))
    h[1, 2] = h[3, 3] = 1
    s = h.copy()
    for _ in range(200):
        s = 0.4 * w[0] @ s @ w[1].T + 0.6 * h
    got = np.zeros((8, 8))
    for r in align.consistency(*frames, anchors).collect():
        got[r.u, r.v] = r.score
    assert np.abs(got - s).max() < 1e-9
    few = align.consistency(*frames, anchors, top_k=2).collect()
    assert max(sum(r.u == u for r in few) for u in range(8)) <= 2
    floor = align.consistency(*frames, anchors, min_score=0.05).collect()
    assert all(r.score >= 0.05 for r in floor)
    with pytest.raises(MemoryError):
        align.consistency(*frames, anchors, most_pairs=3)


def test_running_sums_over_parts(spark):
    rows = [(k % 2, k, (7 * k) % 5) for k in range(40)]
    frame = spark.createDataFrame(rows, "g int, k long, n long")
    got = {(r.g, r.k): r.s for r in graph.running(frame, ["g"], ["k"], "n", "s", per_part=6).collect()}
    assert got == {(g, k): sum(n for h, i, n in rows if h == g and i < k) for g, k, _ in rows}
