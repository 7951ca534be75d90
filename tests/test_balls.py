"""What nodes reach by layers, as words of ids, and their degree signatures against loops."""

import math
import random
from collections import defaultdict

from kinmap.operators import graph as g


def layers_of(nodes, edges, layers):
    step = defaultdict(set)
    for gid, a, b, _ in edges:
        step[gid, a].add(b)
    out = {}
    for gid, node in nodes:
        seen, front = {node}, {node}
        out[gid, node, 0] = {node}
        for layer in range(1, layers + 1):
            front = {b for a in front for b in step[gid, a]} - seen
            seen |= front
            if front:
                out[gid, node, layer] = front
    return out


def case(spark, seed, ids, links):
    draw = random.Random(seed)
    nodes = [(gid, i) for gid in (0, 1) for i in ids]
    edges = [(gid, draw.choice(ids), draw.choice(ids), 1.0) for gid in (0, 1) for _ in range(links)]
    edges += edges[:5] + [(0, ids[0], ids[0], 1.0)]
    return nodes, edges, spark.createDataFrame(nodes, "gid int, node long"), spark.createDataFrame(edges, "gid int, src long, dst long, w double")


def test_words_hold_what_each_layer_reaches(spark):
    for seed, ids, layers in ((1, list(range(150)), 3), (2, [-130, -64, -1, 0, 63, 64, 10**12, 2**62], 2), (3, list(range(40)), 1)):
        nodes, edges, n, e = case(spark, seed, ids, 2 * len(ids))
        found = defaultdict(set)
        for r in g.balls(n, e, layers).collect():
            assert r.bits != 0
            found[r.gid, r.node, r.layer] |= {64 * r.chunk + k for k in range(64) if r.bits >> k & 1}
        assert found == layers_of(nodes, edges, layers)


def test_signatures_against_loops(spark):
    nodes, edges, n, e = case(spark, 4, list(range(120)), 300)
    degree = defaultdict(int)
    for gid, a, _, _ in edges:
        degree[gid, a] += 1
    expected = defaultdict(float)
    for (gid, node, layer), near in layers_of(nodes, edges, 2).items():
        for b in near:
            if degree[gid, b]:
                expected[gid, node, math.floor(math.log2(degree[gid, b]))] += 0.01**layer
    got = {(r.gid, r.node, r.bucket): r.value for r in g.degree_signature(n, e).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-9 for k, v in expected.items())


def test_rows_of_dense_ids_are_words_not_pairs(spark):
    nodes, edges, n, e = case(spark, 5, list(range(256)), 4_000)
    pairs = sum(map(len, layers_of(nodes, edges, 2).values()))
    rows = g.balls(n, e, 2).count()
    assert rows <= 2 * 256 * (1 + 2 * 4) and rows * 15 < pairs
    assert g.balls(n.where("false"), e, 2).count() == 0
    assert g.degree_signature(n, e.where("false")).count() == 0
