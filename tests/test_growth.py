"""Anchor growth and algorithm sweeps against plain loops."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap.operators import propagate, sampling
from kinmap.plans import transports
from kinmap.sources.fixtures import NetworkSet


def expanded(edges, labels, layers):
    now = {(n, k): 1.0 for n, k in labels}
    for _ in range(layers):
        sums = collections.Counter()
        for s, d in edges:
            for (n, k), x in now.items():
                if n == d:
                    sums[s, k] += x
        after = collections.Counter({key: -x for key, x in now.items()})
        for key, x in sums.items():
            if x > 0:
                after[key] += 1
        now = {key: x for key, x in after.items() if x}
    return now


def grown(edges1, edges2, anchors, rounds):
    now = set(anchors)
    for _ in range(rounds):
        sides = []
        for edges, end in ((edges1, 0), (edges2, 1)):
            mine = {a[end] for a in now}
            near = {e for e in edges if e[0] in mine or e[1] in mine}
            values = expanded(near, [(a[end], a[0]) for a in now], 2)
            rows = collections.defaultdict(dict)
            for (n, k), x in values.items():
                rows[n][k] = x
            free = ({x for e in near for x in e} | mine) - mine
            sides.append({n: {k: x / math.sqrt(sum(y * y for y in r.values())) for k, x in r.items()} for n, r in rows.items() if n in free})
        scores = {(u, v): round(sum(x * b[k] for k, x in a.items() if k in b), 9) for u, a in sides[0].items() for v, b in sides[1].items()}
        scores = {p: s for p, s in scores.items() if s > 0}
        best_v = {u: min((-s, v) for (a, v), s in scores.items() if a == u)[1] for u, _ in scores}
        best_u = {v: min((-s, u) for (u, b), s in scores.items() if b == v)[1] for _, v in scores}
        now |= {(u, v) for u, v in best_v.items() if best_u[v] == u}
    return now


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_anchor_growth(spark, seed):
    rng = np.random.default_rng(seed)
    graphs = []
    for _ in range(2):
        links = {(int(a), int(b)) for a, b in rng.integers(0, 25, (40, 2)) if a != b}
        graphs.append(links | {(b, a) for a, b in links})
    anchors = [(0, 3), (5, 5), (9, 1)]
    frames = [spark.createDataFrame(sorted(g), "src long, dst long") for g in graphs]
    got = propagate.grown_anchors(*frames, spark.createDataFrame(anchors, "u long, v long"), 2)
    want = grown(*graphs, anchors, 2)
    assert {tuple(r) for r in got.collect()} == want and len(want) > len(anchors)


def test_sweep_reports_metrics_and_failures(spark):
    rng = np.random.default_rng(3)
    n = 12
    nodes = spark.createDataFrame([(g, i) for g in (0, 1) for i in range(n)], "gid int, node long")
    anchors = spark.createDataFrame([(i, [i, (i * 5) % n], "test" if i % 3 else "train") for i in range(n)], "aid long, nodes array<long>, split string")
    net = NetworkSet(nodes, nodes.limit(0), anchors)
    score = rng.permutation(n * n).reshape(n, n) / (n * n) + 0.001
    pairs = spark.createDataFrame([(u, v, float(score[u, v])) for u in range(n) for v in range(n)], "u long, v long, score double")
    truth = spark.createDataFrame([(f"e{i % 4}", side, i) for i in range(n) for side in ("src", "tgt")], "eid string, side string, node long")
    ids = spark.createDataFrame([(f"e{k}",) for k in range(4)], "eid string")

    def broken(net):
        raise ValueError("no such graph")

    rows = transports.sweep(net, n, truth, ids, {"known": lambda net: pairs, "broken": broken}).collect()
    assert [tuple(r) for r in rows if r.run == "broken"] == [("broken", "error: ValueError", None, None)]
    found = {r.name: r.value for r in rows if r.run == "known" and r.status == "ok"}
    tests = [(i, (i * 5) % n) for i in range(n) if i % 3]
    ranks = [[1 + int((score[u] > score[u, v]).sum()) for u, v in tests], [1 + int((score[:, v] > score[u, v]).sum()) for u, v in tests]]
    for k in (1, 10):
        assert found[f"Hits@{k}"] == pytest.approx(np.mean([np.mean([r <= k for r in side]) for side in ranks]))
    assert found["MRR"] == pytest.approx(np.mean([np.mean([1 / r for r in side]) for side in ranks]))
    # Groups: each entity's three sources, their mean scores, and as many best targets.
    hits = total = predicted = 0
    for e in range(4):
        own = [i for i in range(n) if i % 4 == e]
        best = sorted(range(n), key=lambda v: (-score[own].mean(0)[v], v))[:3]
        hits += len(set(best) & set(own)) + 3
        total, predicted = total + 6, predicted + 6
    micro = next(v for k, v in found.items() if "micro" in k.lower())
    assert micro == pytest.approx(hits / predicted) or micro == pytest.approx((hits - 12) / (predicted - 12))


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.5, 2.0), (4.0, 0.25)])
def test_walks_through_a_hub(spark, p, q):
    """Places are drawn as from the whole list of weights, which is never made."""
    edges = {(0, k) for k in range(1, 400)} | {(k, 0) for k in range(1, 400)} | {(k, k + 1) for k in range(1, 50)} | {(k + 1, k) for k in range(1, 50)} | {(7, 1000)}
    frame = spark.createDataFrame(sorted(edges), "src long, dst long")
    starts = spark.createDataFrame([(k,) for k in (0, 3, 7, 1000)], "node long")
    from kinmap.functions.draws import draw

    got = {(r.start, r.walk_id): list(r.path) for r in sampling.walks(frame, starts, p, q, 6, 5).collect()}
    draws = spark.range(1).select(*[draw("walk", F.lit(s), F.lit(w), F.lit(k)).alias(f"{s}_{w}_{k}") for s in (0, 3, 7, 1000) for w in range(6) for k in range(1, 5)]).first().asDict()
    out = collections.defaultdict(list)
    for s, d in sorted(edges):
        out[s].append(d)
    for start in (0, 3, 7, 1000):
        for w in range(6):
            path = [start]
            for k in range(1, 5):
                near = out[path[-1]]
                if not near:
                    break
                last = path[-2] if k > 1 else None
                weights = [1.0 if k == 1 else 1 / p if x == last else 1.0 if x in out[last] else 1 / q for x in near]
                mark, total = draws[f"{start}_{w}_{k}"] * sum(weights), 0.0
                for x, weight in zip(near, weights):
                    total += weight
                    if total > mark:
                        break
                path.append(x)
            assert got[start, w] == path
