"""What a node's places hold, met in its task: counts and attribute sums against loops."""

import random

import numpy as np
import pytest

from kinmap.operators import local, mapped, shared


def made(seed=6):
    random.seed(seed)
    return {(random.randrange(12), random.randrange(40) * (1 << 33), e) for _ in range(250) for e in [random.randrange(3)]}


@pytest.mark.parametrize("terms", [7, 1 << 21])
def test_counts_by_node_are_those_of_loops(spark, monkeypatch, terms):
    for module in (mapped, local):
        monkeypatch.setattr(module, "TERMS", terms)
    rows = {(g, p, n) for g in (0, 1) for p, n, _ in made(g)} | {(2, 1, 7)}
    want = {}
    for g, p, n in rows:
        want.setdefault(g, set()).update((n, m) for h, q, m in rows if (h, q) == (g, p) and m != n)
    members = spark.createDataFrame(list(rows), "gid int, place long, node long")
    assert {r.gid: r.edges for r in shared.shared_counts(members).collect()} == {g: len(s) for g, s in want.items()}
    plan = shared.counts_by_node(members.where("gid = 0"))._jdf.queryExecution().toString()
    assert "Generate" not in plan  # a member is sent once, not to each of some parts


def test_attribute_sums_are_those_of_loops(spark):
    rows = {(p * 3 + e, n, e) for p, n, e in made()}  # a place has one channel
    units = [(n, a, 0.25 + a + n % 5) for n in {n for _, n, _ in rows} for a in range(2) if (n + a) % 3]
    asked = sorted({n for _, n, _ in rows})[:20]
    x = {}
    for n, a, value in units:
        x.setdefault(n, np.zeros(2))[a] = value
    want = {}
    for n in asked:
        met = {(m, e) for p, k, e in rows if k == n for q, m, f in rows if q == p and m != n}
        for m, e in met:
            for a, value in enumerate(x.get(m, np.zeros(2))):
                if value:
                    want[n, e, a] = want.get((n, e, a), 0) + value / np.sqrt(sum(k == m for k, _ in met))
    tables = [spark.createDataFrame(*t) for t in ((list(rows), "place long, node long, e int"), (units, "node long, a int, value double"), ([(n,) for n in asked], "node long"))]
    got = {(r.node, r.e, r.a): r.value for r in shared.attribute_sums(*tables, 3).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)
