"""Walks, pushes and signatures along mapped edges: the same as by joins, in small parts, and without shuffles by step."""

import random

import numpy as np
import pytest

from kinmap.operators import graph, local, propagate, sampling
from kinmap.operators.mapped import Wide, entries


@pytest.fixture(scope="module")
def edges(spark):
    random.seed(7)
    ends = {(random.randrange(40) - 5, random.randrange(40) - 5) for _ in range(150)} | {(3, k) for k in range(-5, 35)}
    return spark.createDataFrame([(g, a + g, b, 1.0 + (a + b) % 3) for g in (0, 1) for a, b in sorted(ends)], "gid int, src long, dst long, w double")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_of_rows_in_parts():
    parts = [(np.array([2, 4]), np.array([0, 2, 3]), np.array([7, 8, 9]), np.array([0.5, 1.0, 2.0])), None, (np.array([-1]), np.array([0, 1]), np.array([5]), np.array([3.0]))]
    parts = [parts[0], None, parts[2]]
    rows = np.array([3, -1, 1, 2])  # modulo 3: 0, 2, 1, 2
    size, to, w = entries(parts, rows)
    assert (size.tolist(), to.tolist(), w.tolist()) == ([0, 1, 0, 0], [5], [3.0])
    size, to, _ = entries(parts[:1], np.array([4, 3, 2]))
    assert (size.tolist(), to.tolist()) == ([1, 0, 2], [9, 7, 8])
    with pytest.raises(Wide):
        entries(parts[:1], np.array([4, 2]), 2)


def test_wide_groups_are_cut_in_halves(monkeypatch):
    monkeypatch.setattr(local, "TERMS", 4)

    def made(rows, most):
        if most is not None and rows[0].sum() > most:
            raise Wide
        return rows

    rows = (np.array([1, 1, 1, 9, 2, 2]),)
    got = [r[0].tolist() for r in local.in_halves(made, rows, np.array([0, 2, 3, 4]))]
    assert [x for r in got for x in r] == rows[0].tolist() and [9] in got and len(got) > 2


def test_pushes_of_a_key_are_not_shuffled(spark, edges):
    one = edges.where("gid = 0")
    anchors = spark.createDataFrame([(1, 1), (3, 3), (3, 3), (20, 3), (99, 4)], "node long, key long")
    for bound, every in ((1e-3, 4), (1e-2, 3), (0.9, 4)):
        found = propagate.pushed_walk(one, anchors, 0.15, bound, merge_every=every)
        assert "hashpartitioning(u" in plan_of(found) and "HashAggregate(keys=[u#" not in plan_of(found).split("MapInArrow")[0]
        got = {(r.node, r.key): r.value for r in found.collect()}
        want = {(r.node, r.key): r.value for r in propagate.pushed_walk(one, anchors, 0.15, bound, merge_every=every, most_rows=10**6).collect()}
        assert got and got.keys() == want.keys() and got == pytest.approx(want)


def test_signatures_are_those_of_words(spark, edges, monkeypatch):
    nodes = spark.createDataFrame([(g, n) for g in (0, 1) for n in range(-5, 30)], "gid int, node long")  # some ends of edges are no nodes
    found = graph.degree_signature(nodes, edges)
    assert "MapInArrow" in plan_of(found)  # a row a word of reached nodes was shuffled before
    got = {(r.gid, r.node, r.bucket): r.value for r in found.collect()}
    monkeypatch.setattr(graph, "mounted", lambda df: None)
    # By words, ends that are no nodes have rows of their own, which the SQL does not have.
    want = {(r.gid, r.node, r.bucket): r.value for r in graph.degree_signature(nodes, edges).collect() if r.node < 30}
    assert got and got.keys() == want.keys() and got == pytest.approx(want)


@pytest.mark.parametrize("p,q", [(0.5, 2.0), (4.0, 0.25), (1.0, 1.0)])
def test_walks_are_those_of_joins(spark, edges, monkeypatch, p, q):
    one = edges.where("gid = 0 AND src <> 7")
    starts = spark.createDataFrame([(k,) for k in (*range(-5, 35), 99)], "node long")
    found = sampling.walks(one, starts, p, q, 2, 5)
    assert "Join" not in plan_of(found)  # every step was joined and shuffled before
    rows = lambda t: {(r.start, r.walk_id): list(r.path) for r in t.collect()}
    got = rows(found)
    monkeypatch.setattr(sampling, "mounted", lambda df: None)
    assert got == rows(sampling.walks(one, starts, p, q, 2, 5)) and len(got) == 82
