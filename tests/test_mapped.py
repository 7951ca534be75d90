"""Consistency steps by mapped matrices against broadcast links, in small parts and sums, and what they shuffle."""

import functools
import random

import numpy as np
import pyarrow as pa
import pytest

from kinmap.operators import align, mapped


@pytest.fixture(scope="module")
def edges(spark):
    random.seed(11)
    ends = [(random.randrange(30) - 5, random.randrange(30) - 5) for _ in range(150)] + [(k, 3) for k in range(25)]
    return spark.createDataFrame([(0, a, b, 1.0 + (a + b) % 3) for a, b in ends], "gid int, src long, dst long, w double")


def test_mapped_steps_are_those_of_broadcast_links(spark, edges, monkeypatch):
    anchors = spark.createDataFrame([(1, 1), (5, 6), (0, 0), (5, 6), (99, 99)], "u long, v long")
    found = lambda: [{(r.u, r.v): r.score for r in t.collect()} for t in (align.consistency(edges, edges, anchors, iterations=3), align.consistency_by_change(edges, edges, anchors, bound=1e-3))]
    want = found()
    few = functools.partial(mapped.Mapped.of, part_rows=40)
    monkeypatch.setattr(align.Mapped, "of", few)
    of = align.Steps.of
    monkeypatch.setattr(align.Steps, "of", lambda one, two: of(one, two, most_rows=10))
    assert align.Steps.of(edges, edges).w2.parts > 2
    for a, b in zip(found(), want):
        assert a.keys() == b.keys() and a == pytest.approx(b)
    plan = align.consistency(edges, edges, anchors, iterations=1)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # The sums by pair are the last step, and nothing is shuffled by pair.
    assert "MapInArrow" in plan.splitlines()[2] + plan.splitlines()[3] and "hashpartitioning(u" in plan and "hashpartitioning(u#0L, v" not in plan


def test_sums_are_cut_between_rows_of_u(monkeypatch):
    part = (np.array([2, 4]), np.array([0, 2, 3]), np.array([7, 8, 7]), np.array([0.5, 1.0, 2.0]))
    rows = [np.array([1, 1, 1, 2, 3, 3]), np.array([2, 4, 9, 5, 4, 4]), np.array([1.0, 10.0, 5.0, 1.0, 1.0, 2.0]), np.array([False, False, True, False, False, False])]
    for terms in (1, 3, 100):
        monkeypatch.setattr(mapped, "TERMS", terms)
        got = pa.Table.from_batches(list(mapped.products(rows, [part], 2.0)))
        assert sorted(zip(*(got.column(k).to_pylist() for k in range(3)))) == [(1, 7, 41.0), (1, 8, 2.0), (1, 9, 5.0), (3, 7, 12.0)]
