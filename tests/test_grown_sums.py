"""Anchor growth sums pairs where they are made."""

import random

from kinmap.operators import mapped, propagate


def test_sums_by_either_end_are_the_same_to_the_bit(spark):
    random.seed(3)
    rows = lambda: [(a, k, random.random()) for a in range(12) for k in random.sample(range(30), 20)]
    one, two = spark.createDataFrame(rows(), "u long, mid long, w double"), spark.createDataFrame(rows(), "v long, mid long, w double")
    found = [{(r.u, r.v): r.score for r in mapped.path_sums(one, two, end).collect()} for end in ("u", "v")]
    assert len(found[0]) == 144 and found[0] == found[1]


def test_growth_joins_no_pairs(spark, monkeypatch):
    edges = spark.createDataFrame([(a, b) for k in range(8) for a, b in ((k, k + 1), (k + 1, k))], "src long, dst long")
    anchors = spark.createDataFrame([(0, 0), (4, 4)], "u long, v long")
    asked = []
    sums = propagate.path_sums
    monkeypatch.setattr(propagate, "path_sums", lambda one, two, end: asked.append(end) or sums(one, two, end))
    got = {(r.u, r.v) for r in propagate.grown_anchors(edges, edges, anchors, 1).collect()}
    assert asked == ["u", "v"]  # all pairs of nodes with a common key were joined and shuffled before
    assert {(0, 0), (4, 4)} < got
