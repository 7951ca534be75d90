"""Links in buckets: joins as with plain tables, hubs in parts, and no exchange of the links."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap.operators import align, links, propagate


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def edges(spark):
    """A third of all edges leaves node 0; edges may stand twice."""
    draw = np.random.default_rng(5)
    rows = [(0, int(b), 1.0) for b in draw.integers(0, 40, 200)] + [(int(a), int(b), 1.0) for a, b in draw.integers(0, 40, (400, 2))]
    return spark.createDataFrame(rows, "src long, dst long, w double").select(F.lit(0).alias("gid"), "*")


def test_rows_of_hubs_are_dealt_over_parts(spark, edges):
    plain = edges.select(F.col("src").alias("v"), "dst", "w")
    got = links.linked(plain, ["v"], most_rows=10)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hubs = {r.v: r.parts for r in got.hubs.collect()}
    sizes = collections.Counter(r.v for r in plain.collect())
    assert hubs == {v: -(-n // (600 // buckets)) for v, n in sizes.items() if n > 600 // buckets} and 0 in hubs
    assert len(hubs) < buckets
    assert got.rows.where("v = 0").select("part").distinct().count() == hubs[0]
    table = spark.createDataFrame([(v, k) for v in range(-1, 41) for k in range(3)] + [(0, 0)], "v long, k int")
    rows = lambda t: sorted(tuple(r) for r in t.select("v", "k", "dst", "w").collect())
    assert rows(got.join(table)) == rows(table.join(plain, "v"))


def test_links_in_buckets_are_not_shuffled(spark, edges):
    got = links.linked(edges.select(F.col("src").alias("v"), "dst", "w"), ["v"], most_rows=10)
    table = spark.range(1000).select((F.col("id") % 50).alias("v"), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(got.join(table))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Bucketed: true" in plan


def test_empty_links_and_several_keys(spark, edges):
    none = links.linked(edges.where("false").select("src", "dst", "w"), ["src", "dst"], most_rows=-1)
    assert none.hubs.isEmpty() and none.join(edges.select("src", "dst", "gid")).isEmpty()
    both = links.linked(edges.select("src", "dst", "w"), ["src", "dst"], most_rows=10)
    pairs = edges.select("src", "dst").distinct()
    assert both.join(pairs).count() == edges.count()


def test_steps_are_the_same_from_buckets(spark, edges, monkeypatch):
    anchors = spark.createDataFrame([(1, 1), (5, 6), (0, 0)], "u long, v long")
    starts = spark.createDataFrame([(1, 1), (0, 0)], "node long, key long")

    def found():
        scores = align.consistency(edges, edges, anchors, iterations=3)
        walks = propagate.pushed_walk(edges, starts, bound=1e-4)
        values = starts.withColumn("value", F.lit(1.0))
        folded = propagate.personalised(edges, values, 0.3, 3)
        restarted = propagate.restart_walk(edges, edges.select(F.col("src").alias("node")).distinct(), starts, iterations=2)
        return [{(r[0], r[1]): r[2] for r in t.collect()} for t in (scores, walks, folded, restarted)]

    want = found()
    linked = links.linked
    for module in (align, propagate):
        monkeypatch.setattr(module, "linked", lambda rows, keys: linked(rows, keys, most_rows=10))
    for a, b in zip(found(), want):
        assert a.keys() == b.keys() and a == pytest.approx(b)
