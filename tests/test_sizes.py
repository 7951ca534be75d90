"""Steps that must not put a graph in one task, a row a task of the driver's, or a row a pair and attribute."""

import numpy as np
from pyspark.sql import functions as F

from kinmap.operators import align, graph
from kinmap.sources.fixtures import NetworkSet


def test_ranges_of_small_parts_are_not_ever_more(spark):
    assert graph.range_parts(spark.range(5000), 1) == graph.MOST_PARTS
    assert graph.range_parts(spark.range(5000), 1000) == 5
    rows = spark.range(2500).select((-F.col("id")).alias("x"))
    got = {r.x: r.id for r in graph.dense_ids(rows, ["x"], per_part=1).collect()}
    assert got == {x: k for k, x in enumerate(range(-2499, 1))}


def test_edges_are_not_dealt_by_graph_to_be_validated(spark):
    nodes = spark.range(4).select((F.col("id") % 2).cast("int").alias("gid"), F.floor(F.col("id") / 2).alias("node"), F.lit(None).cast("array<double>").alias("x"))
    edges = spark.createDataFrame([(0, 0, 1), (1, 0, 5), (1, -1, 0)], "gid int, src long, dst long")
    anchors = spark.createDataFrame([(0, [0, 7])], "aid long, nodes array<long>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.violations(NetworkSet(nodes, edges, anchors), [0, 1])
        assert {tuple(r) for r in found.collect()} == {("edge_range", 1, 2), ("anchor_range", 1, 1)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan  # edges and anchors were dealt by graph before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def tables(spark):
    draw = np.random.default_rng(5)
    values = lambda: [[float(x) for x in draw.integers(0, 3, 3)] for _ in range(6)]
    nodes = spark.createDataFrame([(k, x) for k, x in enumerate(values())], "node long, x array<double>")
    edges = [(int(s), int(d), [float(x) for x in draw.integers(0, 3, 4)]) for s, d in draw.integers(0, 6, (25, 2))]
    return nodes, spark.createDataFrame([*edges, edges[0], (0, 9, None)], "src long, dst long, edge_attr array<double>"), edges


def test_edge_parts_are_units_of_the_greatest(spark):
    _, edges, rows = tables(spark)
    got = {(r.src, r.dst, r.e): r.w for r in align.edge_parts(edges, True).collect()}
    want = {}
    for s, d in {(s, d) for s, d, _ in rows}:
        own = [x for a, b, x in [*rows, rows[0]] if (a, b) == (s, d)]
        top = np.max(own, axis=0)
        want |= {(s, d, e): top[e] / np.linalg.norm(top) * len(own) for e in np.flatnonzero(top)}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_products_of_packed_rows_are_those_by_place(spark, monkeypatch):
    nodes, edges, _ = tables(spark)
    x = align.unit_attributes(nodes, True)
    k = align.kronecker_parts(nodes, align.edge_parts(edges, True), x)
    pairs = spark.range(36).select(F.floor(F.col("id") / 6).alias("u"), (F.col("id") % 6).alias("v"))
    found = align.scaled_similarity(pairs, x, x, k, k)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # a row a pair and attribute was summed before
    got = {(r.u, r.v): r.n for r in found.collect()}
    monkeypatch.setattr(align, "PACKED", 0)
    want = {(r.u, r.v): r.n for r in align.scaled_similarity(pairs, x, x, k, k).collect()}
    assert got and got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in want)
