"""Queries work on all rows of their tables, not on an id subset."""

import glob
import hashlib
import math
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def oracle():
    import __spark_entry__ as entry

    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = entry.oracle_sql()
    return lambda name: [tuple(r) for r in db.execute(found[name]).fetchall()]


def rows(spark, name):
    import __spark_entry__ as entry

    return [tuple(r) for r in entry.queries()[name](spark, DATA).collect()]


def near(got, expected):
    """Equal keys, and last values equal to 2e-6."""
    got, expected = sorted(got), sorted(expected)
    assert [r[:-1] for r in got] == [r[:-1] for r in expected]
    assert all(abs(g[-1] - e[-1]) <= 2e-6 for g, e in zip(got, expected))


def cluster_tuples(spark):
    """Node tuples of all vectors, by label and run of 120 ids."""
    sides = {}
    for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label").collect():
        node = r.vec_id // 2
        key = (r.label, node // 120)
        sides.setdefault((key, r.vec_id % 2), []).append(node)
    keys = {k for k, _ in sides}
    side = lambda k, g: sides.get((k, g), [])
    return sorted((a, b, c) for k in keys for a in side(k, 0) for b in side(k, 1) for c in side(k, 0) if c % 3 == 0)


def test_tuple_costs_of_all_vectors(spark, oracle):
    got = rows(spark, "g24_tuple_costs")
    assert sorted(r[1:4] for r in got) == cluster_tuples(spark)
    near(got, oracle("g24_tuple_costs"))


def test_plans_of_all_vectors(spark):
    got = rows(spark, "g25_multi_marginal")
    assert sorted(r[1:4] for r in got) == cluster_tuples(spark)
    assert all(r[4] >= 0 for r in got)


def test_noise_on_all_positions(spark, oracle):
    got = rows(spark, "f5_gaussian_attributes")
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert sorted(r[:3] for r in got) == [(g, n, p) for g in (0, 1) for n in range(vectors // 2) for p in range(64)]
    near(got, oracle("f5_gaussian_attributes"))


def test_anchors_that_miss_both_graphs_are_dropped(spark, oracle):
    from kinmap.sources import fixtures as fx

    ids = {r.src for r in fx.chains(spark, DATA).edges.select("src").distinct().collect()}
    got = rows(spark, "b3_multiway_anchors")
    assert sorted(got) == sorted((i, i, i) for i in ids if i % 5)
    assert sorted(got) == sorted(oracle("b3_multiway_anchors"))


def test_anchors_get_all_contexts(spark):
    from kinmap.sources import fixtures as fx

    net = fx.event_walks(spark, DATA)
    train = {r.u for r in net.pairs("train").collect()}
    expected = {(r.src, r.dst) for r in net.graph(0).collect() if r.src in train}
    sizes = [sum(s == u for s, _ in expected) for u in train]
    assert 20 < max(sizes) <= 100
    assert sorted(rows(spark, "f16_anchor_contexts")) == sorted(expected)


def test_mismatches_with_landmarks_by_hash(spark, oracle):
    segment = {r.c_custkey: r.c_mktsegment for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    count = int(10 * math.log2(len(segment)))
    landmarks = sorted(segment, key=lambda k: (hashlib.md5(f"landmark:1:{k}".encode()).hexdigest(), k))[:count]
    got = rows(spark, "e5_attribute_mismatches")
    assert sorted(got) == sorted((u, v, 2 * (segment[u] != segment[v])) for u in segment for v in landmarks)
    assert sorted(got) == sorted(oracle("e5_attribute_mismatches"))


def test_isolated_nodes_are_those_without_edges(spark):
    from kinmap.sources import fixtures as fx

    linked = {r.src for r in fx.chains(spark, DATA).graph(0).select("src").distinct().collect()}
    nodes = {r.node for r in fx.vectors(spark, DATA).where("gid = 0").select("node").collect()}
    got = rows(spark, "c12_isolated_links")
    assert nodes - linked and {frozenset(r[:2]) for r in got} == {frozenset((a, b)) for a in nodes - linked for b in nodes if a != b}
