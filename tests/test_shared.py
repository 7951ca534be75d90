"""Counts of pairs that share a place against plain loops, and that no pair becomes a row."""

import random

from kinmap.operators import shared


def test_shared_counts_are_those_of_loops(spark):
    random.seed(5)
    rows = {(g, random.randrange(12), random.randrange(60) * (1 << 33)) for g in (0, 1) for _ in range(300)}
    rows |= {(2, 1, 7), (2, 2, 8)}  # alone at their places
    want = {}
    for g, p, n in rows:
        want.setdefault(g, set()).update((n, m) for h, q, m in rows if (h, q) == (g, p) and m != n)
    members = spark.createDataFrame(list(rows), "gid int, place long, node long")
    for parts in (1, 3, 8):
        assert {r.gid: r.edges for r in shared.shared_counts(members, parts).collect()} == {g: len(s) for g, s in want.items()}


def test_partners_are_counted_some_at_a_time():
    import pandas as pd

    rows = pd.DataFrame([(p, n, 0) for p in range(3) for n in range(p, 20)], columns=["place", "node", "side"])
    assert shared.distinct_partners(rows, cells=7) == shared.distinct_partners(rows) == 20 * 19


def test_summary_counts_edges_without_pairs(spark, tmp_path):
    """Everyone ordered on one day: some 10^8 pairs would not be summed in rows here."""
    from kinmap.operators import graph
    from kinmap.sources import fixtures as fx

    n = 8000
    spark.range(n).selectExpr("id AS c_custkey", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(2 * n).selectExpr("id AS o_orderkey", "id DIV 2 AS o_custkey", "DATE '1995-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = graph.summary(fx.order_days(spark, str(tmp_path)), fx.day_edges(spark, str(tmp_path))).collect()
    assert sorted((r.gid, r.nodes, r.edges, r.edge_width, r.train + r.test) for r in rows) == [(g, n, n * (n - 1), 5, n) for g in (0, 1)]
