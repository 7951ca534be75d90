"""Weighted draws meet few shares each, however many there are."""

import collections

from pyspark.sql import functions as F

from kinmap.operators import sampling


def test_a_weighted_draw_meets_few_shares(spark):
    n = 4000
    shares = spark.range(n).select(F.lit(0).alias("gid"), F.col("id").alias("node"), F.lit(1.0 / n).alias("p"))
    table, sizes = sampling.cumulative(shares, ["gid"])
    assert sizes.first().cells >= n
    cells = collections.Counter(r.cell for r in table.collect())
    assert max(cells.values()) <= 3  # 16 and more with a fixed number of cells
    draws = spark.range(2000).select(F.lit(0).alias("gid"), "id", ((F.col("id") + 0.5) / 2000).alias("u"))
    got = {r.id: r.picked for r in sampling.weighted_pick(draws, shares, ["gid"]).collect()}
    assert len(got) == 2000 and all(abs(v - 2 * k) <= 1 for k, v in got.items())


def test_wide_shares_are_listed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LISTED", 3)
    rows = [("a", 0, 0.9)] + [("a", k, 0.1 / 40) for k in range(1, 41)] + [("b", 7, 1.0)] + [("b", 8, 0.0)]
    shares = spark.createDataFrame(rows, "g string, node long, p double")
    draws = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 0.8999), ("a", 0.90001), ("a", 0.9999), ("b", 0.0), ("b", 1 - 2.0**-52), ("c", 0.1)], "g string, u double")
    got = {(r.g, r.u): r.picked for r in sampling.weighted_pick(draws, shares, ["g"]).collect()}
    assert got == {("a", 0.0): 0, ("a", 0.5): 0, ("a", 0.8999): 0, ("a", 0.90001): 1, ("a", 0.9999): 40, ("b", 0.0): 7, ("b", 1 - 2.0**-52): 7}
    low, high = sampling.cumulative(shares, ["g"])[0].agg(F.min("cell"), F.count("*")).first()
    assert low == 0 and high <= 2 * (64 + 2) + 41
