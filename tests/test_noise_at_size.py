"""Noise draws once a value and in many tasks."""

import pytest
from pyspark.sql import functions as F

from kinmap.operators import noise


@pytest.mark.parametrize("change", [lambda n: noise.flip_attributes(n, 0.4), lambda n: noise.gaussian_attributes(n, 0.5)])
def test_noise_on_nodes_of_one_file_is_many_tasks(spark, change):
    nodes = spark.range(40).coalesce(1).select(F.lit(1).alias("gid"), F.col("id").alias("node"), F.array(*[(F.col("id") % (k + 2) == 0).cast("double") for k in range(5)]).alias("x"))
    made = change(nodes)
    assert made.count() == 40
    assert made.rdd.getNumPartitions() > 1


def test_a_flip_draws_once_a_value(spark):
    nodes = spark.createDataFrame([(0, 1, [0.0, 1.0, 1.0]), (0, 2, []), (1, 3, None), (1, 4, [1.0, None])], "gid int, node long, x array<double>")
    made = noise.flip_attributes(nodes, 0.5)
    # Draws were made again for every value of the list that their order was looked up for.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and plan.count("md5") == 1
    got = {r.node: r.x for r in made.collect()}
    assert got[2] == [] and got[3] is None and len(got[4]) == 2
    assert sum(a != b for a, b in zip(got[1], [0.0, 1.0, 1.0])) == 1
