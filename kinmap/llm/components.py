"""Connected components by alternating large-star and small-star steps.

Each task first contracts its own edges to a forest, so that what is shuffled is
at most one edge a vertex and task. Then stars are formed until nothing moves;
rounds grow with the logarithm of the longest path. Each round is checkpointed.
Neighbourhoods are never collected: a step takes each vertex's least neighbour by
an aggregation and joins it back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.session import checkpointed


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vertices of edges a-b and the least vertex of the component of each."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            return names, names[label]
        label = after


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (hi, lo), a forest of each task's edges with the same components."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def shrink() -> None:
            nonlocal a, b
            names, roots = roots_of(a, b)
            keep = names != roots
            a, b = names[keep], roots[keep]

        for batch in batches:
            a = np.concatenate([a, batch.column("a").to_numpy()])
            b = np.concatenate([b, batch.column("b").to_numpy()])
            if len(a) > 2_000_000:
                shrink()
                if len(a) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hi", "lo"])
                    a, b = a[:0], b[:0]
        shrink()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["hi", "lo"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forest, "hi long, lo long")


def lowest(edges: DataFrame) -> DataFrame:
    """(hi, m): the least neighbour of each vertex that has a smaller one."""
    return edges.groupBy("hi").agg(F.min("lo").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Each vertex's larger neighbours linked with its least neighbour, or with itself if it has no smaller one."""
    linked = edges.join(lowest(edges).withColumnRenamed("hi", "lo"), "lo", "left")
    return linked.select("hi", F.coalesce("m", "lo").alias("lo"))  # as many rows as edges


def small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours linked with the least of these."""
    least = lowest(edges)
    down = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return down.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b); component is the least id. Loops are ignored."""
    forest = checkpointed(contracted(edges.where("a <> b")))
    state = None
    for _ in range(rounds):
        forest = checkpointed(small_star(large_star(forest)))
        sums = forest.agg(F.count("*"), F.sum(F.col("hi").cast("decimal(38,0)")), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if sums == state or not sums[0]:
            break
        state = sums
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    leaves = forest.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    tops = forest.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return leaves.union(tops)
