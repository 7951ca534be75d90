"""Pairs of nodes that share a place, counted without a row a pair."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.operators.local import Rows, dealt, in_halves
from kinmap.operators.mapped import Mapped, entries, mounted
from kinmap.session import checkpointed


def distinct_partners(group: pd.DataFrame, cells: int = 1 << 22) -> int:
    """How many pairs of a left and another right node share a place, from rows (place, node, side); some million at a time."""
    left, right = group[group.side <= 0], group[group.side >= 0]
    nodes, own = np.unique(left.node.to_numpy(), return_inverse=True)
    others, theirs = np.unique(right.node.to_numpy(), return_inverse=True)
    order = np.argsort(right.place.to_numpy(), kind="stable")
    places, theirs = right.place.to_numpy()[order], theirs[order]
    by_node = np.argsort(own, kind="stable")
    own, left_places = own[by_node], left.place.to_numpy()[by_node]
    start, end = np.searchsorted(places, left_places), np.searchsorted(places, left_places, "right")
    met = np.concatenate([[0], np.cumsum(end - start)])
    firsts = np.searchsorted(own, np.arange(len(nodes) + 1))  # a node's rows stay together
    ahead, found, k = met[firsts], 0, 0
    while k < len(nodes):
        until = max(k + 1, int(np.searchsorted(ahead, ahead[k] + cells, "right")) - 1)
        rows = slice(firsts[k], firsts[until])
        sizes = (end - start)[rows]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        u, v = np.repeat(own[rows], sizes), theirs[np.repeat(start[rows], sizes) + inside]
        keys = np.sort((u * len(others) + v)[nodes[u] != others[v]])
        found += len(keys) and 1 + int(np.count_nonzero(keys[1:] != keys[:-1]))
        k = until
    return found


def firsts(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Where each key stands for the last time; `seen` has a cell for every key, and what is in it does not matter."""
    order = np.arange(len(keys), dtype=seen.dtype)
    seen[keys] = order
    return np.flatnonzero(seen[keys] == order)


def met_by_node(members: DataFrame, asked: DataFrame, made: Callable, columns: list[str], schema: str) -> DataFrame:
    """What `made(node place, met node places, their e, node ids)` gives for each asked node, from distinct members (node, place, e).

    `asked` are rows (node, place) of the nodes asked for. Members of a place are mapped, and a node's
    are met in one task, some million at a time, so a member is sent once and no pair is a row.
    """
    ids = np.sort(members.select("node").distinct().toArrow().column("node").to_numpy())
    name = f"{mounted(members)}/ids-{uuid.uuid4().hex}.npy"
    np.save(name, ids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.load(name)
        for batch in batches:
            to = pa.array(np.searchsorted(known, batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), to, batch.column(2)], ["place", "to", "w"])

    rows = members.select(F.col("place").cast("long"), F.col("node").cast("long"), F.col("e").cast("double"))
    matrix = Mapped.of(checkpointed(rows.mapInArrow(placed, "place long, to long, w double")), "place")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known = matrix.load(), np.load(name)

        def found(rows: Rows, most: int | None) -> list:
            size, to, e = entries(parts, rows[1], most)
            e = e.astype(np.int64)
            edge = np.append(np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])), len(rows[0]))
            ahead = np.append(0, np.cumsum(size))[edge]
            own = np.searchsorted(known, rows[0][edge[:-1]])
            return [made(int(n), to[a:b], e[a:b], known) for n, a, b in zip(own, ahead[:-1], ahead[1:])]

        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def outs(rows: Rows) -> Iterator[pa.RecordBatch]:
            groups = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if len(rows[0]) else np.zeros(0, np.int64)
            if len(groups):
                for tables in in_halves(found, rows, groups):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*tables)], columns)

        for batch in batches:
            if batch.num_rows:
                left = tuple(np.concatenate([a, c.to_numpy()]) for a, c in zip(left, batch.columns))
                cut = int(np.searchsorted(left[0], left[0][-1]))  # the last node can go on in the next batch
                yield from outs(tuple(c[:cut] for c in left))
                left = tuple(c[cut:] for c in left)
        yield from outs(left)

    rows = dealt(asked.select(F.col("node").cast("long"), F.col("place").cast("long")), "node").sortWithinPartitions("node")
    return rows.mapInArrow(meet, schema)


def counts_by_node(members: DataFrame) -> DataFrame:
    """(edges): ordered pairs of different nodes that share a place, each once, of distinct members (place, node)."""
    seen = np.zeros(0, np.int32)

    def count(node: int, to: np.ndarray, _: np.ndarray, ids: np.ndarray) -> tuple[list, ...]:
        nonlocal seen
        seen = seen if len(seen) == len(ids) else np.zeros(len(ids), np.int32)
        return ([len(firsts(to, seen)) - 1],)

    return met_by_node(members.withColumn("e", F.lit(0)), members, count, ["n"], "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


def attribute_sums(members: DataFrame, nodes: DataFrame, asked: DataFrame, channels: int) -> DataFrame:
    """(node, e, a, value): unit attributes (node, a, value) summed over the nodes met, an edge's channels of one length in all.

    members (node, place, e) are distinct; two nodes have an edge where they share a place, with a
    channel for each e that they share.
    """
    asked = members.join(asked.select("node").distinct(), "node", "left_semi")
    width = 1 + (nodes.agg(F.max("a")).first()[0] or 0)
    row = [F.coalesce(F.sum(F.when(F.col("a") == a, F.col("value"))), F.lit(0.0)) for a in range(width)]
    lists = nodes.groupBy("node").agg(F.array(*row).alias("x")).toArrow()
    order = np.argsort(lists.column("node").to_numpy())
    names, values = lists.column("node").to_numpy()[order], np.asarray(lists.column("x").combine_chunks().flatten()).reshape(-1, width)[order]
    held = nodes.sparkSession.sparkContext.broadcast((names, values))
    state: dict[str, np.ndarray] = {}

    def sums(node: int, to: np.ndarray, e: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        if "x" not in state:
            names, values = held.value
            at = np.minimum(np.searchsorted(names, ids), max(0, len(names) - 1))
            state["x"] = np.where((names[at] == ids)[:, None], values[at], 0.0) if len(names) else np.zeros((len(ids), width))
            state["seen"], state["several"] = np.zeros(len(ids) * channels, np.int32), np.zeros(len(ids), np.int64)
        key = to * channels + e
        key = key[firsts(key, state["seen"])]
        other, e = np.divmod(key, channels)
        other, e = other[other != node], e[other != node]
        state["several"][other] = 0
        np.add.at(state["several"], other, 1)
        weight = 1 / np.sqrt(state["several"][other])
        out = np.stack([weight[e == k] @ state["x"][other[e == k]] for k in range(channels)])
        k, a = np.nonzero(out)
        return np.full(len(k), ids[node]), k, a, out[k, a]

    return met_by_node(members, asked.select("node", "place"), sums, ["node", "e", "a", "value"], "node long, e long, a long, value double")


def shared_counts(members: DataFrame, parts: int | None = None) -> DataFrame:
    """(gid, edges): ordered pairs of different nodes that share a place, each once, from distinct members(gid, place, node).

    Members of a place are files that tasks map, and a node's are met in one task. With a number of
    `parts`, or where files can't be mapped, nodes are dealt to parts, and each two parts are met in a task that counts their pairs, so
    no pair is a row: a member is sent `parts` times, whatever the sizes of places are.
    """
    if parts is None and mounted(members):
        spark, kept = members.sparkSession, checkpointed(members)
        gids = sorted(r.gid for r in kept.select("gid").distinct().collect())
        each = [counts_by_node(kept.where(F.col("gid") == g)).select(F.lit(g).alias("gid"), "edges") for g in gids]
        return reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], "gid int, edges long")
    parts = parts or 8
    part = F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other")
    sent = members.select("gid", "place", "node", part.alias("part"), other)
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), -1).otherwise(1)
    sent = sent.select("gid", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "place", "node", side.cast("byte").alias("side"))

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        gid, i, j = key
        return pd.DataFrame({"gid": [gid], "n": [distinct_partners(group) * (1 if i == j else 2)]})

    counts = sent.groupBy("gid", "i", "j").applyInPandas(count, "gid int, n long")
    return counts.groupBy("gid").agg(F.sum("n").alias("edges"))
