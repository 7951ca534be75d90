"""Propagation over graphs: vectors are long rows (node, key, value), edges (src, dst, w) of one graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.operators.align import MOST_PAIRS, by_change
from kinmap.operators.blocks import in_small_batches
from kinmap.operators.graph import degree_shares, single_hop, stochastic, with_end_in  # noqa: F401
from kinmap.operators.links import Links, linked
from kinmap.operators.local import pushed_here
from kinmap.operators.mapped import mounted, path_sums
from kinmap.operators.ranking import mutual_best
from kinmap.session import checkpointed


def node_links(edges: DataFrame) -> Links:
    """Links (node, dst, w) for the steps that push along the same edges."""
    return linked(edges.select(F.col("src").alias("node"), "dst", "w"), ["node"])


def push(edges: DataFrame | Links, values: DataFrame) -> DataFrame:
    """Each node's values sent along its edges and summed at their ends; steps that repeat give links in place of edges."""
    if isinstance(edges, Links):
        sent = edges.join(values)
    else:
        sent = edges.select(F.col("src").alias("node"), "dst", "w").join(values, "node")
    return sent.groupBy(F.col("dst").alias("node"), "key").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def added(*parts: tuple[Column | float, DataFrame]) -> DataFrame:
    """The weighted sum of value tables; absent values are 0."""
    rows = None
    for weight, table in parts:
        one = table.select("node", "key", (F.col("value") * weight).alias("value"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("node", "key").agg(F.sum("value").alias("value"))


#: Rows made at once of levels and own values.
MADE = 1 << 18


@dataclass(frozen=True)
class Levelled:
    """Values (node, key, value) of all nodes and keys, as a level a node and what single keys have over it.

    levels(node, value), own(node, key, value), keys(key). `own` has at most one row a node
    and key; a node of `own` without a level has its own keys alone.
    """

    levels: DataFrame
    own: DataFrame
    keys: DataFrame

    def kept(self) -> Levelled:
        return Levelled(*map(checkpointed, (self.levels, self.own, self.keys)))

    def rows(self) -> DataFrame:
        """A row a node and key, made where a node's own keys are: only these are shuffled."""
        keys = np.sort(self.keys.toArrow().column("key").to_numpy())
        spark = self.keys.sparkSession
        in_small_batches(spark)
        shared = spark.sparkContext.broadcast(keys)
        lists = self.own.groupBy("node").agg(F.collect_list("key").alias("keys"), F.collect_list("value").alias("values"))
        met = self.levels.select("node", F.col("value").alias("level")).join(lists, "node", "full_outer").select("node", "level", "keys", "values")
        # What is made is far more than what is shuffled, so its tasks are not to be merged by bytes.
        met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node")

        def of_node(level: float | None, own: pa.Scalar, values: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            own, values = (np.zeros(0, t) if x.values is None else x.values.to_numpy() for x, t in ((own, np.int64), (values, float)))
            if level is None:
                return own, values
            out = np.full(len(shared.value), level)
            out[np.searchsorted(shared.value, own)] += values
            return shared.value, out

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made, size = [], 0
                for k in range(len(batch)):
                    node, level, own, values = (c[k] for c in batch.columns)
                    found = of_node(level.as_py(), own, values)
                    made.append((np.full(len(found[0]), node.as_py(), np.int64), *found))
                    size += len(found[0])
                    if size > MADE or k + 1 == len(batch):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], ["node", "key", "value"])
                        made, size = [], 0

        return met.mapInArrow(spread, "node long, key long, value double")

    def units(self) -> Levelled:
        """The nodes' rows as unit vectors, which are levels and own values too."""
        sums = self.own.groupBy("node").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
        size, level = F.lit(float(self.keys.count())), F.coalesce("value", F.lit(0.0))
        norm = F.sqrt(size * level * level + 2 * level * F.coalesce("s", F.lit(0.0)) + F.coalesce("q", F.lit(0.0)))
        norms = checkpointed(self.levels.join(sums, "node", "full_outer").select("node", norm.alias("norm")))
        over = lambda t: t.join(norms, "node").withColumn("value", F.col("value") / F.col("norm")).drop("norm")
        return Levelled(over(self.levels), over(self.own), self.keys)


def restart_walk(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, restart: float = 0.15, iterations: int = 1000, tolerance: float = 1e-6, connect_isolated: bool = False, check_every: int = 5) -> DataFrame:
    """Random walk with restart from each anchor (node, key): (node, key, value), all ones at first.

    An isolated node sends nothing, or, connected, the same to every node: one
    number an anchor, which is added to all nodes without edges for it.
    """
    return levelled_walk(edges, nodes, anchors, restart, iterations, tolerance, connect_isolated, check_every).rows()


def levelled_walk(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, restart: float = 0.15, iterations: int = 1000, tolerance: float = 1e-6, connect_isolated: bool = False, check_every: int = 5) -> Levelled:
    """The values of `restart_walk`: what comes of the ones is the same for every key, the rest has rows where walks have come."""
    steps = node_links(stochastic(edges.select(F.lit(0).alias("gid"), "src", "dst", "w")))
    keys = checkpointed(anchors.select("key").distinct())
    starts = anchors.select("node", "key", F.lit(1.0).alias("value"))
    every = nodes.select("node", F.lit(0).cast("long").alias("key"))
    lone = checkpointed(nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti"))
    size = nodes.count() if connect_isolated else 0
    levels, own = every.withColumn("value", F.lit(1.0)), starts.where(F.lit(False))
    for k in range(iterations):
        level = added((1 - restart, push(steps, levels)), (0.0, levels))
        after = added((1 - restart, push(steps, own)), (restart, starts), (0.0, own))
        if connect_isolated:
            sent = lambda t: t.join(lone, "node", "left_semi").groupBy("key").agg((F.sum("value") / size * (1 - restart)).alias("extra"))
            even = sent(levels).select("extra")  # one row, or none without isolated nodes
            level = level.join(F.broadcast(even), how="left").select("node", "key", (F.col("value") + F.coalesce("extra", F.lit(0.0))).alias("value"))
            # Keys whose walks reach isolated nodes get the same at all nodes.
            reached = sent(own).where("extra <> 0")
            after = added((1.0, after), (1.0, level.select("node").crossJoin(reached).select("node", "key", F.col("extra").alias("value"))))
        if (k + 1) % check_every and k + 1 < iterations:
            levels, own = level, after
            continue
        level, after = checkpointed(level), checkpointed(after)
        change = greatest_change(level, levels, after, own, keys) if k + 1 < iterations else 0
        levels, own = level, after
        if change is None or change < tolerance:
            break
    return Levelled(levels.select("node", "value"), own, keys)


def greatest_change(level: DataFrame, levels: DataFrame, after: DataFrame, own: DataFrame, keys: DataFrame) -> float | None:
    """The greatest change of a node's value for a key; a node whose keys all have their own values has no other."""
    moved = added((1.0, level), (-1.0, levels)).select("node", F.col("value").alias("d"))
    apart = added((1.0, after), (-1.0, own)).join(moved, "node", "left")
    apart = apart.groupBy("node").agg(F.count("*").alias("n"), F.max(F.abs(F.col("value") + F.coalesce("d", F.lit(0.0)))).alias("top"))
    rest = F.when(F.coalesce("n", F.lit(0)) < keys.count(), F.abs("d"))
    return moved.join(apart, "node", "full_outer").agg(F.max(F.greatest("top", rest))).first()[0]


def walk_by_pushes(edges: DataFrame, starts: DataFrame, restart: float, bound: float, iterations: int = 1000, merge_every: int = 4, most_rows: int = MOST_PAIRS) -> DataFrame:
    """(node, key, value): the sum of restart ((1 - restart) P')^k start, for starts (node, key, value).

    Only what a node has received by more than `bound` since it last sent is sent on,
    so rows are those that walks reach, and their number follows 1 / bound, not nodes
    times keys. All values of a key together miss at most (1 - restart) / restart times
    what was never sent on.
    """
    steps = stochastic(edges.select(F.lit(0).alias("gid"), "src", "dst", "w"))
    steps = linked(steps.select(F.col("src").alias("v"), "dst", (F.col("w") * (1 - restart)).alias("w")), ["v"])
    first = starts.groupBy(F.col("key").alias("u"), F.col("node").alias("v")).agg((F.sum("value") * restart).alias("score"))

    def send(rows: DataFrame) -> DataFrame:
        return steps.join(rows).groupBy("u", F.col("dst").alias("v")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))

    found = by_change(first, send, [], bound, 0.0, iterations, merge_every, most_rows)
    return found.select(F.col("v").alias("node"), F.col("u").alias("key"), F.col("score").alias("value"))


def pushed_walk(edges: DataFrame, anchors: DataFrame, restart: float = 0.15, bound: float = 1e-6, iterations: int = 1000, merge_every: int = 4, **limits: int) -> DataFrame:
    """(node, key, value): what `restart_walk` settles to, by local pushes from the anchors; nodes without a row have next to nothing.

    A key's pushes do not depend on other keys, so where tasks can map files all steps of
    a key are made in one task along mapped edges, and none is shuffled.
    """
    if mounted(edges) and not limits:
        steps = stochastic(edges.select(F.lit(0).alias("gid"), "src", "dst", "w")).select(F.col("src").alias("v"), "dst", (F.col("w") * (1 - restart)).alias("w"))
        first = anchors.groupBy(F.col("key").alias("u"), F.col("node").alias("v")).agg((F.count("*") * restart).alias("score"))
        found = pushed_here(checkpointed(steps), first, bound, iterations, merge_every)
        return found.select(F.col("v").alias("node"), F.col("u").alias("key"), F.col("score").alias("value"))
    limits |= {"iterations": iterations, "merge_every": merge_every}
    return walk_by_pushes(edges, anchors.select("node", "key", F.lit(1.0).alias("value")), restart, bound, **limits)


def pushed_walk_connected(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, restart: float = 0.15, bound: float = 1e-6, **limits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(walk, spread, even) of the walk in which nodes without edges send to all nodes alike.

    The walk to all nodes starts the same for every anchor, so it is one vector
    even(node, share) and a number an anchor, spread(key, times): the value of a node
    for a key is its row in `walk` and times * share. What nodes without edges have in
    all, z, follows from what they get by edges, a and b: z = a + times b, times = (1 -
    restart) z / restart.
    """
    size = nodes.count()
    walk = checkpointed(pushed_walk(edges, anchors, restart, bound, **limits))
    begun = nodes.select("node", F.lit(0).cast("long").alias("key"), F.lit(1.0 / size).alias("value"))
    even = checkpointed(walk_by_pushes(edges, begun, restart, bound / size, **limits).select("node", F.col("value").alias("share")))
    lone = nodes.select("node").join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    b = even.join(lone, "node", "left_semi").agg(F.sum("share")).first()[0] or 0.0
    ratio = (1 - restart) / restart
    held = walk.join(lone, "node", "left_semi").groupBy("key").agg(F.sum("value").alias("a"))
    return walk, held.select("key", (F.col("a") * ratio / (1 - ratio * b)).alias("times")), even


def positional(walk: DataFrame, anchors: DataFrame) -> DataFrame:
    """The walk's values, with each anchor's own row replaced by its one-hot row."""
    rest = walk.join(anchors.select("node").distinct(), "node", "left_anti")
    return rest.unionByName(anchors.select("node", "key", F.lit(1.0).alias("value")))


def convolved(normal: DataFrame, values: DataFrame, layers: int) -> list[DataFrame]:
    """values and their images under each power of a normalised adjacency."""
    out, steps = [values], node_links(normal) if layers > 1 else normal
    for _ in range(layers):
        out.append(push(steps, out[-1]))
    return out


def hops_joined(normal: DataFrame, values: DataFrame, hops: int) -> DataFrame:
    """(node, hop, key, value): all hops side by side."""
    tables = [t.select("node", F.lit(k).alias("hop"), "key", "value") for k, t in enumerate(convolved(normal, values, hops))]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def personalised(normal: DataFrame, values: DataFrame, alpha: float, steps: int) -> DataFrame:
    """x <- (1 - alpha) A x + alpha x0."""
    now, links = values, node_links(normal)
    for _ in range(steps):
        now = added((1 - alpha, push(links, now)), (alpha, values))
    return now


def relational_sum(edges: DataFrame, values: DataFrame, alpha: float) -> DataFrame:
    """sqrt(alpha) times the sum over neighbours plus sqrt(1 - alpha) times the node's own."""
    plain = edges.select("src", "dst", F.lit(1.0).alias("w"))
    return added((alpha**0.5, push(plain, values)), ((1 - alpha) ** 0.5, values))


def expanded_labels(edges: DataFrame, labels: DataFrame, layers: int) -> DataFrame:
    """(node, key, value): per layer, 1 where a neighbour's value is positive, less the value before; zeros are left out."""
    both = edges.select("src", "dst")
    now = labels.select("node", "key", F.lit(1.0).alias("value"))
    for _ in range(layers):
        sums = push(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("w")), now)
        reached = sums.where("value > 0").select("node", "key", F.lit(1.0).alias("value"))
        now = added((1.0, reached), (-1.0, now)).where("value <> 0")
    return now


def unit_rows(values: DataFrame) -> DataFrame:
    norms = values.groupBy("node").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return values.join(norms, "node").select("node", "key", (F.col("value") / F.col("norm")).alias("value"))


def products(one: DataFrame, two: DataFrame) -> DataFrame:
    """(u, v, score): inner products of rows that share a key."""
    right = two.select(F.col("node").alias("v"), "key", F.col("value").alias("other"))
    met = one.select(F.col("node").alias("u"), "key", "value").join(right, "key")
    return met.groupBy("u", "v").agg(F.sum(F.col("value") * F.col("other")).alias("score"))


def grown_anchors(edges1: DataFrame, edges2: DataFrame, anchors: DataFrame, rounds: int, layers: int = 2) -> DataFrame:
    """(u, v) anchors with the mutual best pairs of each round's neighbourhood added.

    Scores are summed where they are made, by u for the best of each u and by v for the other, so
    no pair is shuffled; both sum a pair's keys in order, so they are the same to the bit.
    """
    now = anchors.select("u", "v")
    for _ in range(rounds):
        sides = []
        for edges, end in ((edges1, "u"), (edges2, "v")):
            near, reached = single_hop(edges.select("src", "dst"), now.select(F.col(end).alias("node")))
            labels = now.select(F.col(end).alias("node"), F.col("u").alias("key"))
            values = unit_rows(expanded_labels(near, labels, layers))
            free = reached.join(now.select(F.col(end).alias("node")), "node", "left_anti")
            sides.append(values.join(free, "node", "left_semi"))
        one = checkpointed(sides[0].select(F.col("node").alias("u"), F.col("key").alias("mid"), F.col("value").alias("w")))
        two = checkpointed(sides[1].select(F.col("key").alias("mid"), F.col("node").alias("v"), F.col("value").alias("w")))
        by_u, by_v = (path_sums(one, two, end).withColumn("score", F.round("score", 9)).where("score > 0") for end in ("u", "v"))
        now = checkpointed(now.union(mutual_best(by_u, by_v)).distinct())
    return now
