"""Training samples: negatives, weighted draws, walks and context pairs, drawn from hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmap.functions.draws import SEED, draw, draw_below
from kinmap.operators.graph import degree_shares, dense_ids, running
from kinmap.operators.local import walked
from kinmap.operators.mapped import mounted
from kinmap.session import broadcast_up_to, checkpointed


def balance(one: DataFrame, two: DataFrame, keys: list[str], seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Both tables at the size of the larger, drawn rows of the shorter repeated."""
    n1, n2 = one.count(), two.count()

    def grown(rows: DataFrame, n: int, by: int) -> DataFrame:
        if not by or not n:
            return rows
        ranked = dense_ids(rows, keys, "_id")
        more = rows.sparkSession.range(by).select(draw_below(F.lit(n), "balance", F.col("id"), seed=seed).alias("_id"))
        return rows.unionByName(more.join(ranked, "_id").drop("_id"))

    return grown(one, n1, max(0, n2 - n1)), grown(two, n2, max(0, n1 - n2))


def uniform_negatives(anchors: DataFrame, n1: int, n2: int, k: int, seed: str = SEED) -> DataFrame:
    """(u, v, direction, i, negative): k uniform nodes of the other graph for each side, never the match."""
    each = anchors.select("u", "v", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    rows = []
    for direction, size, match in (("ltr", n2, "v"), ("rtl", n1, "u")):
        pick = draw_below(F.lit(size - 1), f"neg_{direction}", F.col("u"), F.col("v"), F.col("i"), seed=seed)
        negative = F.when(pick >= F.col(match), pick + 1).otherwise(pick)
        rows.append(each.select("u", "v", F.lit(direction).alias("direction"), "i", negative.alias("negative")))
    return rows[0].union(rows[1])


def distinct_negatives(anchors: DataFrame, n: int, k: int, seed: str = SEED) -> DataFrame:
    """(u, v, negative): k different nodes below n for each pair, never v.

    Floyd's draw: step j takes a drawn number up to j, or j itself if that is taken.
    """
    start = n - 1 - k

    def step(taken, j):
        pick = draw_below(F.lit(start + 1) + j, "dneg", F.col("u"), F.col("v"), j, seed=seed)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), F.lit(start).cast("long") + j).otherwise(pick)))

    chosen = F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")), F.array().cast("array<bigint>"), step)
    rows = anchors.select("u", "v", F.explode(chosen).alias("p"))
    return rows.select("u", "v", F.when(F.col("p") >= F.col("v"), F.col("p") + 1).otherwise(F.col("p")).alias("negative"))


def non_neighbours(edges: DataFrame, anchors: DataFrame, n: int, k: int, rounds: int = 20, seed: str = SEED) -> DataFrame:
    """(node, i, negative): k drawn nodes for each anchor that are neither it nor its successors."""
    left = anchors.select("node", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    taken = edges.select(F.col("src").alias("node"), F.col("dst").alias("negative")).distinct()
    found = []
    for r in range(rounds):
        drawn = left.withColumn("negative", draw_below(F.lit(n), f"ctx{r}", F.col("node"), F.col("i"), seed=seed))
        good = checkpointed(drawn.where("node <> negative").join(taken, ["node", "negative"], "left_anti").select("node", "i", "negative"))
        found.append(good)
        left = checkpointed(left.join(good, ["node", "i"], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
    raise RuntimeError("too few nodes that are no neighbours")


#: Cells of a share that are listed at once.
LISTED = 4096


def cumulative(shares: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """shares(by, node, p) with [low, high) of the running sum and its cell, for draws by an equi-join on cells; and (by, cells).

    A group has about as many cells as shares, so a draw meets two shares on the average,
    however many nodes there are. Cells of a share that is wide are listed some thousand at a time.
    """
    there = shares.where("p > 0")
    sizes = checkpointed(there.groupBy(*by).agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.count("*") + 1.0))).cast("long").alias("cells")))
    rows = running(there, by, ["node"], "p", "low").withColumn("high", F.col("low") + F.col("p")).join(broadcast_up_to(sizes), by)
    last = F.floor(F.least(F.col("high"), F.lit(1.0 - 1e-12)) * F.col("cells"))
    rows = rows.withColumns({"first": F.floor(F.col("low") * F.col("cells")), "last": last}).where("first <= last")
    rows = rows.withColumn("start", F.explode(F.sequence("first", "last", F.lit(LISTED).cast("long"))))
    return rows.withColumn("cell", F.explode(F.sequence("start", F.least(F.col("start") + LISTED - 1, "last")))).drop("first", "last", "start", "cells"), sizes


def weighted_pick(draws: DataFrame, shares: DataFrame, by: list[str]) -> DataFrame:
    """draws(by, u, ...) with the node whose share holds u."""
    table, sizes = cumulative(shares, by)
    table = table.select(*by, "cell", "low", "high", F.col("node").alias("picked"))
    met = draws.join(broadcast_up_to(sizes), by).withColumn("cell", F.floor(F.col("u") * F.col("cells"))).drop("cells").join(table, [*by, "cell"])
    return met.where((F.col("low") <= F.col("u")) & (F.col("u") < F.col("high"))).drop("cell", "low", "high")


def labelled_edges(nodes: DataFrame, edges: DataFrame, k: int, seed: str = SEED) -> DataFrame:
    """(gid, src, dst, label): every edge with 1 and k negatives with -1, drawn by degree^0.75 of its graph."""
    edges = checkpointed(edges)
    shares = degree_shares(nodes, edges)
    each = edges.select("gid", "src", "dst", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    drawn = each.withColumn("u", draw("cross", F.col("gid"), F.col("src"), F.col("dst"), F.col("i"), seed=seed))
    negative = weighted_pick(drawn, shares, ["gid"]).select("gid", "src", F.col("picked").alias("dst"), F.lit(-1).alias("label"))
    return edges.select("gid", "src", "dst", F.lit(1).alias("label")).union(negative)


def anchor_contexts(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, cap: int = 100, seed: str = SEED) -> DataFrame:
    """(node, context): neighbours of the anchors; those with more than cap get cap draws by degree."""
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("context")).join(anchors.select("node"), "node", "left_semi")
    sizes = near.groupBy("node").agg(F.count("*").alias("n"))
    few = near.join(sizes.where(F.col("n") <= cap), "node", "left_semi")
    degree = edges.groupBy(F.col("src").alias("context")).agg(F.count("*").alias("d"))
    hubs = near.join(sizes.where(F.col("n") > cap), "node", "left_semi").join(degree, "context")
    totals = hubs.groupBy("node").agg(F.sum("d").alias("total"))
    shares = hubs.join(totals, "node").select(F.col("node").alias("hub"), F.col("context").alias("node"), (F.col("d") / F.col("total")).alias("p"))
    draws = sizes.where(F.col("n") > cap).select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(1), F.lit(cap))).alias("i"))
    draws = draws.withColumn("u", draw("hub", F.col("hub"), F.col("i"), seed=seed))
    return few.select("node", "context").union(weighted_pick(draws, shares, ["hub"]).select("hub", "picked"))


def similarity_negatives(scores: DataFrame, k: int, seed: str = SEED) -> DataFrame:
    """(u, v): k different v for each u, drawn in proportion to sigmoid(score), never u itself.

    The k smallest of exponential draws -ln(r) / p are such a sample.
    """
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), 1 / (1 + F.exp(-F.col("score")))))
    r = F.greatest(draw("sim", F.col("u"), F.col("v"), seed=seed), F.lit(2.0**-53))
    order = Window.partitionBy("u").orderBy("key", "v")
    rows = scores.where("u <> v").withColumn("key", -F.log(r) / p).withColumn("r", F.row_number().over(order))
    return rows.where(F.col("r") <= k).select("u", "v")


def placed_neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((src, nth, dst), (src, n)): each node's distinct successors numbered from 0 in order, and how many it has.

    A hub's successors are rows like any others, spread over partitions; no list of
    them is ever made.
    """
    numbered = dense_ids(edges.select("src", "dst").distinct(), ["dst"], "nth", within="src")
    numbered = checkpointed(numbered.select("src", "nth", "dst"))
    return numbered, checkpointed(numbered.groupBy("src").agg(F.count("*").alias("n")))


def walks(edges: DataFrame, starts: DataFrame, p: float, q: float, num_walks: int, length: int, seed: str = SEED) -> DataFrame:
    """(walk_id, start, path): biased second-order walks; a walk stops at a dead end.

    Weights are 1/p for going back, 1 for neighbours of the last node too, 1/q for
    others. A step draws the place of the next node among the successors and looks it
    up. Only successors that are no others have weights of their own: what lies between
    them is counted, not listed. Where tasks can map files, a walk is made in one task along
    mapped edges, and its steps are not shuffled.
    """
    if mounted(edges):
        first = starts.select(F.col("node").alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk_id"))
        draws = F.array(*[draw("walk", F.col("start"), F.col("walk_id"), F.lit(step), seed=seed) for step in range(1, length)]).cast("array<double>")
        return walked(checkpointed(edges.select("src", "dst").distinct()), first.withColumn("draws", draws), p, q)
    numbered, sizes = placed_neighbours(edges)
    first = starts.select(F.col("node").alias("start")).distinct().select("start", F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk_id"))
    now = first.select("walk_id", "start", F.array("start").alias("path"))
    done = None
    for step in range(1, length):
        here, last = F.element_at("path", -1), F.get(F.reverse("path"), F.lit(1))
        met = now.withColumn("src", here).join(sizes, "src", "left")
        ended = met.where("n IS NULL").select("walk_id", "start", "path")
        done = ended if done is None else done.union(ended)
        u = draw("walk", F.col("start"), F.col("walk_id"), F.lit(step), seed=seed)
        met = met.where("n IS NOT NULL").withColumn("u", u)
        if p == 1 and q == 1 or step == 1:
            chosen = met.withColumn("nth", F.floor(F.col("u") * F.col("n")).cast("long"))
        else:
            chosen = biased_places(checkpointed(met.withColumn("last", last)), numbered, 1.0 / p, 1.0 / q)
        now = checkpointed(chosen.join(numbered, ["src", "nth"]).select("walk_id", "start", F.concat("path", F.array("dst")).alias("path")))
    return now if done is None else now.union(done)


def biased_places(walkers: DataFrame, numbered: DataFrame, back: float, other: float) -> DataFrame:
    """walkers(walk_id, start, path, src, n, u, last) with `nth`, the place at which the summed weights pass u times their total.

    Between two special successors (the last node, and those that it has too) all weights are
    alike, so the place follows from the sum up to the special one before it.
    """
    key = ["start", "walk_id"]
    returns = walkers.join(numbered, "src").where(F.col("dst") == F.col("last")).select(*key, "nth", F.lit(back).alias("weight"))
    theirs = numbered.select(F.col("src").alias("last"), "dst")
    common = walkers.select(*key, "src", "last").join(theirs, "last").where("dst <> last").join(numbered, ["src", "dst"]).select(*key, "nth", F.lit(1.0).alias("weight"))
    specials = returns.unionByName(common)
    # A special successor adds the sum of the others before it to what the special ones have.
    until = Window.partitionBy(*key).orderBy("nth")
    specials = specials.withColumn("count", F.row_number().over(until)).withColumn("summed", F.sum("weight").over(until))
    ends = specials.select(*key, "nth", "weight", (F.col("summed") + (F.col("nth") + 1 - F.col("count")) * other).alias("high"))
    ends = checkpointed(ends.withColumn("low", F.col("high") - F.col("weight")))
    totals = ends.groupBy(*key).agg(F.sum("weight").alias("own"), F.count("*").alias("specials"))
    aimed = walkers.join(totals, key, "left").na.fill(0, ["own", "specials"])
    aimed = aimed.withColumn("mark", F.col("u") * (F.col("own") + (F.col("n") - F.col("specials")) * other))
    # The last special successor whose weight begins at or below the mark.
    passed = ends.join(aimed.select(*key, "mark"), key).where(F.col("low") <= F.col("mark"))
    passed = passed.groupBy(*key).agg(F.max(F.struct("nth", "high")).alias("at"))
    after = F.col("at.nth") + 1 + F.floor((F.col("mark") - F.col("at.high")) / other)
    place = F.when(F.col("at").isNull(), F.floor(F.col("mark") / other)).when(F.col("mark") < F.col("at.high"), F.col("at.nth")).otherwise(after)
    return aimed.join(passed, key, "left").withColumn("nth", F.least(place, F.col("n") - 1).cast("long")).drop("at", "mark", "own", "specials")


def window_pairs(paths: DataFrame, centres: DataFrame, window: int = 2) -> DataFrame:
    """Distinct (centre, context) within the window of each place of a path, the centre itself included."""
    placed = paths.select("path", F.posexplode("path").alias("pos", "centre"))
    start = F.greatest(F.lit(0), F.col("pos") - window)
    around = F.slice("path", start + 1, F.col("pos") - start + window + 1)
    pairs = placed.join(centres.select(F.col("node").alias("centre")).distinct(), "centre", "left_semi")
    return pairs.select("centre", F.explode(around).alias("context")).distinct()


def anchored_edges(edges: DataFrame, anchors: DataFrame, samples: int, seed: str = SEED) -> DataFrame:
    """(src, dst, kind): drawn edges, anchored ends replaced by a random successor (src) or predecessor (dst); and those that touch anchors as they were."""
    n = edges.count()
    ids = dense_ids(edges.select("src", "dst"), ["src", "dst"], "eid")
    drawn = edges.sparkSession.range(samples).select("id", draw_below(F.lit(n), "edge", F.col("id"), seed=seed).alias("eid")).join(ids, "eid")
    rows, ways = checkpointed(drawn), {}
    for end, other, tag in (("src", "dst", "succ"), ("dst", "src", "pred")):
        own = edges.select(F.col(end).alias("at"), F.col(other).alias("to")).join(anchors.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        numbered = checkpointed(dense_ids(own, ["to"], "nth", within="at").select("at", "nth", "to"))
        sizes = numbered.groupBy("at").agg(F.count("*").alias("n"))
        met = rows.select("id", F.col(end).alias("at")).join(sizes, "at").withColumn("nth", draw_below(F.col("n"), tag, F.col("id"), seed=seed))
        ways[tag] = met.join(numbered, ["at", "nth"]).select("id", F.col("to").alias(tag))
    both = checkpointed(rows.join(ways["succ"], "id", "left").join(ways["pred"], "id", "left"))
    moved = both.select(F.coalesce("succ", "src").alias("src"), F.coalesce("pred", "dst").alias("dst"), F.lit("replaced").alias("kind"))
    touching = both.where("succ IS NOT NULL OR pred IS NOT NULL").select("src", "dst", F.lit("original").alias("kind"))
    return moved.union(touching)
