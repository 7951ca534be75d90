"""Ranks, hits and top-k of pair scores (u, v, score); pairs that are not there have score 0.

Ties are broken by the smaller id. A rank is one more than the number of better
nodes, so nothing is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmap.operators.graph import running
from kinmap.session import broadcast_up_to, checkpointed, stored

KS = (1, 10, 30, 50)


def scored_tests(pairs: DataFrame, tests: DataFrame) -> DataFrame:
    """(u, v, s): the distinct tests with their scores. Few tests are sent to the pairs, many are shuffled with them."""
    tests = checkpointed(tests.select("u", "v").distinct())
    hit = pairs.join(broadcast_up_to(tests), ["u", "v"]).select("u", "v", "score")
    return checkpointed(tests.join(hit, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("s")))


def ranks(pairs: DataFrame, scored: DataFrame, size: int, query: str = "u", answer: str = "v") -> DataFrame:
    """(query, answer, rank) of scored tests (u, v, s) among all `size` nodes of the answer's graph."""
    a = F.col(answer)
    others = pairs.where("score <> 0").select(query, a.alias("o"), F.col("score").alias("t"))
    counts = others.join(broadcast_up_to(scored), query).groupBy(query, answer).agg(
        F.count_if(F.col("t") > F.col("s")).alias("better"),
        F.count_if((F.col("t") == F.col("s")) & (F.col("o") < a)).alias("tied"),
        F.count_if(F.col("o") < a).alias("below"),
        F.count("*").alias("there"),
    )
    counts = scored.join(counts, [query, answer], "left").na.fill(0, ["better", "tied", "below", "there"])
    absent = F.when(F.col("s") < 0, size - F.col("there")).when(F.col("s") == 0, a - F.col("below")).otherwise(0)
    return counts.select(query, answer, (1 + F.col("better") + F.col("tied") + absent).alias("rank"))


def both_ranks(pairs: DataFrame, tests: DataFrame, n1: int, n2: int, turned: DataFrame | None = None) -> DataFrame:
    """(u, v, direction, rank); pairs are read three times, so they should be cheap to read. `turned` has the same pairs, dealt by v."""
    scored = scored_tests(pairs, tests)
    one = ranks(pairs, scored, n2).withColumn("direction", F.lit("ltr"))
    two = ranks(pairs if turned is None else turned, scored, n1, "v", "u").withColumn("direction", F.lit("rtl"))
    rows = one.unionByName(two)
    return tests.join(rows, ["u", "v"])  # repeated tests count each


def combine(mode: str, one: Column, two: Column) -> Column:
    if mode not in ("ltr", "rtl", "mean", "max"):
        raise ValueError(f"unknown mode {mode}")
    return {"ltr": one, "rtl": two, "mean": (one + two) / 2, "max": F.greatest(one, two)}[mode]


def by_direction(value: Column) -> list[Column]:
    return [F.avg(F.when(F.col("direction") == d, value)) for d in ("ltr", "rtl")]


def metric_rows(ranked: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, value) of several aggregates in one pass."""
    row = ranked.agg(F.array(*[F.struct(F.lit(name).alias("name"), v.alias("value")) for name, v in values.items()]).alias("m"))
    return row.select(F.explode("m").alias("m")).select("m.*")


def metric(name: str, mode: str) -> Column:
    gain = 1.0 / F.col("rank") if name == "MRR" else (F.col("rank") <= int(name[5:])).cast("double")
    return combine(mode, *by_direction(gain))


def hits(ranked: DataFrame, mode: str = "mean", ks: tuple[int, ...] = KS) -> DataFrame:
    """(name, value) of Hits@k."""
    return metric_rows(ranked, {f"Hits@{k}": metric(f"Hits@{k}", mode) for k in ks})


def mrr(ranked: DataFrame, mode: str = "mean") -> DataFrame:
    return metric_rows(ranked, {"MRR": metric("MRR", mode)})


def evaluate(pairs: DataFrame, tests: DataFrame, n1: int, n2: int, metrics: tuple[str, ...] = (*[f"Hits@{k}" for k in KS], "MRR"), mode: str = "mean") -> DataFrame:
    """(name, value) of the named metrics; pairs are computed once and ranked once."""
    unknown = [m for m in metrics if m != "MRR" and not (m.startswith("Hits@") and m[5:].isdigit())]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    return evaluate_ranks(both_ranks(stored(pairs, "pairs"), tests, n1, n2), metrics, mode)


def evaluate_ranks(ranked: DataFrame, metrics: tuple[str, ...] = (*[f"Hits@{k}" for k in KS], "MRR"), mode: str = "mean") -> DataFrame:
    """(name, value) of the named metrics from (u, v, direction, rank)."""
    return metric_rows(ranked, {m: metric(m, mode) for m in metrics})


def best_per_target(pairs: DataFrame, prior: DataFrame | None = None, weight: float = 0.0) -> DataFrame:
    """(v, u, score): the best source of each target, scores ((1 + s) / 2) (1 - weight) + prior weight."""
    score = (1 + F.col("score")) / 2 * (1 - weight)
    if prior is not None:
        # Pairs stay where they are unless priors are very many.
        prior = checkpointed(prior.select("u", "v", F.col("score").alias("prior")))
        pairs = pairs.join(broadcast_up_to(prior, 4_000_000, 192 << 20), ["u", "v"], "left")
        score = score + F.coalesce("prior", F.lit(0.0)) * weight
    rows = pairs.select("u", "v", score.alias("score"))
    best = rows.groupBy("v").agg(F.max(F.struct("score", (-F.col("u")).alias("u"))).alias("b"))
    return best.select("v", (-F.col("b.u")).alias("u"), F.col("b.score").alias("score"))


def mutual_best(pairs: DataFrame, turned: DataFrame | None = None) -> DataFrame:
    """(u, v) that are each other's best; `turned` has the same pairs, dealt by v."""
    one = pairs.groupBy("u").agg(F.max(F.struct("score", (-F.col("v")).alias("k"))).alias("b")).select("u", (-F.col("b.k")).alias("v"))
    two = (pairs if turned is None else turned).groupBy("v").agg(F.max(F.struct("score", (-F.col("u")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("u"), "v")
    return one.intersect(two)


def nearest(pairs: DataFrame, k: int, query: str, answer: str) -> DataFrame:
    """(query, answer, score, rank): the k best answers of each query."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), answer)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_share(pairs: DataFrame, k: int) -> DataFrame:
    """The k best entries, scores over the total of all."""
    total = pairs.agg(F.sum("score").alias("total"))
    shared = pairs.crossJoin(F.broadcast(total)).select("u", "v", (F.col("score") / F.col("total")).alias("score"))
    return shared.orderBy(F.desc("score"), "u", "v").limit(k)


def degree_anchors(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """The k pairs (u, v, score) of the most similar degrees, from (node, degree); ties by u, then v.

    Pairs are counted by histograms of degrees; only degree pairs that can be among
    the k best are expanded, and of those at the border only as many u as can matter.
    """
    one, two = checkpointed(one.select("node", "degree")), checkpointed(two.select("node", "degree"))
    h1 = one.groupBy(F.col("degree").alias("d1")).agg(F.count("*").alias("m1"))
    h2 = two.groupBy(F.col("degree").alias("d2")).agg(F.count("*").alias("m2"))
    gap = F.abs(F.col("d1") - F.col("d2"))
    # Histograms are as long as there are different degrees.
    cells = h1.crossJoin(broadcast_up_to(h2)).select("d1", "d2", gap.alias("gap"), (F.col("m1") * F.col("m2")).alias("cell"))
    levels = cells.groupBy("gap").agg(F.sum("cell").alias("in_level"))
    before = Window.orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("before", F.coalesce(F.sum("in_level").over(before), F.lit(0))).where(F.col("before") < k)
    needed = checkpointed(cells.join(levels, "gap").select("d1", "d2", "gap", "before", (F.lit(k) - F.col("before")).alias("room")))
    # Within a level pairs go by u, then v: how many partners each u has there tells which u are reached.
    partners = needed.join(h2, "d2").groupBy("gap", "d1", "before", "room").agg(F.sum("m2").alias("partners"))
    us = partners.join(one.withColumnRenamed("degree", "d1"), "d1").select("gap", "room", "partners", "d1", F.col("node").alias("u"))
    us = running(us, ["gap"], ["u"], "partners", "ahead").where("ahead < room")
    met = us.join(needed.select("gap", "d1", "d2"), ["gap", "d1"]).join(two.select(F.col("degree").alias("d2"), F.col("node").alias("v")), "d2")
    inside = Window.partitionBy("gap", "u").orderBy("v")
    met = met.withColumn("place", F.col("ahead") + F.row_number().over(inside)).where("place <= room")
    return met.select("u", "v", (1.0 / (1 + F.col("gap"))).alias("score"))


def predicted_groups(pairs: DataFrame, entities: DataFrame, ids: DataFrame, n1: int, n2: int, aggregation: str = "mean", top_k: int | None = None) -> DataFrame:
    """(eid, side, node): entities' sources as they are, and the targets of the best aggregated scores.

    As many targets as the true list is long unless top_k is given. Absent pairs
    count as 0, so targets without scores follow by id.
    """
    if aggregation not in ("mean", "sum", "max"):
        raise ValueError(f"unknown aggregation {aggregation}")
    if top_k is not None and top_k < 0:
        raise ValueError("top_k must not be negative")
    src = entities.where("side = 'src'")
    valid = src.where((F.col("node") >= 0) & (F.col("node") < n1))
    sizes = ids.join(entities.where("side = 'tgt'").groupBy("eid").agg(F.count("*").alias("k")), "eid", "left")
    k = F.least(F.coalesce("k", F.lit(0)) if top_k is None else F.lit(top_k), F.lit(n2)).alias("k")
    sizes = sizes.select("eid", k).join(valid.groupBy("eid").agg(F.count("*").alias("m")), "eid").where("k > 0")
    met = pairs.join(broadcast_up_to(valid.select("eid", F.col("node").alias("u")), 4_000_000, 192 << 20), "u").groupBy("eid", "v")
    # A maximum over some sources alone is at least 0 when another source has no such pair.
    met = met.agg(F.sum("score").alias("total"), F.max("score").alias("top"), F.count("*").alias("n")).join(sizes, "eid")
    score = {
        "mean": F.col("total") / F.col("m"),
        "sum": F.col("total"),
        "max": F.when(F.col("n") < F.col("m"), F.greatest(F.col("top"), F.lit(0.0))).otherwise(F.col("top")),
    }[aggregation]
    scored = met.select("eid", "v", "k", score.alias("score"))
    # Of targets without scores at most k plus the scored ones below can be needed: the first k ids that are not scored.
    counts = scored.groupBy("eid").agg(F.count("*").alias("there"))
    fill = sizes.join(counts, "eid", "left").select("eid", "k", F.explode(F.sequence(F.lit(0), F.least(F.lit(n2), F.col("k") + F.coalesce("there", F.lit(0))) - 1)).alias("v"))
    fill = fill.join(scored.select("eid", "v"), ["eid", "v"], "left_anti").select("eid", "v", "k", F.lit(0.0).alias("score"))
    order = Window.partitionBy("eid").orderBy(F.desc("score"), "v")
    best = scored.unionByName(fill).withColumn("r", F.row_number().over(order)).where("r <= k")
    return src.select("eid", "side", "node").union(best.select("eid", F.lit("tgt"), "v"))


def reassembled(blocks: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs, default): one table of the blocks' pairs, the greatest score of each, and the score of all others."""
    pairs = reduce(DataFrame.unionByName, blocks).groupBy("u", "v").agg(F.max("score").alias("score"))
    return pairs, pairs.agg(F.coalesce(F.min("score") - 1, F.lit(0.0)).alias("missing"))


def multiway_ranks(tuples: DataFrame, members: DataFrame, tests: DataFrame, graphs: int, agreeing: DataFrame | None = None) -> DataFrame:
    """(src_gid, test, inside, high, pair): ranks (from 1) of the first tuple that agrees with a test everywhere or anywhere.

    tuples(cluster, nodes, score), members(cluster, gid, node), tests(test, nodes). Tuples are not
    sorted and not shuffled: those that agree give a test its two places, and a pass over all
    counts what is ahead of them. `agreeing` has all tuples that agree with a test and maybe
    others, in any number; without it they are looked for among all.
    """
    placed = []
    for g in range(graphs):
        own = tests.join(members.where(F.col("gid") == g).select("cluster", F.col("node").alias("own")), F.col("nodes")[g] == F.col("own"))
        partner = tests.select("test", F.posexplode("nodes").alias("gid", "node")).where(F.col("gid") != g)
        inside = own.select("test", "cluster").join(partner, "test").join(members, ["cluster", "gid", "node"], "left_semi").select("test", "cluster").distinct()
        own = own.join(inside.withColumn("inside", F.lit(True)), ["test", "cluster"], "left")
        placed.append(own.select(F.lit(g).alias("src_gid"), "test", "cluster", F.col("nodes").alias("want"), "own", F.coalesce("inside", F.lit(False)).alias("inside")))
    placed = checkpointed(reduce(DataFrame.unionByName, placed))
    keys, one = ["src_gid", "cluster", "own"], ["src_gid", "test", "cluster"]
    by_source = lambda t: t.select("cluster", "nodes", "score", F.posexplode("nodes").alias("src_gid", "own"))
    asked = placed.where("inside").select(*keys, "test", "want")
    same = [(F.col("src_gid") == k, F.col("nodes")[k] == F.col("want")[k]) for k in range(graphs)]
    met = by_source(tuples if agreeing is None else agreeing).join(broadcast_up_to(asked), keys)
    met = met.where(reduce(Column.__or__, [~source & equal for source, equal in same]))
    # Highest scores first, as in a sort: not a number, numbers, nulls.
    kind = F.when(F.col("score").isNull(), 2).when(F.isnan("score"), 0).otherwise(1)
    place = F.struct(kind, -F.col("score"), "nodes", "score")
    best = met.groupBy(*one).agg(F.min(F.when(reduce(Column.__and__, [source | equal for source, equal in same]), place)).alias("high"), F.min(place).alias("pair"))
    best = checkpointed(best.select(*one, F.col("high.score").alias("hs"), F.col("high.nodes").alias("hn"), F.col("pair.score").alias("ps"), F.col("pair.nodes").alias("pn")))
    limits = broadcast_up_to(asked.select(*keys, "test").join(best, one))

    def ahead(score: str, nodes: str) -> Column:
        above = F.coalesce(F.col("score") > F.col(score), F.col("score").isNotNull())
        return F.col(nodes).isNotNull() & (above | (F.col("score").eqNullSafe(F.col(score)) & (F.col("nodes") < F.col(nodes))))

    counts = by_source(tuples).join(limits, keys).where(ahead("hs", "hn") | ahead("ps", "pn"))
    counts = counts.groupBy(*one).agg(F.count_if(ahead("hs", "hn")).alias("h"), F.count_if(ahead("ps", "pn")).alias("p"))
    rows = placed.select(*one, "inside").join(best, one, "left").join(counts, one, "left")
    rank = lambda nodes, n: F.when(F.col(nodes).isNotNull(), 1 + F.coalesce(n, F.lit(0)))
    return rows.select("src_gid", "test", "inside", rank("hn", "h").alias("high"), rank("pn", "p").alias("pair"))


def multiway_hits(ranked: DataFrame, tests: int, ks: tuple[int, ...] = KS, mode: str = "mean") -> DataFrame:
    """(k, high, pair): hits over all tests, by the mean or maximum over source graphs."""
    if mode not in ("mean", "max"):
        raise ValueError(f"unknown mode {mode}")
    rows = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).groupBy("src_gid", "k")
    share = lambda c: (F.count_if(F.col(c) <= F.col("k")) / tests).alias(c)
    pick = F.avg if mode == "mean" else F.max
    return rows.agg(share("high"), share("pair")).groupBy("k").agg(pick("high").alias("high"), pick("pair").alias("pair"))


def multiway_mrr(ranked: DataFrame, tests: int, largest: int, mode: str = "mean") -> DataFrame:
    """(value): reciprocal ranks of full agreement; a test whose partners are all elsewhere adds 1 / largest."""
    gain = F.when(~F.col("inside"), 1.0 / largest).otherwise(F.coalesce(1.0 / F.col("high"), F.lit(0.0)))
    pick = F.avg if mode == "mean" else F.max
    return ranked.groupBy("src_gid").agg((F.sum(gain) / tests).alias("m")).agg(pick("m").alias("value"))
