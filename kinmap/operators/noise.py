"""Splits, noise and many-to-many benchmarks, drawn from hashes: exact counts for any seed and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmap.functions.draws import SEED, draw, draw_below, draw_normal
from kinmap.operators.graph import column_moments, dense_ids, undirected
from kinmap.session import checkpointed
from kinmap.sources.fixtures import NetworkSet


def hash_ranked(rows: DataFrame, tag: str, keys: list[str], seed: str = SEED, name: str = "rank") -> DataFrame:
    """Rows with their place (from 0) in the order of a draw."""
    drawn = rows.withColumn("_draw", draw(tag, *[F.col(k) for k in keys], seed=seed))
    return dense_ids(drawn, ["_draw", *keys], name).drop("_draw")


def split_anchors(anchors: DataFrame, ratio: float, seed: str = SEED) -> DataFrame:
    """Anchors with exactly floor(rows * ratio) of them `train`, the others `test`."""
    ranked = hash_ranked(anchors.drop("split"), "train", ["aid"], seed)
    return ranked.withColumn("split", F.when(F.col("rank") < int(anchors.count() * ratio), "train").otherwise("test")).drop("rank")


def perturb_edges(edges: DataFrame, nodes: int, ratio: float, seed: str = SEED) -> DataFrame:
    """Undirected edges of one graph after int(edges * ratio) random pairs are toggled; twice toggled is not at all."""
    n = edges.count()
    there = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    spark = edges.sparkSession
    drawn = spark.range(int(n * ratio)).select(
        draw_below(F.lit(nodes), "edge_u", F.col("id"), seed=seed).alias("u"), draw_below(F.lit(nodes - 1), "edge_v", F.col("id"), seed=seed).alias("v")
    )
    drawn = drawn.withColumn("v", F.when(F.col("v") >= F.col("u"), F.col("v") + 1).otherwise(F.col("v")))
    toggled = drawn.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).count().where("count % 2 = 1").select("a", "b", F.lit(1).alias("t"))
    kept = there.withColumn("e", F.lit(1)).join(toggled, ["a", "b"], "full_outer").where("e IS NULL OR t IS NULL")
    return undirected(kept.select(F.lit(0).alias("gid"), F.col("a").alias("src"), F.col("b").alias("dst"))).select("src", "dst")


def edge_noise(network: NetworkSet, ratio: float, gids: list[int], seed: str = SEED) -> DataFrame:
    """(gid, src, dst): edges of all graphs, those of gids perturbed."""
    out = network.edges.where(~F.col("gid").isin(gids)).select("gid", "src", "dst")
    for g in gids:
        size = network.nodes.where(F.col("gid") == g).count()
        out = out.union(perturb_edges(network.graph(g), size, ratio, f"{seed}.{g}").select(F.lit(g).alias("gid"), "src", "dst"))
    return out


def dealt_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes dealt to as many tasks as shuffles have: a small file of nodes is one task, but draws for them are much work."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gid", "node")


def flip_attributes(nodes: DataFrame, ratio: float, seed: str = SEED) -> DataFrame:
    """Nodes with int(width * ratio) positions of each flipped; only for attributes that are 0 or 1.

    Values are sorted by their draws, flipped by place and sorted back, so that a draw is made once a value.
    """
    binary = F.forall("x", lambda v: v.isin(0.0, 1.0))
    checked = F.when(~binary, F.raise_error(F.lit("attributes are not binary"))).otherwise(F.col("x"))
    drawn = F.array_sort(F.transform(checked, lambda v, p: F.struct(draw("flip", F.col("gid"), F.col("node"), p, seed=seed).alias("d"), p.alias("p"), v.alias("v"))))
    count = F.floor(F.size("x") * ratio)
    flipped = F.array_sort(F.transform(drawn, lambda s, place: F.struct(s["p"].alias("p"), F.when(place < count, 1 - s["v"]).otherwise(s["v"]).alias("v"))))
    return dealt_nodes(nodes).withColumn("x", F.transform(flipped, lambda s: s["v"]))


def gaussian_attributes(nodes: DataFrame, std: float, seed: str = SEED) -> DataFrame:
    """Nodes with normal noise of `std` column deviations on each attribute."""
    moments = column_moments(nodes).groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "std"))).alias("m"))  # one number a column
    noise = lambda v, p: v + draw_normal("gauss", F.col("gid"), F.col("node"), p, seed=seed) * std * F.get(F.col("m"), p)["std"]
    return dealt_nodes(nodes).join(F.broadcast(moments), "gid").withColumn("x", F.transform("x", noise)).drop("m")


def attribute_noise(nodes: DataFrame, mode: str, ratio: float, gids: list[int], seed: str = SEED) -> DataFrame:
    if mode not in ("flip", "gaussian"):
        raise ValueError(f"unknown mode {mode}")
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must lie in 0 to 1")
    change = flip_attributes if mode == "flip" else gaussian_attributes
    chosen = F.col("gid").isin(gids)
    return change(nodes.where(chosen), ratio, seed).unionByName(nodes.where(~chosen))


def perturb_supervision(anchors: DataFrame, nodes: DataFrame, ratio: float, seed: str = SEED) -> DataFrame:
    """(u, v, moved): training pairs, int(rows * ratio) of them with another v that is no test v.

    anchors(u, v, split), nodes(node) of the second graph.
    """
    train = anchors.where("split = 'train'").select("u", "v")
    free = dense_ids(nodes.select("node").join(anchors.where("split = 'test'").select(F.col("v").alias("node")), "node", "left_anti"), ["node"], "fid")
    free = checkpointed(free)
    size = free.count()
    ranked = hash_ranked(train, "sup", ["u", "v"], seed)
    moved = ranked.where(F.col("rank") < int(train.count() * ratio)).withColumn("fid", draw_below(F.lit(size), "supv", F.col("u"), F.col("v"), seed=seed))
    hit = moved.join(free, "fid").withColumn("fid", F.when(F.col("node") == F.col("v"), (F.col("fid") + 1) % size).otherwise(F.col("fid"))).select("u", "fid")
    hit = hit.join(free, "fid").select("u", F.col("node").alias("v"), F.lit(True).alias("moved"))
    rest = ranked.where(F.col("rank") >= int(train.count() * ratio)).select("u", "v", F.lit(False).alias("moved"))
    return hit.unionByName(rest)


def one_to_one(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """Pairs (id, u, v) kept greedily by id so that no node is in two.

    In a round, pairs that come first on both of their sides are kept and those that
    share a node with them dropped, which is what the sequential pass decides too. A
    pair with a single earlier rival left is kept just if the rival is not: such pairs
    form chains, which are cut short by doubling to the first pair that waits for none
    or for several. Chains that end in a pair that is kept are settled in the round, so
    rounds do not grow with their lengths.
    """
    left, kept = checkpointed(pairs.where("u <> -1 AND v <> -1").select("id", "u", "v")), None
    for _ in range(rounds):
        firsts = settled_chains(left)
        kept = firsts if kept is None else kept.unionByName(firsts)
        left = left.join(firsts.select("id"), "id", "left_anti")
        left = left.join(firsts.select("u"), "u", "left_anti").join(firsts.select("v"), "v", "left_anti")
        left, kept = checkpointed(left), checkpointed(kept)
        if left.isEmpty():
            return kept
    raise RuntimeError("pairs are not settled")


def settled_chains(left: DataFrame) -> DataFrame:
    """The pairs that are kept by what chains of single rivals tell."""
    # The earlier rivals of a pair: those that share u or v and have a smaller id. One needs the two first ids of each side.
    sides = []
    for end in ("u", "v"):
        first = Window.partitionBy(end).orderBy("id")
        sides.append(left.select("id", F.row_number().over(first).alias("place"), F.lag("id").over(first).alias("before")))
    ranked = left.join(sides[0].withColumnsRenamed({"place": "pu", "before": "bu"}), "id").join(sides[1].withColumnsRenamed({"place": "pv", "before": "bv"}), "id")
    rivals = F.col("pu") - 1 + F.col("pv") - 1
    same = (F.col("pu") == 2) & (F.col("pv") == 2) & (F.col("bu") == F.col("bv"))  # one rival by both sides
    rival = F.when(rivals == 1, F.coalesce("bu", "bv")).when(same, F.col("bu"))
    state = ranked.select("id", "u", "v", (rivals == 0).alias("root"), rival.alias("up"))
    # (id, to, odd): the pair `to` that decides id, directly or through others, and whether it decides the opposite.
    chain = checkpointed(state.where("up IS NOT NULL").select("id", F.col("up").alias("to"), F.lit(True).alias("odd")))
    while True:
        onward = chain.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("odd").alias("odd2"))
        jumped = chain.join(onward, "to", "left")
        after = checkpointed(jumped.select("id", F.coalesce("further", "to").alias("to"), (F.col("odd") != F.coalesce("odd2", F.lit(False))).alias("odd"), F.col("further").isNotNull().alias("moved")))
        chain = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    roots = state.where("root").select(F.col("id").alias("to"))
    decided = chain.join(roots, "to", "left_semi").where("NOT odd").select("id")
    return state.where("root").select("id").unionByName(decided).join(left, "id").select("id", "u", "v")


def quotas(n: int, ratios: dict[str, float]) -> dict[str, int]:
    """Rounded shares of n (halves to even), the drift on the largest."""
    if abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    out = {k: int(round(r * n)) for k, r in ratios.items()}
    largest = max(out, key=out.__getitem__)
    out[largest] += n - sum(out.values())
    return out


def typed_entities(ids: DataFrame, ratios: dict[str, float], max_expansion: int, seed: str = SEED) -> DataFrame:
    """ids(eid) with kind in exact quotas and split factors k_src, k_tgt in 2 to max_expansion where the kind splits."""
    if max_expansion < 2:
        raise ValueError("max_expansion must be 2 at least")
    ranked = hash_ranked(ids, "kind", ["eid"], seed)
    bounds, total = [], 0
    for name, quota in quotas(ids.count(), ratios).items():
        total += quota
        bounds.append((name, total))
    kind = F.lit(bounds[-1][0])
    for name, until in reversed(bounds[:-1]):
        kind = F.when(F.col("rank") < until, name).otherwise(kind)
    rows = ranked.withColumn("kind", kind)
    factor = lambda side, kinds: F.when(F.col("kind").isin(kinds), 2 + draw_below(F.lit(max_expansion - 1), f"k_{side}", F.col("eid"), seed=seed)).otherwise(1).cast("long")
    return rows.select("eid", "kind", factor("src", ["many-1", "many-many"]).alias("k_src"), factor("tgt", ["1-many", "many-many"]).alias("k_tgt"))


def split_nodes(edges: DataFrame, nodes: int, chosen: DataFrame, density: float, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(members(node, i, member), edges(src, dst)) after the chosen (node, k) are split into k nodes each.

    Member 0 is the node, others get ids from `nodes` on, in the order of the nodes.
    Every neighbour goes to each member with probability 1 / k, to one at least;
    members are joined with probability `density`, in a chain if none is. Edges
    that touch no split node stay.
    """
    ordered = dense_ids(chosen, ["node"], "_nth")
    sums = checkpointed(ordered)
    # Fresh ids: the running sum of k - 1, in two levels.
    part = F.floor(F.col("_nth") / 4096)
    totals = sums.groupBy(part.alias("part")).agg(F.sum(F.col("k") - 1).alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    fresh = sums.withColumn("part", part).withColumn("_in", F.coalesce(F.sum(F.col("k") - 1).over(inside), F.lit(0))).join(F.broadcast(totals), "part")
    member = F.when(F.col("i") == 0, F.col("node")).otherwise(F.lit(nodes) + F.col("base") + F.col("_in") + F.col("i") - 1)
    members = fresh.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("node", "k", "i", member.cast("long").alias("member"))
    members = checkpointed(members)

    split = chosen.where("k > 1").select("node")
    rest = edges.select("src", "dst").join(split.select(F.col("node").alias("src")), "src", "left_anti").join(split.select(F.col("node").alias("dst")), "dst", "left_anti")
    near = edges.select(F.col("src").alias("node"), F.col("dst").alias("w")).join(chosen, "node")
    hit = F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: draw("ext", F.col("node"), F.col("w"), i, seed=seed) < 1.0 / F.col("k"))
    forced = F.array(draw_below(F.col("k"), "force", F.col("node"), F.col("w"), seed=seed))
    near = near.withColumn("hit", F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).when(F.size(hit) == 0, forced).otherwise(hit))
    outer = near.select("node", "w", F.explode("hit").alias("i")).join(members.select("node", "i", "member"), ["node", "i"]).select(F.col("member").alias("src"), F.col("w").alias("dst"))
    pairs = members.where("k > 1").select("node", "k", F.col("i").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("b")).where("a < b")
    drawn = pairs.withColumn("hit", draw("int", F.col("node"), F.col("a"), F.col("b"), seed=seed) < density)
    some = drawn.groupBy("node").agg(F.bool_or("hit").alias("some"))
    inner = drawn.join(some, "node").where("hit OR (NOT some AND b = a + 1)")
    ends = lambda x: members.select("node", F.col("i").alias(x), F.col("member").alias(f"m_{x}"))
    inner = inner.join(ends("a"), ["node", "a"]).join(ends("b"), ["node", "b"]).select(F.col("m_a").alias("src"), F.col("m_b").alias("dst"))
    every = undirected(rest.union(outer).union(inner).select(F.lit(0).alias("gid"), "src", "dst")).select("src", "dst")
    return members.select("node", "i", "member"), every


def overlapping(entities: DataFrame, ids: DataFrame, ratio: float, totals: dict[str, int], seed: str = SEED) -> DataFrame:
    """Memberships (eid, side, node) that are added: per side round(ratio * nodes) drawn ones, copied to another entity each."""
    dense = checkpointed(dense_ids(ids.select("eid"), ["eid"], "eix"))
    n = dense.count()
    out = None
    for side, total in totals.items():
        pool = entities.where(F.col("side") == side)
        target = min(int(round(ratio * total)), pool.count()) if ratio > 0 and n > 1 else 0
        ranked = hash_ranked(pool, "overlap", ["eid", "node"], seed).where(F.col("rank") < target).join(dense, "eid")
        other = draw_below(F.lit(n - 1), "share", F.col("eid"), F.col("node"), seed=seed)
        moved = ranked.withColumn("eix", F.when(other >= F.col("eix"), other + 1).otherwise(other)).select("side", "node", "eix").join(dense, "eix")
        new = moved.select("eid", "side", "node").distinct().join(entities, ["eid", "side", "node"], "left_anti")
        out = new if out is None else out.union(new)
    return out


RATIOS = {"1-1": 0.4, "1-many": 0.2, "many-1": 0.2, "many-many": 0.2}


def many_to_many(network: NetworkSet, ratios: dict[str, float] | None = None, max_expansion: int = 3, density: float = 0.5, overlap: float = 0.05, anchors_from: str = "test", train: str = "train", seed: str = SEED) -> dict[str, DataFrame]:
    """A many-to-many benchmark: entities, entity ids with their kinds, edges of both sides, training anchors."""
    if anchors_from not in ("test", "all") or train not in ("train", "one_to_one", "none"):
        raise ValueError("anchors come from test or all, training anchors are train, one_to_one or none")
    chosen = network.anchors if anchors_from == "all" else network.anchors.where("split = 'test'")
    pairs = one_to_one(chosen.select(F.col("aid").alias("id"), F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v")))
    ids = pairs.select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("eid"), "u", "v")
    kinds = checkpointed(typed_entities(ids.select("eid"), ratios or RATIOS, max_expansion, seed).join(ids, "eid"))
    out, entities, totals = {}, None, {}
    for g, side, end, k in ((0, "src", "u", "k_src"), (1, "tgt", "v", "k_tgt")):
        size = network.nodes.where(F.col("gid") == g).count()
        members, edges = split_nodes(network.graph(g), size, kinds.select(F.col(end).alias("node"), F.col(k).alias("k")), density, f"{seed}.{g}")
        rows = members.join(kinds.select("eid", F.col(end).alias("node")), "node").select("eid", F.lit(side).alias("side"), F.col("member").alias("node"))
        entities = rows if entities is None else entities.union(rows)
        out[f"edges{g}"], totals[side] = edges, members.select("member").distinct().count()
    entities = checkpointed(entities)
    added = overlapping(entities, ids, overlap, totals, seed)
    out |= {"entities": entities.union(added), "added": added, "kinds": kinds}
    if train == "train":
        out["train"] = network.anchors.where("split = 'train'").select(F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v"))
    elif train == "one_to_one":
        out["train"] = kinds.where("kind = '1-1'").select("u", "v")
    return out
