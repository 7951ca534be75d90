"""Graphs as edge tables (gid, src, dst, w): validation, filters, degrees, reshaping and normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmap.operators.local import signatures
from kinmap.operators.mapped import mounted
from kinmap.sources.fixtures import NetworkSet
from kinmap.session import broadcast_up_to, checkpointed


# Validation


def violations(network: NetworkSet, graphs: list[int]) -> DataFrame:
    """(rule, gid, n): one row for each broken rule and graph; empty for a valid set."""
    spark = network.nodes.sparkSession
    known = spark.createDataFrame([(g,) for g in graphs], "gid int")
    sizes = known.join(network.nodes.groupBy("gid").agg(F.count("*").alias("nodes")), "gid", "left")
    rules = []
    if len(graphs) < 2:
        rules.append(spark.createDataFrame([("two_graphs", -1, len(graphs))], "rule string, gid int, n long"))
    wide = network.anchors.where(F.size("nodes") != len(graphs))
    rules.append(wide.agg(F.count("*").alias("n")).select(F.lit("anchor_width").alias("rule"), F.lit(-1).alias("gid"), "n"))
    ends = network.edges.select("gid", F.explode(F.array("src", "dst")).alias("node"))
    sizes = F.broadcast(sizes)  # a row a graph; a shuffle by graph would give one task all of its edges
    out = ends.join(sizes, "gid").where((F.col("node") < 0) | (F.col("node") >= F.coalesce("nodes", F.lit(0))))
    rules.append(out.groupBy("gid").agg(F.count("*").alias("n")).select(F.lit("edge_range").alias("rule"), "gid", "n"))
    members = network.anchors.select(F.posexplode("nodes").alias("gid", "node"))
    lost = members.join(sizes, "gid").where((F.col("node") < -1) | (F.col("node") >= F.coalesce("nodes", F.lit(0))))
    rules.append(lost.groupBy("gid").agg(F.count("*").alias("n")).select(F.lit("anchor_range").alias("rule"), "gid", "n"))
    width = network.nodes.groupBy("gid").agg(F.count("x").alias("with_x"), F.count("*").alias("nodes"))
    part = width.where("with_x > 0 AND with_x < nodes").select(F.lit("attributes").alias("rule"), "gid", (F.col("nodes") - F.col("with_x")).alias("n"))
    rules.append(part)
    return reduce(DataFrame.unionByName, rules).where("n > 0").select("rule", F.col("gid").cast("int"), F.col("n").cast("long"))


def input_violations(network: NetworkSet, gids: list[int], pairwise: bool, use_attr: bool, supervised: bool) -> DataFrame:
    """(rule, n) for the inputs of a run: known and distinct graphs, their number, attributes and training anchors."""
    spark = network.nodes.sparkSession
    asked = spark.createDataFrame([(g,) for g in gids], "gid int")
    there = network.nodes.select("gid").distinct()
    rules = [
        asked.join(there, "gid", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_graph").alias("rule"), "n"),
        asked.groupBy("gid").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_graph").alias("rule"), "n"),
    ]
    if pairwise and len(gids) != 2:
        rules.append(spark.createDataFrame([("two_graphs", len(gids))], "rule string, n long"))
    if use_attr:
        bare = network.nodes.join(asked, "gid", "left_semi").where("x IS NULL")
        rules.append(bare.agg(F.count("*").alias("n")).select(F.lit("no_attributes").alias("rule"), "n"))
    if supervised:
        train = network.anchors.where("split = 'train'").agg(F.count("*").alias("m"))
        rules.append(train.select(F.lit("no_training_anchors").alias("rule"), F.when(F.col("m") == 0, 1).otherwise(0).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, rules).where("n > 0")


# Anchors


def anchor_pairs(anchors: DataFrame, g1: int, g2: int) -> DataFrame:
    pair = anchors.select(F.col("nodes")[g1].alias("u"), F.col("nodes")[g2].alias("v"))
    return pair.where("u <> -1 AND v <> -1")


def pairwise_anchor_pairs(anchors: DataFrame) -> DataFrame:
    """(g1, g2, u, v) for all graph pairs g1 < g2."""
    long = anchors.select("aid", F.posexplode("nodes").alias("g", "node")).where("node <> -1")
    one, two = (long.select("aid", F.col("g").alias(f"g{k}"), F.col("node").alias(x)) for k, x in ((1, "u"), (2, "v")))
    return one.join(two, "aid").where("g1 < g2").select("g1", "g2", "u", "v")


def multiway_anchors(anchors: DataFrame, gids: list[int]) -> DataFrame:
    """Anchors projected to gids, without rows that miss len(gids) graphs; -1 left over is an error."""
    missing = F.size(F.filter("nodes", lambda n: n == -1))
    chosen = F.array(*[F.col("nodes")[g] for g in gids])
    kept = anchors.where(missing != len(gids)).select("aid", chosen.alias("nodes"))
    checked = F.when(F.exists("nodes", lambda n: n == -1), F.raise_error(F.lit("an anchor misses a graph"))).otherwise(F.col("nodes"))
    return kept.select("aid", checked.alias("nodes"))


# Filters and neighbourhoods


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def with_end_in(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose `end` (src or dst) is in nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi").select(edges.columns)


def at_least(edges: DataFrame, threshold: float, value: str = "w") -> DataFrame:
    return edges.where(F.col(value) >= threshold)


def neighbours(edges: DataFrame, nodes: DataFrame, of: str) -> DataFrame:
    """(node, neighbours): sorted successors (of src) or predecessors (of dst) of the nodes."""
    other = "dst" if of == "src" else "src"
    there = with_end_in(edges, nodes, of)
    return there.groupBy(F.col(of).alias("node")).agg(F.array_sort(F.collect_list(other)).alias("neighbours"))


def plain_members(node_map: DataFrame, within: DataFrame, anchors: DataFrame, gid: int) -> DataFrame:
    """Nodes (mid, node) of one graph among `within` (mid) that stand for one node alone and are no anchor (mid)."""
    single = node_map.groupBy("mid").agg(F.count("*").alias("members")).where("members = 1").select("mid")
    rows = node_map.where(F.col("gid") == gid).join(within.select("mid").distinct(), "mid", "left_semi")
    return rows.join(single, "mid", "left_semi").join(anchors.select("mid"), "mid", "left_anti").select("mid", "node")


def is_binary(nodes: DataFrame) -> DataFrame:
    """(gid, binary): whether all attributes are 0 or 1."""
    return nodes.groupBy("gid").agg(F.bool_and(F.forall("x", lambda v: v.isin(0.0, 1.0))).alias("binary"))


def single_hop(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that touch the nodes, and the nodes of these edges with the given ones."""
    near = with_end_in(edges, nodes, "src").union(with_end_in(edges, nodes, "dst")).dropDuplicates()
    reached = nodes.select("node").union(near.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    return near, reached


def k_hops(edges: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """(start, node, layer): each node within k hops in its first layer; layer 0 is the start."""
    step = edges.select("src", "dst").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("layer"))
    front = seen
    for layer in range(1, k + 1):
        reach = front.join(step, front.node == step.src).select("start", F.col("dst").alias("node")).distinct()
        front = reach.join(seen, ["start", "node"], "left_anti").withColumn("layer", F.lit(layer))
        seen = seen.unionByName(front)
    return seen


def two_hop(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product: (src, dst, w) with the products of a's and b's weights summed over paths."""
    right = b.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("w").alias("wb"))
    paths = a.join(right, a.dst == right.mid)
    return paths.groupBy("src", F.col("end").alias("dst")).agg(F.sum(F.col("w") * F.col("wb")).alias("w"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def outside(nodes: DataFrame, subgraph: DataFrame) -> DataFrame:
    return nodes.join(subgraph.select("node"), "node", "left_anti")


#: More range partitions than this only send the driver more samples, sizes and states of tasks.
MOST_PARTS = 1000


def range_parts(rows: DataFrame, per_part: int) -> int:
    """How many range partitions the rows are cut into: about `per_part` rows each, in larger tables more."""
    return max(1, min(MOST_PARTS, -(-rows.count() // per_part)))


def dense_ids(rows: DataFrame, order: list[str], name: str = "id", per_part: int = 100_000, within: str | None = None) -> DataFrame:
    """Ids 0, 1, ... in the order of the columns, which must tell rows apart.

    Rows are computed once, range-partitioned and kept, partitions are counted, and ids
    are the places within a partition behind the rows of the partitions before it.
    """
    keys = ([within] if within else []) + order
    rows = checkpointed(rows)
    parts = range_parts(rows, per_part)
    dealt = rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    group = [within] if within else []
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(broadcast_up_to(offsets), [*group, "_part"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_n", "_in", "_before")


def running(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, per_part: int = 100_000) -> DataFrame:
    """Rows with the sum of the value over the rows before, by group; order columns must tell a group's rows apart.

    As for dense ids, a group of any size is spread over range partitions, and only
    the partitions' sums are put in sequence.
    """
    rows = checkpointed(rows)
    parts = range_parts(rows, per_part)
    dealt = checkpointed(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed_here = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*by, "_part"])
    return summed_here.withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def relabelled(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """The edges with one end replaced by ids(node, id); an end without an id is an error."""
    joined = edges.join(ids.select(F.col("node").alias(end), F.col("id").alias("_id")), end, "left")
    checked = F.when(F.col("_id").isNull(), F.raise_error(F.lit("an end of an edge has no id"))).otherwise(F.col("_id"))
    return joined.withColumn(end, checked).select(edges.columns)


# Merging


def merge_on_anchors(network: NetworkSet) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(node_map, edges, attributes, merged): several graphs as one.

    The first present member of an anchor stands for the others; of several
    anchors that name a node the last one counts; a standing node that is itself
    mapped is followed, which takes at most as many steps as there are graphs.
    """
    members = network.anchors.select("aid", F.posexplode("nodes").alias("gid", "node")).where("node > -1")
    first = members.groupBy("aid").agg(F.min_by(F.struct("gid", "node"), "gid").alias("to"))
    mapped = members.join(first, "aid").where("gid <> to.gid")
    mapped = mapped.groupBy("gid", "node").agg(F.max_by("to", "aid").alias("to"))
    graphs = network.nodes.select("gid").distinct().count()
    for _ in range(max(0, graphs - 1)):
        onward = mapped.select(F.col("gid").alias("g2"), F.col("node").alias("n2"), F.col("to").alias("further"))
        met = (F.col("to.gid") == F.col("g2")) & (F.col("to.node") == F.col("n2"))
        mapped = mapped.join(onward, met, "left").select("gid", "node", F.coalesce("further", "to").alias("to"))
    keys = network.nodes.select("gid", "node")
    own = dense_ids(keys.join(mapped, ["gid", "node"], "left_anti"), ["gid", "node"], "mid")
    taken = mapped.select("gid", "node", F.col("to.gid").alias("t_gid"), F.col("to.node").alias("t_node"))
    taken = taken.join(own.select(F.col("gid").alias("t_gid"), F.col("node").alias("t_node"), "mid"), ["t_gid", "t_node"])
    node_map = own.unionByName(taken.select("gid", "node", "mid"))
    merged = taken.select("mid").distinct()

    ends = lambda e: node_map.select("gid", F.col("node").alias(e), F.col("mid").alias(f"m_{e}"))
    edges = network.edges.join(ends("src"), ["gid", "src"]).join(ends("dst"), ["gid", "dst"])
    edges = edges.select("gid", F.col("m_src").alias("src"), F.col("m_dst").alias("dst"), "w", "edge_attr")
    values = network.nodes.where("x IS NOT NULL").join(node_map, ["gid", "node"]).select("mid", F.posexplode("x").alias("pos", "value"))
    means = values.groupBy("mid", "pos").agg(F.avg("value").alias("value"))
    attributes = means.groupBy("mid").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x"))
    return node_map, edges, attributes.select("mid", F.transform("x", lambda s: s["value"]).alias("x")), merged


def merge_two(network: NetworkSet, split: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node_map, edges with etype, attributes): graph 1 into graph 0, anchors by the greater attributes."""
    links = network.pairs(split).groupBy("v").agg(F.max("u").alias("u"))
    first = network.nodes.where("gid = 0").select("node", "x")
    second = network.nodes.where("gid = 1").select("node", "x")
    n1 = first.agg((F.max("node") + 1).alias("n")).first().n or 0
    rest = dense_ids(second.join(links, second.node == links.v, "left_anti"), ["node"], "id")
    node_map = links.select(F.col("v").alias("node"), F.col("u").alias("mid")).union(rest.select("node", (F.col("id") + n1).alias("mid")))
    ends = lambda e: node_map.select(F.col("node").alias(e), F.col("mid").alias(f"m_{e}"))
    moved = network.graph(1).join(ends("src"), "src").join(ends("dst"), "dst").select(F.col("m_src").alias("src"), F.col("m_dst").alias("dst"), F.lit(1).alias("etype"))
    edges = network.graph(0).select("src", "dst", F.lit(0).alias("etype")).union(moved)
    placed = second.join(node_map, "node").select("mid", F.col("x").alias("x2"))
    both = first.withColumnRenamed("node", "mid").join(placed, "mid", "full_outer")
    greater = F.zip_with("x", "x2", lambda a, b: F.greatest(a, b))
    return node_map, edges, both.select("mid", F.coalesce(greater, "x", "x2").alias("x"))


# Coarsening


def top_nodes(scores: DataFrame, ratio: float) -> DataFrame:
    """The best ceil(ratio * n) nodes of each graph by score, ties by id; (gid, node, rank)."""
    counts = scores.groupBy("gid").agg(F.ceil(F.count("*") * F.lit(ratio)).alias("k"))
    ranked = dense_ids(scores.withColumn("_low", -F.col("score")), ["_low", "node"], "rank", within="gid")
    ranked = ranked.withColumn("rank", F.col("rank") + 1).join(F.broadcast(counts), "gid")
    return ranked.where("rank <= k").select("gid", "node", "rank")


def coarsening(edges: DataFrame, nodes: DataFrame, supernodes: DataFrame) -> DataFrame:
    """(node, supernode, w) of one graph, supernodes by their dense id (node, id).

    Edges to supernodes; nodes without take two hops; nodes without these spread
    evenly; supernodes go to themselves alone.
    """
    one = with_end_in(edges, supernodes, "dst")
    far = isolated(nodes, one)
    two = two_hop(with_end_in(edges, far, "src"), one)
    reached = one.select("src", "dst", "w").union(two.select("src", "dst", "w"))
    lone = isolated(nodes, reached).join(supernodes, "node", "left_anti").select("node")
    size = supernodes.agg(F.count("*").alias("k"))
    # Rows times supernodes: what an even spread is; both sides are of one graph after coarsening.
    spread = lone.crossJoin(broadcast_up_to(supernodes.select(F.col("id").alias("supernode")))).crossJoin(F.broadcast(size))
    spread = spread.select("node", "supernode", (F.lit(1.0) / F.col("k")).alias("w"))
    plain = reached.join(supernodes.select(F.col("node").alias("src")), "src", "left_anti")
    plain = relabelled(plain, supernodes, "dst").select(F.col("src").alias("node"), F.col("dst").alias("supernode"), "w")
    return plain.union(spread).union(supernodes.select("node", F.col("id").alias("supernode"), F.lit(1.0).alias("w")))


def coarse_edges(edges: DataFrame, supernodes: DataFrame) -> DataFrame:
    """Edges between supernodes by dense id, without loops."""
    inside = with_end_in(with_end_in(edges, supernodes, "src"), supernodes, "dst")
    return without_loops(relabelled(relabelled(inside, supernodes, "src"), supernodes, "dst"))


# Degrees and normalisation


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, node, out, in, total), zeros for isolated nodes."""
    ends = edges.select("gid", F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(edges.select("gid", F.col("dst").alias("node"), F.lit(0), F.lit(1)))
    counts = ends.groupBy("gid", "node").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
    joined = nodes.select("gid", "node").join(counts, ["gid", "node"], "left").na.fill(0, ["out", "in"])
    return joined.withColumn("total", F.col("out") + F.col("in"))


def summary(network: NetworkSet, edges: DataFrame | None = None) -> DataFrame:
    """(gid, nodes, edges, x_width, edge_width, train, test); (gid, edges, edge_width) where they are known without the edges."""
    nodes = network.nodes.groupBy("gid").agg(F.count("*").alias("nodes"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("x_width"))
    if edges is None:
        edges = network.edges.groupBy("gid").agg(F.count("*").alias("edges"), F.coalesce(F.max(F.when(F.col("edge_attr").isNotNull(), F.size("edge_attr"))), F.lit(0)).alias("edge_width"))
    anchors = network.anchors.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    joined = nodes.join(edges, "gid", "left").na.fill(0, ["edges", "edge_width"]).crossJoin(F.broadcast(anchors))
    return joined.select("gid", "nodes", "edges", "x_width", "edge_width", "train", "test")


def summed(edges: DataFrame) -> DataFrame:
    """Parallel edges as one with the sum of their weights."""
    return edges.groupBy("gid", "src", "dst").agg(F.sum("w").alias("w"))


def stochastic(edges: DataFrame, by: str = "src") -> DataFrame:
    """Weights divided by the sum of their row (src) or column (dst); zero sums stay zero."""
    sums = edges.groupBy("gid", by).agg(F.sum("w").alias("_sum"))
    share = F.when(F.col("_sum") == 0, 0.0).otherwise(F.col("w") / F.col("_sum"))
    return edges.join(sums, ["gid", by]).select("gid", "src", "dst", share.alias("w"))


def symmetric(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """d_i^-1/2 (A + I) d_j^-1/2 with degrees that count the loop."""
    looped = edges.select("gid", "src", "dst", "w").union(nodes.select("gid", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")))
    degree = looped.groupBy("gid", F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    end = lambda e: degree.select("gid", F.col("node").alias(e), F.col("d").alias(f"d_{e}"))
    joined = summed(looped).join(end("src"), ["gid", "src"]).join(end("dst"), ["gid", "dst"])
    return joined.select("gid", "src", "dst", (F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("w"))


def edge_softmax(edges: DataFrame) -> DataFrame:
    """exp(w) over its sum by src, shifted by the largest weight."""
    top = edges.groupBy("gid", "src").agg(F.max("w").alias("_top"))
    raised = edges.join(top, ["gid", "src"]).select("gid", "src", "dst", F.exp(F.col("w") - F.col("_top")).alias("w"))
    return stochastic(raised)


def degree_shares(nodes: DataFrame, edges: DataFrame, power: float = 0.75) -> DataFrame:
    """(gid, node, p) with p proportional to the out-degree's power."""
    weight = F.pow(F.col("out").cast("double"), power)
    rows = degrees(nodes, edges).select("gid", "node", weight.alias("weight"))
    totals = rows.groupBy("gid").agg(F.sum("weight").alias("total"))
    return rows.join(F.broadcast(totals), "gid").select("gid", "node", (F.col("weight") / F.col("total")).alias("p"))


def one_hot_anchors(network: NetworkSet, split: str = "train") -> DataFrame:
    """(gid, node, pos, value): anchors by their place in the order of aid."""
    ranked = dense_ids(network.anchors.where(F.col("split") == split), ["aid"], "pos")
    return ranked.select("pos", F.posexplode("nodes").alias("gid", "node")).where("node <> -1").select("gid", "node", "pos", F.lit(1.0).alias("value"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("gid", "src", "dst").union(edges.select("gid", "dst", "src")).distinct()


def unit(vector: Column) -> Column:
    """The vector over its length; zero stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda v: v / norm))


def column_moments(nodes: DataFrame) -> DataFrame:
    """(gid, pos, mean, std): sample deviation plus 1e-12."""
    values = nodes.select("gid", F.posexplode("x").alias("pos", "value"))
    return values.groupBy("gid", "pos").agg(F.avg("value").alias("mean"), (F.coalesce(F.stddev_samp("value"), F.lit(0.0)) + 1e-12).alias("std"))


def words_of(node: str) -> tuple[Column, Column]:
    """The word of 64 ids that holds an id, and the id's bit in it."""
    return F.shiftright(node, 6), F.expr(f"shiftleft(1L, CAST({node} & 63 AS INT))")


def balls(nodes: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """(gid, node, layer, chunk, bits): whom each node first reaches in each layer, 64 ids a row; layer 0 is the node itself.

    What a node reaches in a layer is what its neighbours reach in the one before, less
    what it has seen, so a hop is one join with the edges and one bit_or, and no row
    stands for a reached pair where ids are dense; with scattered ids rows are as many as pairs.
    """
    step = edges.select("gid", F.col("src").alias("node"), F.col("dst").alias("near")).distinct()
    chunk, bit = words_of("node")
    key = ["gid", "node", "chunk"]
    front = nodes.select("gid", "node", chunk.alias("chunk"), bit.alias("bits"))
    seen, out = front, front.withColumn("layer", F.lit(0))
    for layer in range(1, layers + 1):
        reach = step.join(front.withColumnRenamed("node", "near"), ["gid", "near"]).groupBy(*key).agg(F.bit_or("bits").alias("bits"))
        left = reach.join(seen.withColumnRenamed("bits", "old"), key, "left")
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        front = left.select(*key, new.alias("bits")).where("bits <> 0")
        out = out.unionByName(front.withColumn("layer", F.lit(layer)))
        if layer < layers:
            seen = seen.unionByName(front).groupBy(*key).agg(F.bit_or("bits").alias("bits"))
    return out


def degree_signature(nodes: DataFrame, edges: DataFrame, layers: int = 2, base: float = 2.0, alpha: float = 0.01) -> DataFrame:
    """(gid, node, bucket, value): discounted histograms of log-degrees of the neighbours by layer.

    A node's layers are found in one task along mapped edges, whose weights are the buckets of
    their ends. Where tasks can't map files, buckets are masks of words of ids, so a histogram
    counts bits of a ball's words.
    """
    bucket = F.floor(F.log2(F.col("out").cast("double")) / F.log2(F.lit(base))).cast("int")
    if mounted(nodes):
        own = checkpointed(degrees(nodes, edges).select("gid", "node", F.when(F.col("out") > 0, bucket).otherwise(-1).alias("bucket")).distinct())
        ends = own.withColumnRenamed("node", "dst")
        links = checkpointed(edges.select("gid", "src", "dst").distinct().join(ends, ["gid", "dst"], "left").na.fill(-1, ["bucket"]))
        parts = []
        for (gid,) in own.select("gid").distinct().collect():
            mine = F.col("gid") == gid
            found = signatures(own.where(mine), links.where(mine), layers, alpha)
            parts.append(found.select(F.lit(gid).cast("int").alias("gid"), "node", "bucket", "value"))
        if parts:
            return reduce(DataFrame.unionByName, parts)
    chunk, bit = words_of("node")
    masks = degrees(nodes, edges).where("out > 0").groupBy("gid", chunk.alias("chunk"), bucket.alias("bucket")).agg(F.bit_or(bit).alias("mask"))
    found = balls(nodes, edges, layers).join(masks, ["gid", "chunk"]).withColumn("n", F.bit_count(F.col("bits").bitwiseAND(F.col("mask")))).where("n > 0")
    return found.groupBy("gid", "node", "bucket").agg(F.sum(F.col("n") * F.pow(F.lit(alpha), F.col("layer"))).alias("value"))
