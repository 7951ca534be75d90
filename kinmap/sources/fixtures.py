"""Network sets that Spark derives from the order, event and embedding tables.

The same definitions exist as DuckDB text (`SQL`), so that oracles start from the
tables as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.functions.draws import draw
from kinmap.operators.shared import attribute_sums, shared_counts
from kinmap.session import checkpointed


@dataclass(frozen=True)
class NetworkSet:
    """nodes(gid, node, x), edges(gid, src, dst, w, edge_attr), anchors(aid, nodes, split)."""

    nodes: DataFrame
    edges: DataFrame
    anchors: DataFrame

    def graph(self, gid: int) -> DataFrame:
        return self.edges.where(F.col("gid") == gid)

    def pairs(self, split: str | None = None) -> DataFrame:
        anchors = self.anchors if split is None else self.anchors.where(F.col("split") == split)
        pair = anchors.select(F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v"))
        return pair.where("u <> -1 AND v <> -1")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(*[{"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}.get(c, F.col(c)) for c in edges.columns])
    return edges.unionByName(back)


def one_hot(value: Column, values: list[str]) -> Column:
    return F.array(*[F.when(value == v, 1.0).otherwise(0.0) for v in values])


def customer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    both = customers.withColumn("gid", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select("gid", F.col("c_custkey").alias("node"), one_hot(F.col("c_mktsegment"), SEGMENTS).alias("x"))


def with_anchors(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> NetworkSet:
    """Anchors: nodes with edges in both graphs, to themselves; a fifth (by hash) for training. `sources` (gid, src) have edges."""
    seen = (edges if sources is None else sources).select("gid", "src").distinct().groupBy("src").count().where("count = 2")
    split = F.when(draw("split", F.col("src")) < 0.2, "train").otherwise("test")
    anchors = seen.select(F.col("src").alias("aid"), F.array("src", "src").alias("nodes"), split.alias("split"))
    return NetworkSet(nodes, edges, anchors)


def chains(spark: SparkSession, sf_dir: str) -> NetworkSet:
    """L: each order's customer linked to the next order's of the same day, priority and parity."""
    orders = table(spark, sf_dir, "orders")
    gid = (F.col("o_orderkey") % 2).cast("int").alias("gid")
    following = Window.partitionBy("gid", "o_orderdate", "o_orderpriority").orderBy("o_orderkey")
    links = orders.select(gid, "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    links = links.select("gid", F.col("o_custkey").alias("src"), F.lead("o_custkey").over(following).alias("dst"))
    links = both_ways(links.where("dst IS NOT NULL AND src <> dst")).distinct()
    edges = links.select("*", F.lit(1.0).alias("w"), F.lit(None).cast("array<double>").alias("edge_attr"))
    return with_anchors(customer_nodes(spark, sf_dir), edges)


def kept(network: NetworkSet) -> NetworkSet:
    """The same set with edges and anchors computed once, for jobs that read them many times."""
    return NetworkSet(network.nodes, checkpointed(network.edges), checkpointed(network.anchors))


DAY = ["gid", "o_orderdate", "o_orderpriority"]


def day_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, o_custkey, o_orderdate, o_orderpriority): who ordered on a day at a priority."""
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 2).cast("int").alias("gid"), "o_custkey", *DAY[1:]).distinct()


def day_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, edges, edge_width) of `order_days`, counted without a row an edge."""
    days = day_members(spark, sf_dir).dropna()
    places = days.select("gid", F.xxhash64(*DAY[1:]).alias("place"), F.col("o_custkey").alias("node"))
    counts = shared_counts(places).where("edges > 0")
    return counts.select("gid", "edges", F.lit(len(PRIORITIES)).alias("edge_width"))


def day_sums(spark: SparkSession, sf_dir: str, gid: int, units: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, e, a, value) of `order_days`: unit attributes summed over a node's edges by priority, made without a row an edge."""
    e = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("o_orderpriority")) - 1
    days = day_members(spark, sf_dir).dropna().where(F.col("gid") == gid)
    places = days.select(F.col("o_custkey").alias("node"), F.xxhash64(*DAY[1:]).alias("place"), e.alias("e")).where("e >= 0")
    return attribute_sums(checkpointed(places), units, asked, len(PRIORITIES))


def order_days(spark: SparkSession, sf_dir: str) -> NetworkSet:
    """O: customers with orders on the same day at the same priority; one-hot priorities on edges."""
    keys, one = DAY, day_members(spark, sf_dir)
    pairs = one.withColumnRenamed("o_custkey", "src").join(one.withColumnRenamed("o_custkey", "dst"), keys)
    pairs = pairs.where("src <> dst").select("gid", "src", "dst", "o_orderpriority").distinct()
    attr = F.array(*[F.max(F.when(F.col("o_orderpriority") == p, 1.0).otherwise(0.0)) for p in PRIORITIES])
    edges = pairs.groupBy("gid", "src", "dst").agg(F.lit(1.0).alias("w"), attr.alias("edge_attr"))
    # A customer has an edge where another ordered too.
    several = one.dropna().groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    sources = one.join(several, keys, "left_semi").select("gid", F.col("o_custkey").alias("src"))
    return with_anchors(customer_nodes(spark, sf_dir), edges, sources)


def event_walks(spark: SparkSession, sf_dir: str) -> NetworkSet:
    """V: from each event's user to the next event's user; parallel edges are kept."""
    events = table(spark, sf_dir, "events")
    gid = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)
    # The next event by time: days are put in sequence by their first user, users within a day by a window.
    day = F.to_date("ts")
    rows = events.select(gid.alias("gid"), "ts", "event_id", F.col("user_id").alias("src"), day.alias("day"))
    inside = Window.partitionBy("gid", "day").orderBy("ts", "event_id")
    rows = rows.withColumn("dst", F.lead("src").over(inside))
    days = rows.groupBy("gid", "day").agg(F.min_by("src", F.struct("ts", "event_id")).alias("first"))
    days = days.select("gid", "day", F.lead("first").over(Window.partitionBy("gid").orderBy("day")).alias("after"))
    rows = rows.join(days, ["gid", "day"]).withColumn("dst", F.coalesce("dst", "after"))
    links = rows.where("dst IS NOT NULL AND src <> dst").select("gid", "src", "dst")
    edges = links.select("*", F.lit(1.0).alias("w"), F.lit(None).cast("array<double>").alias("edge_attr"))
    users = events.select(F.col("user_id").alias("node")).distinct()
    nodes = users.withColumn("gid", F.explode(F.array(F.lit(0), F.lit(1))))
    nodes = nodes.select("gid", "node", F.lit(None).cast("array<double>").alias("x"))
    return with_anchors(nodes, edges)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: emb(gid, node, vec, label): embeddings dealt to two graphs by parity."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        (F.col("vec_id") % 2).cast("int").alias("gid"),
        F.floor(F.col("vec_id") / 2).alias("node"),
        F.col("embedding").cast("array<double>").alias("vec"),
        "label",
    )


def entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """N: (entities(eid, side, node), entity_ids(eid)): customers and suppliers of a nation."""
    eid = lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias("eid")
    src = table(spark, sf_dir, "customer").select(eid("c_nationkey"), F.lit("src").alias("side"), F.col("c_custkey").alias("node"))
    tgt = table(spark, sf_dir, "supplier").select(eid("s_nationkey"), F.lit("tgt").alias("side"), F.col("s_suppkey").alias("node"))
    return src.unionByName(tgt), table(spark, sf_dir, "nation").select(eid("n_nationkey"))


def customer_entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The large variant: three customers each and their orders."""
    eid = lambda c: F.concat(F.lit("c"), F.floor(F.col(c) / 3).cast("string")).alias("eid")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    src = customers.select(eid("c_custkey"), F.lit("src").alias("side"), F.col("c_custkey").alias("node"))
    tgt = orders.select(eid("o_custkey"), F.lit("tgt").alias("side"), F.col("o_orderkey").alias("node"))
    return src.unionByName(tgt), customers.select(eid("c_custkey")).distinct()


RATES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


def predictions(truth: DataFrame, ids: DataFrame, modulus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pred(rate, eid, side, node), pred_ids(rate, eid)): the error sweep over truth.

    A target is replaced with probability rate by a drawn one below the modulus
    (one row, column m), and an entity is missing when its draw is under 0.05.
    """
    rates = F.explode(F.array(*map(F.lit, RATES))).alias("rate")
    there = ids.select(rates, "eid").where(draw("miss", F.col("rate"), F.col("eid")) >= 0.05)
    rows = truth.join(there, "eid").crossJoin(F.broadcast(modulus))
    other = F.floor(draw("pick", F.col("rate"), F.col("eid"), F.col("node")) * F.col("m")).cast("long")
    moved = (F.col("side") == "tgt") & (draw("err", F.col("rate"), F.col("eid"), F.col("node")) < F.col("rate"))
    node = F.when(moved, other).otherwise(F.col("node"))
    return rows.select("rate", "eid", "side", node.alias("node")), there


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT / 4503599627370496.0)"


U = _u
SQL = f"""
l_raw AS (SELECT (o_orderkey % 2)::INT AS gid, o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderkey % 2, o_orderdate, o_orderpriority ORDER BY o_orderkey) AS dst FROM orders),
l_edges AS (SELECT gid, src, dst, 1.0::DOUBLE AS w FROM (SELECT * FROM l_raw UNION SELECT gid, dst, src FROM l_raw) WHERE src <> dst),
l_anchors AS (SELECT src AS aid, CASE WHEN {_u("'42'", "'split'", "src::VARCHAR")} < 0.2 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT gid, src FROM l_edges) GROUP BY src HAVING count(*) = 2),
c_nodes AS (SELECT g.gid, c_custkey AS node, [{', '.join(f"(c_mktsegment = '{s}')::INT::DOUBLE" for s in SEGMENTS)}] AS x FROM customer, (SELECT unnest([0, 1])::INT AS gid) g),
o_one AS (SELECT DISTINCT (o_orderkey % 2)::INT AS gid, o_custkey AS c, o_orderdate AS d, o_orderpriority AS p FROM orders),
o_pairs AS (SELECT DISTINCT a.gid, a.c AS src, b.c AS dst, a.p FROM o_one a JOIN o_one b ON a.gid = b.gid AND a.d = b.d AND a.p = b.p AND a.c <> b.c),
o_edges AS (SELECT gid, src, dst, 1.0::DOUBLE AS w, [{', '.join(f"max((p = '{s}')::INT)::DOUBLE" for s in PRIORITIES)}] AS edge_attr FROM o_pairs GROUP BY gid, src, dst),
v_raw AS (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS gid, ts, event_id, user_id AS src FROM events),
v_next AS (SELECT gid, src, lead(src) OVER (PARTITION BY gid ORDER BY ts, event_id) AS dst FROM v_raw),
v_edges AS (SELECT gid, src, dst, 1.0::DOUBLE AS w FROM v_next WHERE dst IS NOT NULL AND src <> dst),
v_nodes AS (SELECT DISTINCT g.gid, user_id AS node FROM events, (SELECT unnest([0, 1])::INT AS gid) g),
v_anchors AS (SELECT src AS aid, CASE WHEN {_u("'42'", "'split'", "src::VARCHAR")} < 0.2 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT gid, src FROM v_edges) GROUP BY src HAVING count(*) = 2),
e_vec AS (SELECT (vec_id % 2)::INT AS gid, vec_id // 2 AS node, embedding::DOUBLE[] AS vec, label FROM embeddings),
n_truth AS (SELECT 'n' || c_nationkey AS eid, 'src' AS side, c_custkey AS node FROM customer UNION ALL SELECT 'n' || s_nationkey, 'tgt', s_suppkey FROM supplier),
n_ids AS (SELECT 'n' || n_nationkey AS eid FROM nation),
n_mod AS (SELECT count(*) AS m FROM supplier),
k_truth AS (SELECT 'c' || (c_custkey // 3) AS eid, 'src' AS side, c_custkey AS node FROM customer UNION ALL SELECT 'c' || (o_custkey // 3), 'tgt', o_orderkey FROM orders),
k_ids AS (SELECT DISTINCT 'c' || (c_custkey // 3) AS eid FROM customer),
k_mod AS (SELECT count(*) AS m FROM orders),
rates AS (SELECT unnest([{', '.join(map(str, RATES))}])::DOUBLE AS rate),
n_pred_ids AS (SELECT rate, eid FROM n_ids, rates WHERE {_u("'42'", "'miss'", "rate::VARCHAR", "eid")} >= 0.05),
n_pred AS (SELECT rate, eid, side, CASE WHEN side = 'tgt' AND {_u("'42'", "'err'", "rate::VARCHAR", "eid", "node::VARCHAR")} < rate THEN floor({_u("'42'", "'pick'", "rate::VARCHAR", "eid", "node::VARCHAR")} * m)::BIGINT ELSE node END AS node FROM n_truth JOIN n_pred_ids USING (eid), n_mod),
k_pred_ids AS (SELECT rate, eid FROM k_ids, rates WHERE {_u("'42'", "'miss'", "rate::VARCHAR", "eid")} >= 0.05),
k_pred AS (SELECT rate, eid, side, CASE WHEN side = 'tgt' AND {_u("'42'", "'err'", "rate::VARCHAR", "eid", "node::VARCHAR")} < rate THEN floor({_u("'42'", "'pick'", "rate::VARCHAR", "eid", "node::VARCHAR")} * m)::BIGINT ELSE node END AS node FROM k_truth JOIN k_pred_ids USING (eid), k_mod)
"""


def sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    """DuckDB text over the fixtures: more CTEs and a body."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{',' + ctes if ctes else ''}\n{body}"
