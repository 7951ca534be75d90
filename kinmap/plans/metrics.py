"""Queries on ranks, similarities and group metrics, and on their files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinmap.functions.draws import draw
from kinmap.operators import groups, ranking
from kinmap.operators.graph import degrees
from kinmap.operators.mapped import path_sums
from kinmap.plans.base import query
from kinmap.session import broadcast_up_to, checkpointed, shared_folder
from kinmap.sources import entities as entity_files
from kinmap.sources import fixtures as fx
from kinmap.sources import networks
from kinmap.sources.fixtures import U, sql

#: Pairs by common neighbours over both graphs; some negative, so that all rank rules are met.
PAIRS = f"""pr AS (SELECT a.src AS u, b.dst AS v, count(*)::DOUBLE * CASE WHEN {U("'42'", "'sign'", 'a.src::VARCHAR')} < 0.05 THEN -1 ELSE 1 END AS score
FROM l_edges a JOIN l_edges b ON a.gid = 0 AND b.gid = 1 AND a.dst = b.src GROUP BY a.src, b.dst),
tests AS (SELECT aid AS u, aid AS v FROM l_anchors WHERE split = 'test'), nn AS (SELECT c_custkey AS node FROM customer)"""
RANKED = PAIRS + """, rl AS (SELECT u, v, rank FROM (SELECT t.u, n.node AS v, t.v AS want, row_number() OVER (PARTITION BY t.u ORDER BY coalesce(score, 0) DESC, n.node) AS rank FROM tests t, nn n LEFT JOIN pr ON pr.u = t.u AND pr.v = n.node) WHERE v = want),
rr AS (SELECT u, v, rank FROM (SELECT n.node AS u, t.v, t.u AS want, row_number() OVER (PARTITION BY t.v ORDER BY coalesce(score, 0) DESC, n.node) AS rank FROM tests t, nn n LEFT JOIN pr ON pr.v = t.v AND pr.u = n.node) WHERE u = want),
h AS (SELECT k, (SELECT avg((rank <= k)::INT) FROM rl) AS l, (SELECT avg((rank <= k)::INT) FROM rr) AS r FROM (SELECT unnest([1, 10, 30, 50]) AS k)), m AS (SELECT (SELECT avg(1.0 / rank) FROM rl) AS l, (SELECT avg(1.0 / rank) FROM rr) AS r)"""


def path_pairs(net, by: str = "u"):
    """The pairs (u, v, score), those of a u or of a v in one task."""
    sign = F.when(draw("sign", F.col("src")) < 0.05, -1.0).otherwise(1.0)
    one = net.graph(0).select(F.col("src").alias("u"), F.col("dst").alias("mid"), sign.alias("w"))
    two = net.graph(1).select(F.col("src").alias("mid"), F.col("dst").alias("v"), F.lit(1.0).alias("w"))
    return path_sums(one, two, by)


def ranked(spark, d):
    net = fx.kept(fx.chains(spark, d))
    n = fx.table(spark, d, "customer").count()
    return ranking.both_ranks(path_pairs(net), net.pairs("test"), n, n, path_pairs(net, "v"))


@query("e8_hits_by_direction", sql("SELECT 'ltr' AS direction, 'Hits@' || k AS name, round(l, 9) AS value FROM h UNION ALL SELECT 'rtl', 'Hits@' || k, round(r, 9) FROM h", RANKED))
def e8(spark, d):
    rows = checkpointed(ranked(spark, d))
    both = [ranking.hits(rows, mode).select(F.lit(mode).alias("direction"), "name", F.round("value", 9).alias("value")) for mode in ("ltr", "rtl")]
    return both[0].union(both[1])


@query("e8_ranks", sql("SELECT u, v, 'ltr' AS direction, rank FROM rl UNION ALL SELECT u, v, 'rtl', rank FROM rr", RANKED))
def e8r(spark, d):
    return ranked(spark, d).select("u", "v", "direction", "rank")


@query("e9_hits_combined", sql("SELECT 'mean' AS mode, 'Hits@' || k AS name, round((l + r) / 2, 9) AS value FROM h UNION ALL SELECT 'max', 'Hits@' || k, round(greatest(l, r), 9) FROM h", RANKED))
def e9(spark, d):
    rows = checkpointed(ranked(spark, d))
    both = [ranking.hits(rows, mode).select(F.lit(mode).alias("mode"), "name", F.round("value", 9).alias("value")) for mode in ("mean", "max")]
    return both[0].union(both[1])


@query("e10_mrr", sql("SELECT unnest(['ltr', 'rtl', 'mean', 'max']) AS mode, round(unnest([l, r, (l + r) / 2, greatest(l, r)]), 9) AS value FROM m", RANKED))
def e10(spark, d):
    rows = checkpointed(ranked(spark, d))
    parts = [ranking.mrr(rows, mode).select(F.lit(mode).alias("mode"), F.round("value", 9).alias("value")) for mode in ("ltr", "rtl", "mean", "max")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("e11_evaluate", sql("SELECT 'Hits@' || k AS name, round((l + r) / 2, 9) AS value FROM h UNION ALL SELECT 'MRR', round((l + r) / 2, 9) FROM m", RANKED))
def e11(spark, d):
    net = fx.kept(fx.chains(spark, d))
    n = fx.table(spark, d, "customer").count()
    return ranking.evaluate(path_pairs(net), net.pairs("test"), n, n).withColumn("value", F.round("value", 9))


@query("e6_degree_anchors", sql("SELECT u, v, 1.0 / (1 + gap) AS score FROM (SELECT a.node AS u, b.node AS v, abs(a.d - b.d) AS gap FROM dd a, dd b WHERE a.gid = 0 AND b.gid = 1) ORDER BY gap, u, v LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM customer)", "dd AS (SELECT n.gid, n.node, count(e.src) AS d FROM c_nodes n LEFT JOIN l_edges e ON e.gid = n.gid AND e.src = n.node GROUP BY n.gid, n.node)"))
def e6(spark, d):
    net = fx.chains(spark, d)
    rows = degrees(net.nodes, net.edges).select("gid", "node", F.col("out").alias("degree"))
    k = int(0.1 * fx.table(spark, d, "customer").count())
    return ranking.degree_anchors(rows.where("gid = 0").drop("gid"), rows.where("gid = 1").drop("gid"), k)


@query("e12_best_per_target", sql("SELECT v, arg_max(u, (s, -u)) AS u, round(max(s), 9) AS score FROM (SELECT u, v, (1 + score) / 2 * 0.7 + CASE WHEN u = v THEN 0.3 ELSE 0 END AS s FROM pr) GROUP BY v", PAIRS))
def e12(spark, d):
    pairs = path_pairs(fx.kept(fx.chains(spark, d)), "v")
    prior = pairs.where("u = v").select("u", "v", F.lit(1.0).alias("score"))
    return ranking.best_per_target(pairs, prior, 0.3).withColumn("score", F.round("score", 9))


@query("e13_mutual_best", sql("SELECT u, v FROM (SELECT u, arg_max(v, (score, -v)) AS v FROM pr GROUP BY u) INTERSECT SELECT u, v FROM (SELECT v, arg_max(u, (score, -u)) AS u FROM pr GROUP BY v)", PAIRS))
def e13(spark, d):
    net = fx.kept(fx.chains(spark, d))
    return ranking.mutual_best(path_pairs(net), path_pairs(net, "v"))


@query("e14_hard_negatives", sql("SELECT 'ltr' AS direction, u, v, rank FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY score DESC, v) AS rank FROM pr WHERE u IN (SELECT u FROM tests)) WHERE rank <= 3 UNION ALL SELECT 'rtl', u, v, rank FROM (SELECT u, v, row_number() OVER (PARTITION BY v ORDER BY score DESC, u) AS rank FROM pr WHERE v IN (SELECT v FROM tests)) WHERE rank <= 3", PAIRS))
def e14(spark, d):
    net = fx.kept(fx.chains(spark, d))
    pairs, turned, tests = path_pairs(net), path_pairs(net, "v"), net.pairs("test")
    one = ranking.nearest(pairs.join(tests.select("u"), "u", "left_semi"), 3, "u", "v").select(F.lit("ltr").alias("direction"), "u", "v", "rank")
    two = ranking.nearest(turned.join(tests.select("v"), "v", "left_semi"), 3, "v", "u").select(F.lit("rtl").alias("direction"), "u", "v", "rank")
    return one.union(two)


@query("e15_top_share", sql("SELECT u, v, round(score / sum(score) OVER (), 9) AS score FROM pr ORDER BY score DESC, u, v LIMIT 1000".replace("ORDER BY score", "ORDER BY pr.score"), PAIRS))
def e15(spark, d):
    return ranking.top_share(path_pairs(fx.kept(fx.chains(spark, d))), 1000).withColumn("score", F.round("score", 9))


@query("e16_predicted_groups", sql("""SELECT eid, side, node FROM n_truth WHERE side = 'src' UNION ALL SELECT eid, 'tgt', v FROM (SELECT eid, v, k, row_number() OVER (PARTITION BY eid ORDER BY s DESC, v) AS r FROM
(SELECT t.eid, n.node AS v, k, sum(coalesce(score, 0)) / count(*) AS s FROM n_truth t JOIN sz USING (eid), nn n LEFT JOIN pr ON pr.u = t.node AND pr.v = n.node WHERE t.side = 'src' GROUP BY t.eid, n.node, k)) WHERE r <= k""", PAIRS + ", sz AS (SELECT eid, count(*) AS k FROM n_truth WHERE side = 'tgt' GROUP BY eid)"))
def e16(spark, d):
    n = fx.table(spark, d, "customer").count()
    return ranking.predicted_groups(path_pairs(fx.kept(fx.chains(spark, d)), "v"), *fx.entities(spark, d), n, n)


#: Two blocks by hashes of u that overlap and cover all pairs but a few, which are in neither.
IN_BLOCKS = f""", pp AS (SELECT u, v, score, {U("'42'", "'block'", 'u::VARCHAR')} AS c FROM pr WHERE {U("'42'", "'apart'", 'u::VARCHAR', 'v::VARCHAR')} >= 0.02),
bl AS (SELECT u, v, score FROM pp WHERE c < 0.6 UNION ALL SELECT u, v, score + 1 FROM pp WHERE c >= 0.4)"""


@query("e17_reassembled_pairs", sql("SELECT u, v, max(score) AS score, (SELECT min(s) - 1 FROM (SELECT max(score) AS s FROM bl GROUP BY u, v)) AS missing FROM bl GROUP BY u, v", PAIRS + IN_BLOCKS))
def e17(spark, d):
    pairs = path_pairs(fx.kept(fx.chains(spark, d))).where(draw("apart", F.col("u"), F.col("v")) >= 0.02)
    pairs = checkpointed(pairs.withColumn("c", draw("block", F.col("u"))))
    two = pairs.where("c >= 0.4").withColumn("score", F.col("score") + 1)
    found, default = ranking.reassembled([pairs.where("c < 0.6").drop("c"), two.drop("c")])
    return found.crossJoin(F.broadcast(default))


CLUSTERS = f"""cm AS (SELECT DISTINCT (node % 12)::INT AS cluster, gid, node FROM (SELECT gid, src AS node FROM v_edges UNION SELECT gid, dst FROM v_edges UNION SELECT 2, src FROM v_edges UNION SELECT 2, dst FROM v_edges)),
tp AS (SELECT a.cluster, [a.node, b.node, c.node] AS nodes, {U("'42'", "'tuple'", 'a.node::VARCHAR', 'b.node::VARCHAR', 'c.node::VARCHAR')} AS score FROM cm a JOIN cm b ON a.gid = 0 AND b.gid = 1 AND a.cluster = b.cluster JOIN cm c ON c.gid = 2 AND c.cluster = a.cluster),
mt AS (SELECT node AS test, [node, CASE WHEN node % 4 = 0 THEN node + 1 ELSE node END, CASE WHEN node % 4 = 0 THEN node + 1 ELSE node END] AS w FROM cm WHERE gid = 0),
pl AS (SELECT g, test, w, cm.cluster FROM mt, (SELECT unnest([0, 1, 2]) AS g), cm WHERE cm.gid = g AND cm.node = w[g + 1]),
ins AS (SELECT g, test, w, cluster, bool_or((cluster, k, w[k + 1]) IN (SELECT (cluster, gid, node) FROM cm)) AS inside FROM pl, (SELECT unnest([0, 1, 2]) AS k) WHERE k <> g GROUP BY g, test, w, cluster),
rk AS (SELECT i.g, i.test, i.cluster, row_number() OVER (PARTITION BY i.g, i.test, i.cluster ORDER BY score DESC, nodes) AS r, (nodes[1] = w[1])::INT + (nodes[2] = w[2])::INT + (nodes[3] = w[3])::INT AS same FROM ins i JOIN tp ON tp.cluster = i.cluster AND tp.nodes[i.g + 1] = w[i.g + 1] WHERE inside),
bs AS (SELECT i.g, i.test, i.inside, min(r) FILTER (same = 3) AS high, min(r) FILTER (same > 1) AS pair FROM ins i LEFT JOIN rk USING (g, test, cluster) GROUP BY i.g, i.test, i.cluster, i.inside), nt AS (SELECT count(*) AS n FROM mt)"""


@query("e18_multiway_hits", sql("SELECT k, round(avg(high), 9) AS high, round(avg(pair), 9) AS pair FROM (SELECT g, k, (count(*) FILTER (high <= k))::DOUBLE / max(n) AS high, (count(*) FILTER (pair <= k))::DOUBLE / max(n) AS pair FROM bs, nt, (SELECT unnest([1, 10, 30, 50]) AS k) GROUP BY g, k) GROUP BY k", CLUSTERS))
def e18(spark, d):
    tuples, agreeing, members, tests = cluster_tables(spark, d)
    rows = ranking.multiway_ranks(tuples, members, tests, 3, agreeing)
    return ranking.multiway_hits(rows, tests.count()).select("k", F.round("high", 9).alias("high"), F.round("pair", 9).alias("pair"))


@query("e19_multiway_mrr", sql("SELECT round(avg(m), 9) AS value FROM (SELECT g, sum(CASE WHEN NOT inside THEN 1.0 / (SELECT max(c) FROM (SELECT count(*) AS c FROM cm GROUP BY gid)) ELSE coalesce(1.0 / high, 0) END) / max(n) AS m FROM bs, nt GROUP BY g)", CLUSTERS))
def e19(spark, d):
    tuples, agreeing, members, tests = cluster_tables(spark, d)
    sizes = members.groupBy("gid").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    rows = ranking.multiway_ranks(tuples, members, tests, 3, agreeing)
    return ranking.multiway_mrr(rows, tests.count(), sizes).select(F.round("value", 9).alias("value"))


def cluster_tables(spark, d):
    """Clusters of event users by id, all tuples over three graphs in them with drawn scores, those that agree with a test, and tests that partly lie elsewhere.

    The tuples are the cube of a cluster's users: they are made where a first user is, in
    tasks that no key of few clusters bounds, and nothing of them is shuffled.
    """
    edges = fx.event_walks(spark, d).edges
    ends = edges.select("gid", F.explode(F.array("src", "dst")).alias("node"))
    nodes = checkpointed(ends.union(ends.select(F.lit(2), "node")).distinct())
    members = nodes.select((F.col("node") % 12).cast("int").alias("cluster"), "gid", "node")
    each = [members.where(F.col("gid") == k).select("cluster", F.col("node").alias(f"n{k}")) for k in range(3)]
    others = [broadcast_up_to(t) for t in each]
    shifted = F.when(F.col("node") % 4 == 0, F.col("node") + 1).otherwise(F.col("node"))
    tests = nodes.where("gid = 0").select(F.col("node").alias("test"), F.array(F.col("node"), shifted, shifted).alias("nodes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def scored(met):
        return met.select("cluster", F.array("n0", "n1", "n2").alias("nodes"), draw("tuple", F.col("n0"), F.col("n1"), F.col("n2")).alias("score"))

    tuples = scored(each[0].repartition(parts, "n0").join(others[1], "cluster").join(others[2], "cluster"))
    wanted = tests.select(*[F.col("nodes")[k].alias(f"n{k}") for k in range(3)])
    near = []
    for free in range(3):
        pair = [k for k in range(3) if k != free]
        both = wanted.select(*[f"n{k}" for k in pair]).repartition(parts, f"n{pair[0]}")
        for k in pair:
            both = both.join(others[k], [f"n{k}"] if "cluster" not in both.columns else ["cluster", f"n{k}"])
        near.append(scored(both.join(others[free], "cluster")))
    return tuples, near[0].unionByName(near[1]).unionByName(near[2]), members, tests


# Groups

FOUND = """t AS (SELECT DISTINCT * FROM n_truth), p AS (SELECT DISTINCT * FROM n_pred),
cnt AS (SELECT r.rate, i.eid, s.side, (SELECT count(*) FROM t WHERE t.eid = i.eid AND t.side = s.side) AS tr, (SELECT count(*) FROM p WHERE p.rate = r.rate AND p.eid = i.eid AND p.side = s.side) AS fo,
(SELECT count(*) FROM p JOIN t USING (eid, side, node) WHERE p.rate = r.rate AND p.eid = i.eid AND p.side = s.side) AS hi, ((r.rate, i.eid) NOT IN (SELECT (rate, eid) FROM n_pred_ids))::INT AS mi FROM n_ids i, rates r, (SELECT unnest(['src', 'tgt']) AS side) s),
ov AS (SELECT r.rate, i.eid, (SELECT count(*) FROM t WHERE t.eid = i.eid) AS n, (SELECT count(*) FROM n_pred_ids q WHERE q.rate = r.rate) AS m FROM n_ids i, rates r),
me AS (SELECT rate, t.eid, p.eid AS c, count(*) AS a FROM t JOIN p USING (side, node) GROUP BY rate, t.eid, p.eid),
ms AS (SELECT rate, eid, sum(a * a) AS sq, count(*) AS eg FROM me GROUP BY rate, eid),
gs AS (SELECT rate, eid, n, CASE WHEN n <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (coalesce(sq, 0) - n::DOUBLE) / (n::DOUBLE * n - n))) END AS sgs,
CASE WHEN least(n, m) <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (least(n, m) - coalesce(eg, 0))::DOUBLE / (least(n, m) - 1))) END AS egs FROM ov LEFT JOIN ms USING (rate, eid)),
f1 AS (SELECT rate, eid, CASE WHEN fo = 0 THEN 0.0 ELSE hi::DOUBLE / fo END AS p, CASE WHEN tr = 0 THEN 0.0 ELSE hi::DOUBLE / tr END AS r, mi FROM cnt WHERE side = 'tgt'),
mi AS (SELECT rate, sum(hi)::BIGINT AS tp, sum(fo - hi)::BIGINT AS fp, sum(tr - hi)::BIGINT AS fn, count(*) AS num_entities, sum(mi)::BIGINT AS missing_pred_entities FROM cnt WHERE side = 'tgt' GROUP BY rate)"""
MICRO = "SELECT rate, round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END, 9) AS f1, round(tp::DOUBLE / (tp + fp), 9) AS precision, round(tp::DOUBLE / (tp + fn), 9) AS recall, tp, fp, fn, num_entities, missing_pred_entities FROM mi"


def sweep(spark, d):
    truth, ids = fx.entities(spark, d)
    modulus = fx.table(spark, d, "supplier").agg(F.count("*").alias("m"))
    return truth, ids, *fx.predictions(truth, ids, modulus)


def round_all(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("j1_network_keys", sql("SELECT DISTINCT side AS key FROM n_truth WHERE eid = (SELECT min(eid) FROM n_truth)"))
def j1(spark, d):
    return groups.network_keys(fx.entities(spark, d)[0])


@query("j2_concentration", sql("SELECT rate, round(sum(hi * hi)::DOUBLE / sum(tr * tr), 9) AS acs, sum(hi * hi)::BIGINT AS sg, sum(tr * tr)::BIGINT AS max_sg, sum(CASE WHEN side = 'tgt' THEN mi ELSE 0 END)::BIGINT AS missing FROM cnt GROUP BY rate", FOUND))
def j2(spark, d):
    return round_all(groups.concentration(groups.counts(*sweep(spark, d), ["rate"]), ["rate"]), "acs")


@query("j3_macro_set_f1", sql("SELECT rate, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS msf1, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall, sum(mi)::BIGINT AS missing FROM f1 GROUP BY rate", FOUND))
def j3(spark, d):
    return round_all(groups.macro_f1(groups.counts(*sweep(spark, d), ["rate"]), ["rate"]), "msf1", "precision", "recall")


@query("j4_micro_f1", sql(MICRO, FOUND))
def j4(spark, d):
    return round_all(groups.micro_f1(groups.counts(*sweep(spark, d), ["rate"]), ["rate"]), "f1", "precision", "recall")


@query("j5_sgs_by_group", sql("SELECT rate, eid, n, round(sgs, 9) AS sgs FROM gs", FOUND))
def j5(spark, d):
    return round_all(groups.sgs(groups.overlaps(*sweep(spark, d), ["rate"]), ["rate"]), "sgs")


@query("j6_egs_by_group", sql("SELECT rate, eid, n, round(egs, 9) AS egs FROM gs", FOUND))
def j6(spark, d):
    return round_all(groups.egs(groups.overlaps(*sweep(spark, d), ["rate"]), ["rate"]), "egs")


ALL = """SELECT rate, 'ACS' AS name, round(sum(hi * hi)::DOUBLE / sum(tr * tr), 9) AS value FROM cnt GROUP BY rate UNION ALL SELECT rate, 'MSF1', round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) FROM f1 GROUP BY rate
UNION ALL SELECT rate, 'MicroF1', round(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END, 9) FROM mi UNION ALL SELECT rate, 'M2M-SGS', round(avg(sgs), 9) FROM gs GROUP BY rate UNION ALL SELECT rate, 'M2M-EGS', round(avg(egs), 9) FROM gs GROUP BY rate
UNION ALL SELECT rate, 'M2M-SGS-weighted', round(sum(sgs * n) / sum(n), 9) FROM gs GROUP BY rate UNION ALL SELECT rate, 'M2M-EGS-weighted', round(sum(egs * n) / sum(n), 9) FROM gs GROUP BY rate"""


@query("j7_metric_bundle", sql(ALL.replace("SELECT rate, ", "SELECT ").replace("GROUP BY rate", "").replace("FROM mi", "FROM mi WHERE rate = 0.4").replace("FROM cnt ", "FROM cnt WHERE rate = 0.4 ").replace("FROM f1 ", "FROM f1 WHERE rate = 0.4 ").replace("FROM gs ", "FROM gs WHERE rate = 0.4 "), FOUND))
def j7(spark, d):
    truth, ids, pred, there = sweep(spark, d)
    names = ("acs", "MSF1", "micro_f1", "M2M SGS", "m2m-egs", "m2m_sgs_weighted", "M2M-EGS-weighted")
    return round_all(groups.scores(truth, ids, pred.where("rate = 0.4"), there.where("rate = 0.4"), names), "value")


@query("j8_metric_sweep", sql(ALL, FOUND))
def j8(spark, d):
    names = (*groups.DEFAULTS, "M2M-SGS-weighted", "M2M-EGS-weighted")
    return round_all(groups.scores(*sweep(spark, d), names, ["rate"]), "value")


@query("j8_metric_sweep_large", sql("SELECT rate, sum(hi)::BIGINT AS tp, sum(fo)::BIGINT AS found, sum(tr)::BIGINT AS true FROM (SELECT r.rate, i.eid, coalesce(tr, 0) AS tr, coalesce(fo, 0) AS fo, coalesce(hi, 0) AS hi FROM k_ids i CROSS JOIN rates r LEFT JOIN kt USING (eid) LEFT JOIN kf ON kf.rate = r.rate AND kf.eid = i.eid LEFT JOIN kh ON kh.rate = r.rate AND kh.eid = i.eid) GROUP BY rate",
"kt AS (SELECT eid, count(DISTINCT node) AS tr FROM k_truth WHERE side = 'tgt' GROUP BY eid), kf AS (SELECT rate, eid, count(DISTINCT node) AS fo FROM k_pred WHERE side = 'tgt' GROUP BY rate, eid), kh AS (SELECT rate, eid, count(DISTINCT node) AS hi FROM k_pred JOIN k_truth USING (eid, side, node) WHERE side = 'tgt' GROUP BY rate, eid)"))
def j8l(spark, d):
    truth, ids = fx.customer_entities(spark, d)
    modulus = fx.table(spark, d, "orders").agg(F.count("*").alias("m"))
    pred, there = fx.predictions(truth, ids, modulus)
    rows = groups.counts(truth, ids, pred, there, ["rate"]).where("side = 'tgt'")
    return rows.groupBy("rate").agg(F.sum("hit").alias("tp"), F.sum("found").alias("found"), F.sum("true").alias("true"))


# Files


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("a3_read_entities", sql("SELECT eid, side, node FROM n_truth"))
def a3(spark, d):
    folder = scratch(spark, "entities")
    entity_files.write(*fx.entities(spark, d), folder)
    return networks.read_entities(spark, folder)[0]


@query("a4_write_benchmark", sql("SELECT (SELECT count(*) FROM c_nodes) AS nodes, (SELECT count(*) FROM l_edges) AS edges, (SELECT count(*) FROM l_anchors) AS anchors"))
def a4(spark, d):
    folder = scratch(spark, "network")
    networks.write(fx.chains(spark, d), folder)
    net = networks.load(spark, folder)
    count = lambda df, c: df.agg(F.count("*").alias(c))
    return count(net.nodes, "nodes").crossJoin(count(net.edges, "edges")).crossJoin(count(net.anchors, "anchors"))


@query("a5_read_predictions", sql("SELECT rate, eid, side, node FROM n_pred"))
def a5(spark, d):
    folder = scratch(spark, "predictions")
    _, _, pred, there = sweep(spark, d)
    networks.write_predictions(pred, there, folder)
    return networks.read_predictions(spark, folder)[0].select("rate", "eid", "side", "node")


@query("a6_write_sweep", sql(MICRO.replace("SELECT rate,", "SELECT rate AS error_rate,"), FOUND))
def a6(spark, d):
    folder = scratch(spark, "sweep")
    rows = j4(spark, d).withColumnRenamed("rate", "error_rate")
    networks.write_sweep(rows, folder)
    return spark.read.option("header", True).schema(rows.schema).csv(folder)


RUNS = f"""rn AS (SELECT 'a' || (c_custkey % 3) AS algo, c_custkey % 2 = 0 AS use_attr, 'd' || (c_custkey % 4) AS dataset, 0.2 AS train_ratio, (c_custkey % 5)::INT AS seed, (c_custkey // 60)::INT AS epoch,
round({U("'42'", "'hits'", 'c_custkey::VARCHAR')}, 4) AS hits1, round({U("'42'", "'mrr'", 'c_custkey::VARCHAR')}, 4) AS mrr FROM customer)"""


def runs(spark, d):
    """Run logs with drawn metrics, written as CSV files with comment lines, a folder a run, and read again."""
    folder = scratch(spark, "runs")
    key = F.col("c_custkey")
    facts = {
        "algo": F.concat(F.lit("a"), key % 3),
        "attr": F.when(key % 2 == 0, "attr").otherwise("plain"),
        "dataset": F.concat(F.lit("d"), key % 4),
        "train_ratio": F.lit("0.2"),
        "seed": F.concat(F.lit("seed_"), key % 5),
    }
    hits, mrr = F.round(draw("hits", key), 4), F.round(draw("mrr", key), 4)
    values = [F.floor(key / 60), F.lit(0.5), F.lit(0.1), hits, hits, hits, hits, mrr, F.lit(1.0), F.lit(2.0)]
    customers = fx.table(spark, d, "customer")
    rows = customers.select(*[c.alias(n) for n, c in facts.items()], *[v.cast("string").alias(name) for v, (name, _, _) in zip(values, networks.RUN_COLUMNS)])
    first, *others = [name for name, _, _ in networks.RUN_COLUMNS]
    notes = rows.select(*facts).distinct().select(*facts, F.lit("# notes").alias(first), *[F.lit(None).cast("string").alias(name) for name in others])
    networks.write_runs(rows.unionByName(notes), list(facts), folder)
    return networks.read_runs(spark, folder)


@query("a7_read_runs", sql("SELECT algo, use_attr, dataset, train_ratio::DOUBLE AS train_ratio, seed, epoch, hits1, mrr FROM rn", RUNS))
def a7(spark, d):
    return runs(spark, d).select("algo", "use_attr", "dataset", "train_ratio", "seed", "epoch", "hits1", "mrr")


@query("a8_append_metrics", sql("SELECT algo, dataset, round(hits1 / 3, 4) AS hits1, count(*) * 2 AS n FROM rn GROUP BY ALL", RUNS))
def a8(spark, d):
    folder = scratch(spark, "metrics")
    rows = runs(spark, d).select("algo", "dataset", (F.col("hits1") / 3).alias("hits1"))
    networks.append_metrics(rows, folder)
    networks.append_metrics(rows, folder)
    return spark.read.parquet(folder).groupBy("algo", "dataset", "hits1").agg(F.count("*").alias("n"))


@query("d11_run_analytics", sql("SELECT algo, use_attr, dataset, count(*) AS runs, round(avg(best), 9) AS mean_best, round(stddev_samp(best), 9) AS std_best FROM (SELECT algo, use_attr, dataset, seed, max(mrr) AS best FROM rn GROUP BY ALL) GROUP BY algo, use_attr, dataset", RUNS))
def d11(spark, d):
    from kinmap.operators import runs as r

    return round_all(r.over_seeds(r.best_epochs(runs(spark, d)), "mrr"), "mean_best", "std_best")


@query("d12_robustness_curve", sql("SELECT algo, CASE WHEN use_attr THEN 'attribute' ELSE 'edge' END AS noise, seed / 10.0 AS level, count(*) AS trials, round(avg(hits1), 9) AS hits1 FROM rn GROUP BY ALL", RUNS))
def d12(spark, d):
    from kinmap.operators import runs as r

    trials = runs(spark, d).select("algo", F.when(F.col("use_attr"), "attribute").otherwise("edge").alias("noise"), (F.col("seed") / 10.0).alias("level"), "hits1")
    return round_all(r.robustness(trials, "hits1"), "hits1")
