"""Queries on noise, benchmarks and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmap.functions.draws import draw
from kinmap.operators import noise, sampling
from kinmap.operators.graph import dense_ids
from kinmap.plans.base import query
from kinmap.plans.metrics import PAIRS, path_pairs
from kinmap.sources import fixtures as fx
from kinmap.sources.fixtures import U, sql

T = lambda tag, *keys, seed="42": U(f"'{seed}'", f"'{tag}'", *[f"({k})::VARCHAR" for k in keys])
SIZE = "sz AS (SELECT count(*) AS n FROM customer)"


@query("f2_split_anchors", sql(f"SELECT aid, CASE WHEN row_number() OVER (ORDER BY {T('train', 'aid')}, aid) <= floor(count(*) OVER () * 0.2) THEN 'train' ELSE 'test' END AS split FROM l_anchors"))
def f2(spark, d):
    return noise.split_anchors(fx.chains(spark, d).anchors, 0.2).select("aid", "split")


TOGGLE = f"""{SIZE}, ne AS (SELECT count(*) AS m FROM l_edges WHERE gid = 0), dr AS (SELECT i, floor({T('edge_u', 'i', seed='42.0')} * n)::BIGINT AS u, floor({T('edge_v', 'i', seed='42.0')} * (n - 1))::BIGINT AS v0 FROM sz, ne, range(0, (SELECT floor(m * 0.3)::BIGINT FROM ne)) r(i)),
pp AS (SELECT least(u, v) AS a, greatest(u, v) AS b FROM (SELECT u, CASE WHEN v0 >= u THEN v0 + 1 ELSE v0 END AS v FROM dr)), tg AS (SELECT a, b FROM pp GROUP BY a, b HAVING count(*) % 2 = 1),
th AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l_edges WHERE gid = 0), af AS ((SELECT * FROM th EXCEPT SELECT * FROM tg) UNION ALL (SELECT * FROM tg EXCEPT SELECT * FROM th))"""


@query("f3_edge_noise", sql("SELECT 0 AS gid, a AS src, b AS dst FROM af UNION ALL SELECT 0, b, a FROM af UNION ALL SELECT gid, src, dst FROM l_edges WHERE gid = 1", TOGGLE))
def f3(spark, d):
    return noise.edge_noise(fx.chains(spark, d), 0.3, [0])


FLIP = f"""fl AS (SELECT gid, node, p FROM (SELECT gid, node, p, row_number() OVER (PARTITION BY gid, node ORDER BY {T('flip', 'gid', 'node', 'p')}, p) AS r FROM c_nodes, (SELECT unnest([0, 1, 2, 3, 4]) AS p)) WHERE r <= 2),
fx AS (SELECT n.gid, n.node, p.p, CASE WHEN fl.p IS NULL THEN n.x[p.p + 1] ELSE 1 - n.x[p.p + 1] END AS v FROM c_nodes n CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS p) p LEFT JOIN fl ON fl.gid = n.gid AND fl.node = n.node AND fl.p = p.p)"""


def long_attributes(nodes):
    return nodes.select("gid", "node", F.posexplode("x").alias("p", "v"))


@query("f4_flip_attributes", sql("SELECT gid, node, p, v FROM fx", FLIP))
def f4(spark, d):
    return long_attributes(noise.flip_attributes(fx.chains(spark, d).nodes, 0.4))


GAUSS = f"""mo AS (SELECT gid, pos, stddev_samp(vec[pos + 1]) + 1e-12 AS s FROM e_vec, (SELECT unnest(range(0, 64)) AS pos) GROUP BY gid, pos)"""


@query("f5_gaussian_attributes", sql(f"SELECT gid, node, pos::INT AS p, round(vec[pos + 1] + sqrt(-2.0 * ln(greatest({T('gauss1', 'gid', 'node', 'pos')}, 1.0 / 4503599627370496.0))) * cos(2.0 * 3.141592653589793 * {T('gauss2', 'gid', 'node', 'pos')}) * 0.5 * s + 1e-9, 6) AS v FROM e_vec JOIN mo USING (gid)", GAUSS))
def f5(spark, d):
    nodes = fx.vectors(spark, d).select("gid", "node", F.col("vec").alias("x"))
    return long_attributes(noise.gaussian_attributes(nodes, 0.5)).withColumn("v", F.round(F.col("v") + 1e-9, 6))


@query("f6_attribute_noise", sql("SELECT gid, node, p, v FROM fx WHERE gid = 1 UNION ALL SELECT gid, node, p, x[p + 1] FROM c_nodes, (SELECT unnest([0, 1, 2, 3, 4]) AS p) WHERE gid = 0", FLIP))
def f6(spark, d):
    return long_attributes(noise.attribute_noise(fx.chains(spark, d).nodes, "flip", 0.4, [1]))


SUP = f"""tr AS (SELECT aid, row_number() OVER (ORDER BY {T('sup', 'aid', 'aid')}, aid) - 1 AS r, count(*) OVER () AS m FROM l_anchors WHERE split = 'train'),
fr AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS fid, count(*) OVER () AS n FROM c_nodes WHERE gid = 1 AND node NOT IN (SELECT aid FROM l_anchors WHERE split = 'test')),
mv AS (SELECT aid, floor({T('supv', 'aid', 'aid')} * n)::BIGINT AS fid, n FROM tr, (SELECT max(n) AS n FROM fr) WHERE r < floor(m * 0.25)), hit AS (SELECT aid, CASE WHEN node = aid THEN (mv.fid + 1) % mv.n ELSE mv.fid END AS fid FROM mv JOIN fr USING (fid))"""


@query("f7_supervision_noise", sql("SELECT aid AS u, node AS v, true AS moved FROM hit JOIN fr USING (fid) UNION ALL SELECT aid, aid, false FROM tr WHERE r >= floor(m * 0.25)", SUP))
def f7(spark, d):
    net = fx.chains(spark, d)
    anchors = net.anchors.select(F.col("nodes")[0].alias("u"), F.col("nodes")[1].alias("v"), "split")
    return noise.perturb_supervision(anchors, net.nodes.where("gid = 1"), 0.25)


@query("f8_one_to_one", sql("SELECT id, u, v FROM ok", """pz AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS id, src // 2 AS u, dst // 2 AS v FROM l_edges WHERE gid = 0),
pl AS (SELECT list({'id': id, 'u': u, 'v': v} ORDER BY id) AS l FROM pz),
red AS (SELECT list_reduce(list_prepend({'us': []::BIGINT[], 'vs': []::BIGINT[], 'ids': []::BIGINT[]}, list_transform(l, lambda x: {'us': [x.u], 'vs': [x.v], 'ids': [x.id]})), lambda a, x: CASE WHEN list_has(a.us, x.us[1]) OR list_has(a.vs, x.vs[1]) THEN a ELSE {'us': a.us || x.us, 'vs': a.vs || x.vs, 'ids': a.ids || x.ids} END) AS r FROM pl),
ok AS (SELECT id, u, v FROM pz WHERE id IN (SELECT unnest(r.ids) FROM red))"""))
def f8(spark, d):
    edges = dense_ids(fx.chains(spark, d).graph(0).select("src", "dst"), ["src", "dst"], "id")
    return noise.one_to_one(edges.select("id", F.floor(F.col("src") / 2).alias("u"), F.floor(F.col("dst") / 2).alias("v")))


KINDS = f"""qt AS (SELECT count(*) AS n FROM k_ids), kd AS (SELECT eid, CASE WHEN r < round_even(0.4 * n, 0) + n - (round_even(0.4 * n, 0) + 3 * round_even(0.2 * n, 0)) THEN '1-1' WHEN r < n - 2 * round_even(0.2 * n, 0) THEN '1-many' WHEN r < n - round_even(0.2 * n, 0) THEN 'many-1' ELSE 'many-many' END AS kind
FROM (SELECT eid, row_number() OVER (ORDER BY {T('kind', 'eid')}, eid) - 1 AS r FROM k_ids), qt)"""


@query("f9_typed_entities", sql("SELECT eid, kind FROM kd", KINDS))
def f9(spark, d):
    return noise.typed_entities(fx.customer_entities(spark, d)[1], noise.RATIOS, 3).select("eid", "kind")


@query("f10_split_factors", sql(f"SELECT eid, CASE WHEN kind IN ('many-1', 'many-many') THEN 2 + floor({T('k_src', 'eid')} * 2)::BIGINT ELSE 1 END AS k_src, CASE WHEN kind IN ('1-many', 'many-many') THEN 2 + floor({T('k_tgt', 'eid')} * 2)::BIGINT ELSE 1 END AS k_tgt FROM kd", KINDS))
def f10(spark, d):
    return noise.typed_entities(fx.customer_entities(spark, d)[1], noise.RATIOS, 3).select("eid", "k_src", "k_tgt")


def split_ctes(gid: int, chosen: str, seed: str = "42", to: str = "") -> str:
    """CTEs mb (members) and al (edges, one way) of a graph's split nodes, from a select of (node, k); names end with `to`."""
    t = lambda tag, *keys: T(tag, *keys, seed=seed)
    return f"""ch{to} AS ({chosen}), nb{to} AS (SELECT node, k, (SELECT n FROM sz) + sum(k - 1) OVER (ORDER BY node) - (k - 1) AS base FROM ch{to}),
mb{to} AS (SELECT node, k, i, CASE WHEN i = 0 THEN node ELSE base + i - 1 END::BIGINT AS member FROM nb{to}, (SELECT unnest([0, 1, 2])::BIGINT AS i) WHERE i < k),
ex{to} AS (SELECT c.node, c.k, e.dst AS w FROM ch{to} c JOIN l_edges e ON e.gid = {gid} AND e.src = c.node), ei{to} AS (SELECT node, k, w, i, {t('ext', 'node', 'w', 'i')} < 1.0 / k AS hit FROM ex{to}, (SELECT unnest([0, 1, 2])::BIGINT AS i) WHERE i < k),
eh{to} AS (SELECT node, w, i FROM ei{to} WHERE hit OR k = 1 UNION ALL SELECT node, w, floor({t('force', 'node', 'w')} * k)::BIGINT FROM ei{to} GROUP BY node, w, k HAVING NOT bool_or(hit OR k = 1)),
oe{to} AS (SELECT member AS src, w AS dst FROM eh{to} JOIN mb{to} USING (node, i)), ip{to} AS (SELECT node, a.i AS a, b.i AS b, a.member AS ma, b.member AS mbb, {t('int', 'node', 'a.i', 'b.i')} < 0.5 AS hit FROM mb{to} a JOIN mb{to} b USING (node) WHERE a.i < b.i),
ie{to} AS (SELECT ma AS src, mbb AS dst FROM (SELECT *, bool_or(hit) OVER (PARTITION BY node) AS got FROM ip{to}) WHERE hit OR (NOT got AND b = a + 1)),
re{to} AS (SELECT src, dst FROM l_edges WHERE gid = {gid} AND src NOT IN (SELECT node FROM ch{to} WHERE k > 1) AND dst NOT IN (SELECT node FROM ch{to} WHERE k > 1)), al{to} AS (SELECT * FROM re{to} UNION ALL SELECT * FROM oe{to} UNION ALL SELECT * FROM ie{to})"""


SPLIT = SIZE + ", " + split_ctes(0, "SELECT aid AS node, (aid % 3) + 1 AS k FROM l_anchors WHERE split = 'train'")


def split_side(spark, d):
    net = fx.chains(spark, d)
    chosen = net.pairs("train").select(F.col("u").alias("node"), ((F.col("u") % 3) + 1).alias("k"))
    return noise.split_nodes(net.graph(0), fx.table(spark, d, "customer").count(), chosen, 0.5)


@query("f11_split_members", sql("SELECT node, i, member FROM mb", SPLIT))
def f11m(spark, d):
    return split_side(spark, d)[0]


@query("f11_split_edges", sql("SELECT src, dst FROM al UNION SELECT dst, src FROM al", SPLIT))
def f11(spark, d):
    return split_side(spark, d)[1]


OVER = f"""dx AS (SELECT eid, row_number() OVER (ORDER BY eid) - 1 AS eix, count(*) OVER () AS n FROM n_ids),
po AS (SELECT eid, side, node, row_number() OVER (PARTITION BY side ORDER BY {T('overlap', 'eid', 'node')}, eid, node) AS r FROM n_truth), tt AS (SELECT side, round_even(0.1 * count(DISTINCT node), 0) AS t FROM n_truth GROUP BY side),
ot AS (SELECT side, node, eix, floor({T('share', 'eid', 'node')} * (n - 1))::BIGINT AS o FROM po JOIN tt USING (side) JOIN dx USING (eid) WHERE r <= t), mo AS (SELECT side, node, CASE WHEN o >= eix THEN o + 1 ELSE o END AS eix FROM ot)"""


@query("f12_overlap", sql("SELECT DISTINCT dx.eid, mo.side, mo.node FROM mo JOIN dx ON dx.eix = mo.eix WHERE (dx.eid, mo.side, mo.node) NOT IN (SELECT (eid, side, node) FROM n_truth)", OVER))
def f12(spark, d):
    truth, ids = fx.entities(spark, d)
    totals = {r.side: r.n for r in truth.groupBy("side").agg(F.count_distinct("node").alias("n")).collect()}
    return noise.overlapping(truth, ids, 0.1, totals)


def drawn_factor(kinds: str, side: str) -> str:
    return f"CASE WHEN kind IN ({kinds}) THEN 2 + floor({T('k_' + side, 'eid')} * 2)::BIGINT ELSE 1 END AS k_{side}"


#: A test anchor is the same customer in both graphs, so the greedy pass keeps all.
MADE = f"""{SIZE}, mi AS (SELECT 'e' || aid AS eid, aid FROM l_anchors WHERE split = 'test'), mq AS (SELECT count(*) AS n FROM mi),
mk AS (SELECT eid, aid, CASE WHEN r < round_even(0.4 * n, 0) + n - (round_even(0.4 * n, 0) + 3 * round_even(0.2 * n, 0)) THEN '1-1' WHEN r < n - 2 * round_even(0.2 * n, 0) THEN '1-many' WHEN r < n - round_even(0.2 * n, 0) THEN 'many-1' ELSE 'many-many' END AS kind
FROM (SELECT eid, aid, row_number() OVER (ORDER BY {T('kind', 'eid')}, eid) - 1 AS r FROM mi), mq), mf AS (SELECT *, {drawn_factor("'many-1', 'many-many'", 'src')}, {drawn_factor("'1-many', 'many-many'", 'tgt')} FROM mk),
{split_ctes(0, 'SELECT aid AS node, k_src AS k FROM mf', '42.0', '_s')}, {split_ctes(1, 'SELECT aid AS node, k_tgt AS k FROM mf', '42.1', '_t')},
me AS (SELECT eid, 'src' AS side, member AS node FROM mb_s JOIN mf ON aid = node UNION ALL SELECT eid, 'tgt', member FROM mb_t JOIN mf ON aid = node),
mx AS (SELECT eid, row_number() OVER (ORDER BY eid) - 1 AS eix, count(*) OVER () AS n FROM mi), mp AS (SELECT eid, side, node, row_number() OVER (PARTITION BY side ORDER BY {T('overlap', 'eid', 'node')}, eid, node) AS r FROM me),
mt AS (SELECT side, round_even(0.05 * count(DISTINCT node), 0) AS t FROM me GROUP BY side), mo AS (SELECT side, node, eix, floor({T('share', 'eid', 'node')} * (n - 1))::BIGINT AS o FROM mp JOIN mt USING (side) JOIN mx USING (eid) WHERE r <= t),
ma AS (SELECT DISTINCT mx.eid, side, node FROM mo JOIN mx ON mx.eix = CASE WHEN o >= mo.eix THEN o + 1 ELSE o END WHERE (mx.eid, side, node) NOT IN (SELECT (eid, side, node) FROM me))"""


@query("f13_many_to_many_benchmark", sql("""SELECT 'kind ' || kind AS what, eid, k_src AS a, k_tgt AS b FROM mf UNION ALL SELECT side, eid, node, NULL FROM (SELECT * FROM me UNION ALL SELECT * FROM ma) UNION ALL SELECT 'added ' || side, eid, node, NULL FROM ma
UNION ALL SELECT 'edges0', NULL, src, dst FROM (SELECT src, dst FROM al_s UNION SELECT dst, src FROM al_s) UNION ALL SELECT 'edges1', NULL, src, dst FROM (SELECT src, dst FROM al_t UNION SELECT dst, src FROM al_t) UNION ALL SELECT 'train', NULL, aid, aid FROM l_anchors WHERE split = 'train'""", MADE))
def f13(spark, d):
    """All rows of the benchmark's tables, one below the other."""
    made = noise.many_to_many(fx.chains(spark, d))
    none = F.lit(None).cast("string")
    row = lambda t, what, eid, a, b: t.select(what.alias("what"), eid.alias("eid"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    parts = [
        row(made["kinds"], F.concat(F.lit("kind "), "kind"), F.col("eid"), F.col("k_src"), F.col("k_tgt")),
        row(made["entities"], F.col("side"), F.col("eid"), F.col("node"), none),
        row(made["added"], F.concat(F.lit("added "), "side"), F.col("eid"), F.col("node"), none),
        *[row(made[k], F.lit(k), none, F.col("src"), F.col("dst")) for k in ("edges0", "edges1")],
        row(made["train"], F.lit("train"), none, F.col("u"), F.col("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


BAL = f"""sa AS (SELECT aid, row_number() OVER (ORDER BY aid) - 1 AS id, count(*) OVER () AS n FROM l_anchors WHERE split = 'train'), sb AS (SELECT count(*) AS m FROM l_anchors WHERE split = 'test')"""


@query("f15_balance", sql(f"SELECT aid, count(*) AS n FROM (SELECT aid FROM sa UNION ALL SELECT aid FROM (SELECT floor({T('balance', 'i')} * (SELECT max(n) FROM sa))::BIGINT AS id FROM range(0, (SELECT m FROM sb) - (SELECT max(n) FROM sa)) r(i)) JOIN sa USING (id)) GROUP BY aid", BAL))
def f15(spark, d):
    anchors = fx.chains(spark, d).anchors.select("aid", "split")
    train, test = (anchors.where(F.col("split") == s).select("aid") for s in ("train", "test"))
    return sampling.balance(train, test, ["aid"])[0].groupBy("aid").agg(F.count("*").alias("n"))


CONTEXTS = f"""ee AS (SELECT DISTINCT src, dst FROM v_edges WHERE gid = 0), nr AS (SELECT src AS node, dst AS context, count(*) OVER (PARTITION BY src) AS n FROM ee WHERE src IN (SELECT aid FROM v_anchors WHERE split = 'train')),
dg AS (SELECT src AS context, count(*) AS d FROM ee GROUP BY src), hp AS (SELECT node, context, d::DOUBLE / sum(d) OVER (PARTITION BY node) AS p FROM nr JOIN dg USING (context) WHERE n > 100),
hc AS (SELECT node, context, p, sum(p) OVER (PARTITION BY node ORDER BY context) AS high FROM hp), hd AS (SELECT node, {T('hub', 'node', 'i')} AS u FROM (SELECT DISTINCT node FROM nr WHERE n > 100), (SELECT unnest(range(1, 101)) AS i))"""


@query("f16_anchor_contexts", sql("SELECT node, context FROM nr WHERE n <= 100 UNION ALL SELECT node, context FROM hd JOIN hc USING (node) WHERE high - p <= u AND u < high", CONTEXTS))
def f16(spark, d):
    net = fx.event_walks(spark, d)
    anchors = net.pairs("train").select(F.col("u").alias("node"))
    return sampling.anchor_contexts(net.nodes, net.graph(0).select("gid", "src", "dst", "w").distinct(), anchors)


@query("f17_uniform_negatives", sql(f"SELECT u, v, direction, i, CASE WHEN p >= v THEN p + 1 ELSE p END AS negative FROM (SELECT aid AS u, aid AS v, 'ltr' AS direction, i, floor({T('neg_ltr', 'aid', 'aid', 'i')} * (n - 1))::BIGINT AS p FROM tr, sz, k UNION ALL SELECT aid, aid, 'rtl', i, floor({T('neg_rtl', 'aid', 'aid', 'i')} * (n - 1))::BIGINT FROM tr, sz, k)", f"{SIZE}, tr AS (SELECT aid FROM l_anchors WHERE split = 'train'), k AS (SELECT unnest([1, 2, 3, 4, 5])::INT AS i)"))
def f17(spark, d):
    n = fx.table(spark, d, "customer").count()
    return sampling.uniform_negatives(fx.chains(spark, d).pairs("train"), n, n, 5)


FLOYD = SIZE + ", d0 AS (SELECT aid AS u, aid AS v, n - 6 AS s, []::BIGINT[] AS taken FROM l_anchors, sz WHERE split = 'train')" + "".join(
    f", d{j + 1} AS (SELECT u, v, s, list_append(taken, CASE WHEN list_has(taken, p) THEN s + {j} ELSE p END) AS taken FROM (SELECT *, floor({T('dneg', 'u', 'v', str(j))} * (s + 1 + {j}))::BIGINT AS p FROM d{j}))" for j in range(5)
)


@query("f18_distinct_negatives", sql("SELECT u, v, CASE WHEN p >= v THEN p + 1 ELSE p END AS negative FROM (SELECT u, v, unnest(taken) AS p FROM d5)", FLOYD))
def f18(spark, d):
    return sampling.distinct_negatives(fx.chains(spark, d).pairs("train"), fx.table(spark, d, "customer").count(), 5)


FREE = f"""nv AS (SELECT count(*) AS n FROM v_nodes WHERE gid = 0), fd AS (SELECT aid AS node, i, r, floor({U("'42'", "'ctx' || r", "aid::VARCHAR", "i::VARCHAR")} * n)::BIGINT AS negative FROM v_anchors, nv, (SELECT unnest([1, 2, 3, 4, 5]) AS i), (SELECT unnest(range(0, 20)) AS r) WHERE split = 'train')"""


@query("f19_non_neighbours", sql("SELECT node, i, arg_min(negative, r) AS negative FROM fd WHERE negative <> node AND (node, negative) NOT IN (SELECT (src, dst) FROM v_edges WHERE gid = 0) GROUP BY node, i", FREE))
def f19(spark, d):
    net = fx.event_walks(spark, d)
    n = net.nodes.where("gid = 0").count()
    return sampling.non_neighbours(net.graph(0), net.pairs("train").select(F.col("u").alias("node")), n, 5)


SHARES = """dd AS (SELECT gid, src AS node, count(*) ** 0.75 AS w FROM l_edges GROUP BY gid, src), sh AS (SELECT gid, node, w / sum(w) OVER (PARTITION BY gid) AS p FROM dd), cu AS (SELECT gid, node, p, sum(p) OVER (PARTITION BY gid ORDER BY node) AS high FROM sh)"""


@query("f20_labelled_edges", sql(f"SELECT gid, src, dst, 1 AS label FROM l_edges UNION ALL SELECT e.gid, src, node, -1 FROM (SELECT gid, src, {T('cross', 'gid', 'src', 'dst', 'i')} AS u FROM l_edges, (SELECT unnest([1, 2, 3]) AS i)) e JOIN cu ON cu.gid = e.gid AND high - p <= u AND u < high", SHARES))
def f20(spark, d):
    net = fx.chains(spark, d)
    return sampling.labelled_edges(net.nodes, net.edges, 3)


@query("f21_similarity_negatives", sql(f"SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY -ln(greatest({T('sim', 'u', 'v')}, 1.1102230246251565e-16)) / greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-score)))), v) AS r FROM pr WHERE u <> v) WHERE r <= 3", PAIRS))
def f21(spark, d):
    return sampling.similarity_negatives(path_pairs(fx.kept(fx.chains(spark, d))), 3)


WALKS = f"""ad AS (SELECT src, list_sort(list(DISTINCT dst)) AS o FROM l_edges WHERE gid = 0 GROUP BY src), s0 AS (SELECT aid AS start, w AS walk_id, [aid] AS path FROM l_anchors, (SELECT unnest([0, 1])::INT AS w) WHERE split = 'train'),
s1 AS (SELECT start, walk_id, list_append(path, o[floor({T('walk', 'start', 'walk_id', '1')} * len(o))::INT + 1]) AS path FROM s0 JOIN ad ON src = path[-1]), s2 AS (SELECT start, walk_id, list_append(path, o[floor({T('walk', 'start', 'walk_id', '2')} * len(o))::INT + 1]) AS path FROM s1 JOIN ad ON src = path[-1])"""


def plain_walks(spark, d, p=1.0, q=1.0, length=3):
    net = fx.kept(fx.chains(spark, d))
    return sampling.walks(net.graph(0), net.pairs("train").select(F.col("u").alias("node")), p, q, 2, length)


@query("f22_walks", sql("SELECT start, walk_id, array_to_string(path, ',') AS path FROM s2", WALKS))
def f22(spark, d):
    return plain_walks(spark, d).select("start", "walk_id", F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("path"))


BIASED = WALKS.partition(", s2 AS")[0] + "".join(
    f""", s{k} AS (SELECT start, walk_id, list_append(path, o[1 + len(list_filter(range(1, len(o) + 1), lambda i: list_sum(w[1:i]) <= u * list_sum(w)))]) AS path FROM (SELECT s.*, a.o, {T('walk', 's.start', 's.walk_id', str(k))} AS u,
list_transform(a.o, lambda x: CASE WHEN x = s.path[-2] THEN 2.0::DOUBLE WHEN list_has(b.o, x) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS w FROM s{k - 1} s JOIN ad a ON a.src = s.path[-1] JOIN ad b ON b.src = s.path[-2]))"""
    for k in range(2, 6)
)


@query("f22_biased_walks", sql("SELECT start, walk_id, array_to_string(path, ',') AS path FROM s5", BIASED))
def f22b(spark, d):
    return plain_walks(spark, d, 0.5, 2.0, 6).select("start", "walk_id", F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("path"))


@query("f23_window_pairs", sql("SELECT DISTINCT path[i] AS centre, path[j] AS context FROM s2, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3]) AS j) WHERE path[i] IN (SELECT aid FROM l_anchors WHERE split = 'train')", WALKS))
def f23(spark, d):
    return sampling.window_pairs(plain_walks(spark, d), fx.chains(spark, d).pairs("train").select(F.col("u").alias("node")))


DRAWN = f"""g0 AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS eid, count(*) OVER () AS n FROM l_edges WHERE gid = 0), tr AS (SELECT aid FROM l_anchors WHERE split = 'train'),
og AS (SELECT src, list(dst ORDER BY dst) AS o FROM g0 WHERE src IN (SELECT aid FROM tr) GROUP BY src), ig AS (SELECT dst, list(src ORDER BY src) AS p FROM g0 WHERE dst IN (SELECT aid FROM tr) GROUP BY dst),
dw AS (SELECT id, floor({T('edge', 'id')} * (SELECT max(n) FROM g0))::BIGINT AS eid FROM range(0, (SELECT max(n) FROM g0)) r(id)), dj AS (SELECT id, src, dst, o, p FROM dw JOIN g0 USING (eid) LEFT JOIN og USING (src) LEFT JOIN ig USING (dst))"""


@query("f24_anchored_edges", sql(f"SELECT coalesce(o[1 + floor({T('succ', 'id')} * len(o))::INT], src) AS src, coalesce(p[1 + floor({T('pred', 'id')} * len(p))::INT], dst) AS dst, 'replaced' AS kind FROM dj UNION ALL SELECT src, dst, 'original' FROM dj WHERE o IS NOT NULL OR p IS NOT NULL", DRAWN))
def f24(spark, d):
    net = fx.chains(spark, d)
    return sampling.anchored_edges(net.graph(0), net.pairs("train").select(F.col("u").alias("node")), net.graph(0).count())
