"""Many-to-many group metrics of predicted entities against true ones.

Entities are (eid, side, node) with their ids (eid); predictions may have more
key columns (a file, a rate), by which every metric is then given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmap.session import checkpointed

METRICS = {"acs": "ACS", "msf1": "MSF1", "microf1": "MicroF1", "m2msgs": "M2M-SGS", "sgs": "M2M-SGS", "m2megs": "M2M-EGS", "egs": "M2M-EGS", "m2msgsweighted": "M2M-SGS-weighted", "m2megsweighted": "M2M-EGS-weighted"}
DEFAULTS = ("ACS", "MSF1", "MicroF1", "M2M-SGS", "M2M-EGS")


def network_keys(truth: DataFrame) -> DataFrame:
    """(key): the sides of the first true entity, in order."""
    first = truth.agg(F.min("eid").alias("eid"))
    return truth.join(F.broadcast(first), "eid", "left_semi").select(F.col("side").alias("key")).distinct()


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1_of(hit: Column, found: Column, true: Column) -> Column:
    p, r = safe(hit, found), safe(hit, true)
    return safe(2 * p * r, p + r)


def counts(truth: DataFrame, ids: DataFrame, pred: DataFrame, pred_ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eid, missing, and by side: true, found, hit) of every true entity, sets without repeats."""
    true = truth.select("eid", "side", "node").distinct()
    found = pred.select(*keys, "eid", "side", "node").distinct()
    every = pred_ids.select(*keys).distinct()
    n_true = true.groupBy("eid", "side").agg(F.count("*").alias("true"))
    n_found = found.groupBy(*keys, "eid", "side").agg(F.count("*").alias("found"))
    n_hit = found.join(true, ["eid", "side", "node"], "left_semi").groupBy(*keys, "eid", "side").agg(F.count("*").alias("hit"))
    sides = F.explode(F.array(F.lit("src"), F.lit("tgt"))).alias("side")
    base = ids.select("eid", sides)
    base = base.crossJoin(F.broadcast(every)) if keys else base
    there = pred_ids.select(*keys, "eid").distinct().withColumn("there", F.lit(1))
    rows = base.join(n_true, ["eid", "side"], "left").join(n_found, [*keys, "eid", "side"], "left").join(n_hit, [*keys, "eid", "side"], "left")
    rows = rows.join(there, [*keys, "eid"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*keys, "eid", "side", zero("true"), zero("found"), zero("hit"), F.coalesce(1 - F.col("there"), F.lit(1)).alias("missing"))


def grouped(rows: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def concentration(counted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acs, sg, max_sg, missing): squared hits over squared sizes, summed over entities and sides."""
    once = F.when(F.col("side") == "tgt", F.col("missing")).otherwise(0)
    sums = grouped(counted, keys, F.sum(F.col("hit") * F.col("hit")).alias("sg"), F.sum(F.col("true") * F.col("true")).alias("max_sg"), F.sum(once).alias("missing"))
    return sums.select(*keys, safe(F.col("sg").cast("double"), F.col("max_sg")).alias("acs"), "sg", "max_sg", "missing")


def macro_f1(counted: DataFrame, keys: list[str], side: str = "tgt") -> DataFrame:
    """(keys, msf1, precision, recall, missing): means over the true entities of one side."""
    hit, found, true = (F.col(c).cast("double") for c in ("hit", "found", "true"))
    rows = counted.where(F.col("side") == side)
    return grouped(rows, keys, F.avg(f1_of(hit, found, true)).alias("msf1"), F.avg(safe(hit, found)).alias("precision"), F.avg(safe(hit, true)).alias("recall"), F.sum("missing").alias("missing"))


def micro_f1(counted: DataFrame, keys: list[str], side: str = "tgt") -> DataFrame:
    """(keys, f1, precision, recall, tp, fp, fn, num_entities, missing_pred_entities): pooled over the true entities."""
    rows = counted.where(F.col("side") == side)
    sums = grouped(rows, keys, F.sum("hit").alias("tp"), F.sum(F.col("found") - F.col("hit")).alias("fp"), F.sum(F.col("true") - F.col("hit")).alias("fn"), F.count("*").alias("num_entities"), F.sum("missing").alias("missing_pred_entities"))
    p, r = safe(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), safe(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return sums.select(*keys, safe(2 * p * r, p + r).alias("f1"), p.alias("precision"), r.alias("recall"), "tp", "fp", "fn", "num_entities", "missing_pred_entities")


def overlaps(truth: DataFrame, ids: DataFrame, pred: DataFrame, pred_ids: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eid, n, squares, touched, clusters): how the predicted clusters cut each true group.

    n is the size of the group over both sides, squares the sum of squared overlaps
    with all predicted clusters, touched their number, clusters all of them.
    """
    true = truth.select("eid", "side", "node").distinct()
    found = pred.select(*keys, F.col("eid").alias("cluster"), "side", "node").distinct()
    sizes = ids.join(true.groupBy("eid").agg(F.count("*").alias("n")), "eid", "left").select("eid", F.coalesce("n", F.lit(0)).alias("n"))
    met = true.join(found, ["side", "node"]).groupBy(*keys, "eid", "cluster").agg(F.count("*").alias("a"))
    met = met.groupBy(*keys, "eid").agg(F.sum(F.col("a") * F.col("a")).alias("squares"), F.count("*").alias("touched"))
    clusters = grouped(pred_ids.select(*keys, "eid").distinct(), keys, F.count("*").alias("clusters"))
    rows = sizes.crossJoin(F.broadcast(clusters)).join(met, [*keys, "eid"], "left")
    return rows.select(*keys, "eid", "n", "clusters", F.coalesce("squares", F.lit(0)).alias("squares"), F.coalesce("touched", F.lit(0)).alias("touched"))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sgs(overlap: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eid, n, sgs): how far a group's nodes stay together."""
    n = F.col("n").cast("double")
    value = F.when(F.col("n") <= 1, 1.0).otherwise(clamp((F.col("squares") - n) / (n * n - n)))
    return overlap.select(*keys, "eid", "n", value.alias("sgs"))


def egs(overlap: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eid, n, egs): in how few clusters a group's nodes lie; 1 for a group that no cluster touches."""
    most = F.least("n", "clusters").cast("double")
    value = F.when(most <= 1, 1.0).otherwise(clamp((most - F.col("touched")) / (most - 1)))
    return overlap.select(*keys, "eid", "n", value.alias("egs"))


def macro_and_weighted(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return grouped(rows, keys, F.avg(value).alias("macro"), safe(F.sum(F.col(value) * F.col("n")), F.sum("n").cast("double")).alias("weighted"))


def scores(truth: DataFrame, ids: DataFrame, pred: DataFrame, pred_ids: DataFrame, metrics: tuple[str, ...] = DEFAULTS, keys: list[str] | None = None) -> DataFrame:
    """(keys, name, value) of the named metrics; names may differ in case, blanks, - and _."""
    keys = keys or []
    plain = {m: "".join(c for c in m.lower() if c.isalnum()) for m in metrics}
    unknown = [m for m, p in plain.items() if p not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    wanted = {METRICS[p] for p in plain.values()}
    counted = checkpointed(counts(truth, ids, pred, pred_ids, keys))
    overlap = checkpointed(overlaps(truth, ids, pred, pred_ids, keys))
    s, e = (macro_and_weighted(f(overlap, keys), f.__name__, keys) for f in (sgs, egs))
    tables = {"ACS": (concentration(counted, keys), "acs"), "MSF1": (macro_f1(counted, keys), "msf1"), "MicroF1": (micro_f1(counted, keys), "f1"), "M2M-SGS": (s, "macro"), "M2M-EGS": (e, "macro"), "M2M-SGS-weighted": (s, "weighted"), "M2M-EGS-weighted": (e, "weighted")}
    rows = [t.select(*keys, F.lit(name).alias("name"), F.col(c).alias("value")) for name, (t, c) in tables.items() if name in wanted]
    return reduce(DataFrame.unionByName, rows)
