"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, served again from the
start when it runs out (at most `repeats` rounds). A document's virtual finish
time is the tokens that its source has sent by its end, divided by the source's
target. Served copies are range-sorted by that time over all sources, and the order
is cut where its running total comes nearest to the total budget: a copy is in
when the budget reaches its middle. So the total misses the budget by half a
document at most, and a source misses its target by about the longest documents.

The shuffled order is that of md5(seed, doc_id). Running sums are built in two
levels: documents are dealt into slices of the order, slices are summed before
anything is ordered, and only slice totals are put in sequence. So a source that
holds most of the rows is spread over as many slices as any other share of rows.
The global order is dealt to range partitions in the same way: whole partitions are
before or behind the cut, and only the one that it lies in is looked at row by row.

Defined results: null text has size 0; documents of size 0 are never taken more
than size 0; a null source is a source of its own, after all others; rows that
share a doc_id are separate documents and are ordered by size; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.session import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
ROWS_PER_SLICE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Filling by weight with caps has a closed form: sources reach their caps in the
    order of cap over weight, so with sources in that order, the first ones are
    capped and the rest share what is left by weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    table = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    table = table.withColumn("cap", F.col("source_size") * float(repeats))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    here_on = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything.orderBy(F.lit(0))) * share
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(here_on))
    # A source is below its cap from the first one whose level stays below cap / weight.
    below = F.col("level") * F.col("weight") < F.col("cap")
    table = table.withColumn("nth", F.row_number().over(fill))
    first = F.min(F.when(below, F.struct("nth", "level"))).over(everything.orderBy(F.lit(0)))
    table = table.withColumn("level", first["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return table.select("source", "source_size", target.alias("target"))


def served(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = "mix",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> tuple[DataFrame, DataFrame]:
    """All items with their targets, and the served copies, each with its place in the mix."""
    rows = docs.count()
    slices = max(1, -(-rows // rows_per_slice))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    items = docs.select("doc_id", "source", "size", place.alias("place"))
    # Sizes are counted once: the texts are not read again for each of the sums below.
    items = checkpointed(items.withColumn("slice", F.floor(F.col("place") * F.lit(float(slices) / 2.0**48)).cast("int")))

    totals = items.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    sizes = totals.groupBy("source").agg(F.sum("in_slice").alias("source_size"))
    targets = source_targets(sizes, weights, share, repeats)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "slice", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.join(targets, offsets.source.eqNullSafe(targets.source)).drop(targets.source)

    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = items.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    queued = queued.join(
        offsets.withColumnsRenamed({"source": "o_source", "slice": "o_slice"}),
        F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")),
    ).drop("o_source", "o_slice")
    sent = F.col("offset") + F.col("ahead")
    copies = queued.where(F.col("target") > 0).select(
        "doc_id", "source", "size", "place", "source_size", "target", sent.alias("sent"),
        F.explode(F.array(*map(F.lit, range(repeats)))).alias("round"),
    )
    finish = (F.col("sent") + F.col("source_size") * F.col("round") + F.col("size")) / F.col("target")
    budget = targets.agg(F.sum("source_size") * share).first()[0] or 0.0
    kept = within_budget(copies.withColumn("time", finish), budget, max(1, -(-rows * repeats // (16 * rows_per_slice))))
    return queued.select("doc_id", "source", "size", "source_size", "target"), kept


def within_budget(copies: DataFrame, budget: float, parts: int) -> DataFrame:
    """The first copies in the order of virtual time, over all sources, until the budget is spent."""
    order = ("time", "place", "doc_id", "round", "size")
    dealt = copies.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = checkpointed(dealt)
    until = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    sums = dealt.groupBy("part").agg(F.sum("size").alias("in_part"))
    sums = sums.select("part", "in_part", F.coalesce(F.sum("in_part").over(until), F.lit(0)).alias("before")).where(F.col("before") <= F.lit(budget))
    placed = dealt.join(F.broadcast(sums), "part")  # a row a partition
    whole = placed.where(F.col("before") + F.col("in_part") <= F.lit(budget))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where(F.col("before") + F.col("in_part") > F.lit(budget))
    cut = cut.withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.where(F.col("ahead") + F.col("size") / 2 <= F.lit(budget)).drop("ahead")
    return whole.unionByName(cut).drop("part", "in_part", "before")


def in_order(kept: DataFrame) -> DataFrame:
    """The served copies sorted in the order of the mix, over all partitions."""
    order = ("time", "place", "doc_id", "round", "size")
    return kept.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """Each of docs' (doc_id, source, size) with source_size, target and `times`, how often the mix takes it."""
    every, kept = served(docs, **settings)
    times = kept.groupBy(F.col("doc_id").alias("k_id"), F.col("source").alias("k_source"), F.col("size").alias("k_size"))
    times = times.agg(F.count("*").alias("served"))
    same = every.groupBy("doc_id", "source", "size", "source_size", "target").agg(F.count("*").alias("rows"))
    joined = same.join(
        times,
        F.col("doc_id").eqNullSafe(F.col("k_id"))
        & F.col("source").eqNullSafe(F.col("k_source"))
        & (F.col("size") == F.col("k_size")),
        "left",
    )
    # Rows that agree in all of it share what was served to them, as evenly as whole rounds go.
    joined = joined.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    served_here = F.coalesce("served", F.lit(0))
    times = F.floor(served_here / F.col("rows")) + F.when(F.col("row") <= served_here % F.col("rows"), 1).otherwise(0)
    return joined.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(sized).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken")
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS ss, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, {REPEATS} * ss AS cap, row_number() OVER o AS nth,
    ({SHARE} * sum(ss) OVER () - coalesce(sum({REPEATS} * ss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
    WINDOW o AS (ORDER BY {REPEATS} * ss / w, source NULLS LAST)),
l AS (SELECT arg_min(level, nth) AS level FROM f WHERE level * w < cap),
t AS (SELECT source, ss, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target FROM f),
q AS (SELECT d.*, ss, target, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, round, (upto + round * ss) / target AS time
    FROM q, (SELECT unnest(range({REPEATS})) AS round) WHERE target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY time, place, doc_id, round, size ROWS UNBOUNDED PRECEDING) AS running FROM c),
k AS (SELECT doc_id, count(*) AS times FROM r WHERE running - size / 2 <= {SHARE} * (SELECT sum(ss) FROM s) GROUP BY doc_id)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (size * coalesce(times, 0))::BIGINT AS taken FROM q LEFT JOIN k USING (doc_id)
"""
