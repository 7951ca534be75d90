"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (line) is hashed to a wide vector and the vectors of a text are
summed, every lane modulo a power of two. Sums do not depend on the order of the
paragraphs, and a paragraph is inserted or deleted by adding or subtracting its
vector (`combined`). The vector has three parts:

* 8 exact lanes of 28 bits from sha-256 of the paragraph, summed modulo 2**32;
* 120 likeness lanes of one bit from md5 of each clause of the paragraph (split
  at punctuation), summed modulo 2**16;
* the number of clauses, modulo 2**32.

Likeness is that of two fingerprints: lanes counted from their middle, half the
number of clauses, have about the cosine of the two bags of clauses. A lane may be
off its middle by up to 2**15 clauses; beyond that it comes round.

Bits are summed two lanes at a time, packed 30 bits apart in a long, so 60 sums
serve 120 lanes. Each text is hashed once; what its fingerprint and its neighbours
need of it is written as a narrow table.

Defined results: null text is the empty text, which is one empty paragraph;
rows without doc_id are left out; of rows that share a doc_id the largest text
stands; extra columns are ignored; a table of one document has itself as next;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.session import checkpointed, stored

EXACT, SHIFTS, GAP = 8, 30, 30
CLAUSE_END = r"[.!?,;:\n]+\s*"
PACKED = [f"p{h}_{s}" for h in range(2) for s in range(SHIFTS)]
SUMS = [f"e{k}" for k in range(EXACT)] + PACKED + ["clauses"]
LANE, WIDE = (1 << 16) - 1, (1 << 32) - 1
ROWS_PER_PART = 65536


def next_documents(docs: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """doc_id, next_id: the next smaller doc_id; after the smallest, the largest.

    Ids are range-partitioned and kept; within a partition a window finds the
    neighbour, and only the ends of partitions are put in sequence.
    """
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct()
    parts = max(1, -(-docs.count() // rows_per_part))
    ids = checkpointed(ids.repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("part")))
    ends = ids.groupBy("part").agg(F.max("doc_id").alias("last"))
    around = Window.orderBy("part")  # as many rows as partitions
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        F.col("part").alias("e_part"),
        F.coalesce(F.lag("last").over(around), F.max("last").over(everything)).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id")
    ids = ids.withColumn("prior", F.lag("doc_id").over(inside))
    return ids.join(F.broadcast(ends), F.col("part") == F.col("e_part")).select(
        "doc_id", F.coalesce("prior", "before").alias("next_id")
    )


def one_text_per_id(docs: DataFrame) -> DataFrame:
    """The texts; only those of repeated ids are gathered and compared."""
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    repeated = checkpointed(texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return texts
    again = texts.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return texts.join(repeated, "doc_id", "left_anti").unionByName(again)


def unit_sums(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The wide sums of texts' paragraphs and clauses for each of keys."""
    units = texts.select(
        *keys,
        F.explode(
            F.concat(
                F.transform(F.split("text", "\n"), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("s"))),
                F.transform(F.split("text", CLAUSE_END), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("s"))),
            )
        ).alias("u"),
    ).select(*keys, "u.whole", "u.s")
    units = units.where("whole OR s <> ''")
    digest = F.when(F.col("whole"), F.sha2("s", 256)).otherwise(F.md5("s"))
    units = units.select(*keys, "whole", digest.alias("d"))
    number = lambda start, n: F.conv(F.substring("d", start, n), 16, 10).cast("long")
    exact = [F.when(F.col("whole"), number(1 + 7 * k, 7)) for k in range(EXACT)]
    bits = [F.when(~F.col("whole"), number(1 + 16 * h, 15)) for h in range(2)]
    units = units.select(
        *keys, "whole", *[e.alias(f"e{k}") for k, e in enumerate(exact)], *[b.alias(f"b{h}") for h, b in enumerate(bits)]
    )
    pair = (1 << GAP) + 1
    return units.groupBy(*keys).agg(
        *[F.sum(f"e{k}").alias(f"e{k}") for k in range(EXACT)],
        *[
            F.coalesce(F.sum(F.shiftright(f"b{h}", s).bitwiseAND(F.lit(pair))), F.lit(0)).alias(f"p{h}_{s}")
            for h in range(2)
            for s in range(SHIFTS)
        ],
        F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("clauses"),
    )


def fingerprint_of(sums: Column) -> Column:
    """The sums' lanes modulo powers of two as an array in the order of SUMS, two likeness lanes in a number of 32 bits."""
    low = lambda x: x.bitwiseAND(F.lit(LANE))
    two = lambda x: low(x) * (LANE + 1) + low(F.shiftright(x, GAP))
    return F.array(*[two(sums[c]) if c in PACKED else sums[c].bitwiseAND(F.lit(WIDE)) for c in SUMS])


def parts_of(lanes: Column) -> tuple[Column, Column, Column]:
    """Exact lanes, pairs of likeness lanes and the number of clauses."""
    return F.slice(lanes, 1, EXACT), F.slice(lanes, EXACT + 1, len(PACKED)), F.slice(lanes, EXACT + len(PACKED) + 1, 1)


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets of paragraphs (sign 1), or of the first without the second (sign -1)."""
    low = lambda x: x.bitwiseAND(F.lit(LANE))
    high = lambda x: F.shiftright(x, 16)
    wide = lambda x, y: (x + sign * y).bitwiseAND(F.lit(WIDE))
    two = lambda x, y: low(high(x) + sign * high(y)) * (LANE + 1) + low(low(x) + sign * low(y))
    return F.concat(*[F.zip_with(x, y, f) for x, y, f in zip(parts_of(a), parts_of(b), (wide, two, wide))])


def as_text(lanes: Column) -> Column:
    """Lower-case hex: 8 digits an exact lane, 4 a likeness lane, 8 of the number of clauses."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def middled(lanes: Column) -> Column:
    """Twice the likeness lanes, counted from their middle."""
    _, pairs, clauses = parts_of(lanes)
    each = F.concat(F.transform(pairs, lambda x: F.shiftright(x, 16)), F.transform(pairs, lambda x: x.bitwiseAND(F.lit(LANE))))
    return F.transform(each, lambda x: F.pmod(2 * x - clauses[0] + (LANE + 1), F.lit(2 * (LANE + 1))) - (LANE + 1))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the cosine of two arrays of lanes counted from their middle, 0 for a text without clauses."""
    product = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x).cast("double")
    norms = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when(norms == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(a, b) / norms)))


def edited_texts(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, text, edited: the last third replaced by as much of the next document's start.

    Texts are dealt by id once; what goes from one to another is the start that it needs.
    """
    texts = one_text_per_id(docs)
    thirds = texts.select("doc_id", F.floor(F.length("text") / 3).cast("int").alias("n"))
    wants = checkpointed(next_documents(docs).join(thirds, "doc_id").select("doc_id", "next_id", "n"))
    dealt = texts.repartition("doc_id")
    asked = wants.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("for_id"), "n")
    heads = dealt.join(asked, "doc_id").select(F.col("for_id").alias("doc_id"), F.substring("text", F.lit(1), F.col("n")).alias("head"))
    stay = F.substring("text", F.lit(1), F.length("text") - F.col("n"))
    own = dealt.join(wants, "doc_id").join(heads, "doc_id")
    return own.select("doc_id", "next_id", "text", F.concat(stay, "head").alias("edited"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, with their likenesses; see the module for ties and nulls."""
    texts = edited_texts(docs)
    both = texts.select(
        "doc_id",
        "next_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit(False).alias("is_edit"),
                    F.length("text").cast("long").alias("n_chars"),
                    F.lit(None).cast("string").alias("sha"),
                    F.col("text"),
                ),
                F.struct(
                    F.lit(True).alias("is_edit"),
                    F.lit(None).cast("long").alias("n_chars"),
                    F.sha2("edited", 256).alias("sha"),
                    F.col("edited").alias("text"),
                ),
            )
        ).alias("v"),
    ).select("doc_id", "next_id", "v.*")
    sums = unit_sums(both, ["doc_id", "next_id", "is_edit", "n_chars", "sha"])
    lanes = fingerprint_of(F.struct(*SUMS)).alias("lanes")
    prints = stored(sums.select("doc_id", "next_id", "is_edit", "n_chars", "sha", lanes), "fingerprints")
    own = prints.where("NOT is_edit").select("doc_id", "next_id", "n_chars", F.col("lanes").alias("own"))
    edited = prints.where("is_edit").select("doc_id", F.col("sha").alias("edited_sha256"), F.col("lanes").alias("edit"))
    following = own.select(F.col("doc_id").alias("next_id"), F.col("own").alias("other"))
    # Equal fingerprints are equal in all lanes, others only as like as their likeness lanes.
    like = lambda x, y: F.when(F.col(x) == F.col(y), 1.0).otherwise(likeness(F.col(f"m_{x}"), F.col(f"m_{y}")))
    met = own.join(edited, "doc_id").join(following, "next_id")
    return met.withColumns({f"m_{c}": middled(F.col(c)) for c in ("own", "edit", "other")}).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        like("own", "edit").alias("near_edited"),
        like("own", "other").alias("near_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
