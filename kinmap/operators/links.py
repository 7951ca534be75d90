"""Edges that the steps of an iteration join again and again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmap.session import broadcast_up_to, checkpointed, in_buckets


@dataclass(frozen=True)
class Links:
    """Rows that tables join by `keys`: broadcast where they are few, else stored in buckets.

    Stored rows of a key with more than an even bucket has are dealt over parts, and
    rows of the other table go to each part of their key. `hubs` (keys, parts) has
    fewer rows than there are buckets, as each stands for more than an even bucket.
    """

    rows: DataFrame
    keys: list[str]
    hubs: DataFrame | None = None

    def join(self, table: DataFrame) -> DataFrame:
        """The table's rows with each of their links; only the table is shuffled, if anything."""
        if self.hubs is None:
            return table.join(self.rows, self.keys)
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        sent = table.join(F.broadcast(self.hubs), self.keys, "left").withColumn("part", parts).drop("parts")
        return sent.join(self.rows, [*self.keys, "part"]).drop("part")


def linked(rows: DataFrame, keys: list[str], most_rows: int = 1_000_000, most_bytes: int = 64 << 20) -> Links:
    """Links of the rows, computed once: broadcast up to so many rows and bytes."""
    rows = checkpointed(rows)
    small = broadcast_up_to(rows, most_rows, most_bytes)
    if small is not rows:
        return Links(small, keys)
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = max(1, rows.count() // buckets)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > even)
    hubs = checkpointed(counts.select(*keys, F.ceil(F.col("n") / even).cast("int").alias("parts")))
    others = [c for c in rows.columns if c not in keys]
    dealt = rows.join(F.broadcast(hubs), keys, "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*others), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return Links(in_buckets(dealt, "links", [*keys, "part"], buckets), keys, hubs)
