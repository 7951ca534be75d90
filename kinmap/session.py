"""Session helpers shared by jobs, benchmarks and tests."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share.

    Only in a local session without the setting (tests) a temporary folder takes
    its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a number, what texts and lists hold."""
    parts = [F.lit(16)]
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif kind.startswith("array"):
            parts.append(F.coalesce(F.greatest(F.size(column), F.lit(0)) * 8, F.lit(0)))
        else:
            parts.append(F.lit(8))
    return reduce(lambda x, y: x + y, parts).cast("long")


def broadcast_up_to(df: DataFrame, rows: int = 1_000_000, size: int = 64 << 20) -> DataFrame:
    """The table, marked for a broadcast if it has at most so many rows and bytes; beyond, joins shuffle it."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.n <= rows and found["size"] <= size else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def in_buckets(df: DataFrame, name: str, by: list[str], buckets: int) -> DataFrame:
    """Cut the lineage by a table in the shared folder with a file a bucket: joins on the columns do not shuffle it."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by)
    dealt.option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)
