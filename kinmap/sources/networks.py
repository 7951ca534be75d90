"""Reading and writing network sets, entity maps, prediction sweeps and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.sources import entities as entity_files
from kinmap.sources.fixtures import NetworkSet

NODES = "gid INT, node LONG, x ARRAY<DOUBLE>"
EDGES = "gid INT, src LONG, dst LONG, w DOUBLE, edge_attr ARRAY<DOUBLE>"
ANCHORS = "aid LONG, nodes ARRAY<LONG>, split STRING"
RUN_COLUMNS = [("Epoch", "epoch", "int"), ("Loss", "loss", "double"), ("EpochTime", "epoch_time", "double"), ("Hits@1", "hits1", "double"), ("Hits@10", "hits10", "double"), ("Hits@30", "hits30", "double"), ("Hits@50", "hits50", "double"), ("MRR", "mrr", "double"), ("memory", "memory", "double"), ("infer_time", "infer_time", "double")]


def build(edges: DataFrame, anchors: DataFrame, nodes: DataFrame | None = None) -> NetworkSet:
    """A set from its tables; without nodes these are all ends of edges and members of anchors."""
    if nodes is None:
        ends = edges.select("gid", F.explode(F.array("src", "dst")).alias("node"))
        members = anchors.select(F.posexplode("nodes").alias("gid", "node")).where("node <> -1")
        nodes = ends.union(members).distinct().withColumn("x", F.lit(None).cast("array<double>"))
    return NetworkSet(nodes, edges, anchors)


def write(network: NetworkSet, folder: str) -> None:
    network.nodes.write.mode("overwrite").partitionBy("gid").parquet(f"{folder}/nodes")
    network.edges.write.mode("overwrite").partitionBy("gid").parquet(f"{folder}/edges")
    network.anchors.write.mode("overwrite").parquet(f"{folder}/anchors")


def load(spark: SparkSession, folder: str) -> NetworkSet:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    return NetworkSet(read("nodes", NODES), read("edges", EDGES), read("anchors", ANCHORS))


def entity_rows(each: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(entities(eid, side, node), entity_ids(eid)) of rows with an entity's lists, with the key columns."""
    sides = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("nodes")), F.struct(F.lit("tgt").alias("side"), F.col("tgt").alias("nodes"))))
    rows = each.select(*keys, "eid", sides.alias("s")).select(*keys, "eid", "s.side", F.explode("s.nodes").alias("node"))
    return rows, each.select(*keys, "eid")


def read_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Of a file or a folder of files; a file is read by byte ranges, so its size does not matter."""
    return entity_rows(entity_files.read(spark, path))


def write_predictions(entities: DataFrame, ids: DataFrame, folder: str) -> None:
    """A folder a rate, named after it, with a JSON file a part of its entities."""
    entity_files.write(entities, ids, folder, "rate")


def read_predictions(spark: SparkSession, glob: str, pattern: str = r"rate=([0-9.]+)") -> tuple[DataFrame, DataFrame]:
    """(entities(file, rate, eid, side, node), ids(file, rate, eid)); the rate is NaN where the path has none, and a rate may have several files."""
    if entity_files.file_ranges(spark, glob).isEmpty():
        raise FileNotFoundError(f"no predictions in {glob}")
    found = F.regexp_extract("file", pattern, 1)
    rate = F.when(found == "", F.lit(float("nan"))).otherwise(F.rtrim(found, F.lit(".")).try_cast("double"))
    return entity_rows(entity_files.read(spark, glob).withColumn("rate", rate), "file", "rate")


def write_sweep(rows: DataFrame, folder: str) -> None:
    """The sweep's CSV in order of the error rate; one file, as a sweep has a row a prediction file."""
    rows.orderBy("error_rate").coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def write_runs(rows: DataFrame, facts: list[str], folder: str, rows_per_file: int = 1_000_000) -> None:
    """Training logs as CSV with a header, one folder a run by its facts; lines that start with # stay as they are."""
    dealt = rows.repartition(*facts)
    dealt.write.partitionBy(*facts).option("header", True).option("comment", "\u0001").option("maxRecordsPerFile", rows_per_file).csv(folder)


def read_runs(spark: SparkSession, glob: str) -> DataFrame:
    """Training logs; algorithm, attributes, dataset, ratio and seed come from the path (as `x` or `name=x`), # lines are comments."""
    schema = ", ".join(f"`{name}` {kind}" for name, _, kind in RUN_COLUMNS)
    rows = spark.read.option("header", True).option("comment", "#").option("recursiveFileLookup", True).schema(schema).csv(glob)
    part = lambda k: F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/(?:[^/=]+=)?(attr|plain)/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([0-9.]+)/(?:[^/=]+=)?seed_([0-9]+)/", k)
    facts = [part(1).alias("algo"), (part(2) == "attr").alias("use_attr"), part(3).alias("dataset"), part(4).cast("double").alias("train_ratio"), part(5).cast("int").alias("seed")]
    return rows.select(*facts, *[F.col(f"`{name}`").alias(alias) for name, alias, _ in RUN_COLUMNS])


def append_metrics(rows: DataFrame, folder: str, digits: int = 4) -> None:
    """Append metric rows, numbers rounded, partitioned by algorithm and dataset."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*rounded).write.mode("append").partitionBy("algo", "dataset").parquet(folder)
