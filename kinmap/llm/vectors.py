"""Embedding near-duplicates by spherical-cap filters.

Filter directions are random product codes: a random rotation cuts the space
into blocks, each block has random unit codewords, and a direction is one
codeword a block. A vector is list-decoded to all directions whose inner product
with it reaches its threshold, which is its `decoded`-th best: only combinations
of the best codewords of each block can be among these (rank products of at most
`decoded`), so they are found without going over all directions. (One threshold
for all vectors leaves some without a direction: at as many directions a vector
its recall is far lower, see the README.) Vectors with equal labels that share a
direction are compared in double precision.

Equal vectors of a label are one class and meet once. A direction with many
vectors is cut into parts and each pair of parts is a group of its own. Links are
not written: a group tells how many links each of its vectors has that no smaller
shared direction tells of, and a forest with the components of its links.

Defined results: rows without vec_id are left out; of rows that share a vec_id
one stands (the largest); null labels, null or zero vectors and vectors with
null or non-finite components link with nothing and are kept; vectors of
different lengths never link; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.components import components, roots_of
from kinmap.llm.text import tidy
from kinmap.session import checkpointed

THRESHOLD = 0.98
BLOCKS, ROTATIONS, DECODED = 4, 2, 8
PART_ROWS = 512


def codewords_for(rows: int) -> int:
    """Codewords a block, so that the directions grow with the rows."""
    return max(8, int(np.ceil((rows / 16) ** (1 / BLOCKS))))


class ProductCode:
    def __init__(self, dims: int, codewords: int, seed: int, blocks: int = BLOCKS):
        random = np.random.default_rng([seed, dims, codewords])
        self.width = -(-dims // blocks)
        self.rotation = np.linalg.qr(random.normal(size=(self.width * blocks, self.width * blocks)))[0][:dims]
        words = random.normal(size=(blocks, codewords, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)

    def decode(self, units: np.ndarray, decoded: int = DECODED) -> np.ndarray:
        """The numbers of the `decoded` best directions of each unit vector."""
        blocks, count, _ = self.words.shape
        parts = (units @ self.rotation).reshape(len(units), blocks, self.width)
        scores = np.einsum("nbw,bkw->nbk", parts, self.words)
        best = np.argsort(-scores, axis=2)[:, :, :decoded]
        top = np.take_along_axis(scores, best, 2)
        width = top.shape[2]
        sums, numbers, ranks = top[:, 0], best[:, 0], np.arange(1, width + 1)
        for b in range(1, blocks):
            product = ranks[:, None] * np.arange(1, width + 1)
            i, j = np.nonzero(product <= decoded)
            sums = sums[:, i] + top[:, b][:, j]
            numbers = numbers[:, i] * count + best[:, b][:, j]
            ranks = product[i, j]
        order = np.argsort(-sums, axis=1, kind="stable")[:, :decoded]
        return np.take_along_axis(numbers, order, 1)


def unit_rows(blobs: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very small or large numbers are none
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def packed(classes: DataFrame) -> DataFrame:
    """(id, members, label, dims, vector), the vector as bytes of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            blobs = [np.asarray(x, "<f8").tobytes() for x in lists.to_pylist()]
            kept = [batch.column(c) for c in ("id", "members", "label", "dims")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(blobs, pa.binary())], ["id", "members", "label", "dims", "vector"])

    return classes.mapInArrow(tidy(pack), "id long, members long, label string, dims int, vector binary")


def filters(vectors: DataFrame, codewords: int) -> DataFrame:
    """A row (label, dims, direction, id, members, vector, all of its directions) for each direction of each vector."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                part = batch.take(pa.array(at))
                code = codes.setdefault(d, [ProductCode(d, codewords, seed) for seed in range(ROTATIONS)])
                units = unit_rows(part.column("vector").to_pylist())
                found = [c.decode(units) + seed * codewords**BLOCKS for seed, c in enumerate(code)]
                each = np.concatenate(found, axis=1).astype("<i8")
                repeat = pa.array(np.repeat(np.arange(len(at)), each.shape[1]))
                names = ["label", "dims", "id", "members", "vector"]
                every = pa.array([row.tobytes() for row in each], pa.binary()).take(repeat)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(repeat) for c in names], every, pa.array(each.ravel())], [*names, "all", "direction"])

    return vectors.mapInArrow(tidy(decode), "label string, dims int, id long, members long, vector binary, all binary, direction long")


def group_links(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each key of the rows, sorted by key: ids, their linked members that no smaller shared direction finds, and a forest of the links."""
    key = np.asarray(table.column("key").combine_chunks().dictionary_encode().indices)
    ids, left, members, direction = (table.column(c).to_numpy() for c in ("id", "left", "members", "direction"))
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    vectors, every = table.column("vector").to_pylist(), table.column("all").to_pylist()
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if e - s < 2:
            continue
        units = unit_rows(vectors[s:e])
        directions = np.frombuffer(b"".join(every[s:e]), "<i8").reshape(e - s, -1)
        own, smaller = left[s:e], directions < direction[s]
        a, b = (np.arange(e - s),) * 2 if own.all() else (np.flatnonzero(own), np.flatnonzero(~own))
        linked = units[a] @ units[b].T >= threshold
        if own.all():
            np.fill_diagonal(linked, False)
        if not linked.any():
            continue
        # Which of the smaller directions each row has, of those that stand in several rows.
        values, place, times = np.unique(directions[smaller], return_inverse=True, return_counts=True)
        has = np.zeros((e - s, len(values)), np.float32)
        has[np.nonzero(smaller)[0], place] = 1
        has = has[:, times > 1]
        new = linked & ~(has[a] @ has[b].T > 0)
        degree = np.zeros(e - s, np.int64)
        weights = members[s:e]
        degree[a] += new @ weights[b]
        if not own.all():
            degree[b] += new.T @ weights[a]
        i, j = np.nonzero(linked)
        names, roots = roots_of(ids[s:e][a[i]], ids[s:e][b[j]])
        apart = names != roots
        yield ids[s:e][degree > 0], degree[degree > 0], names[apart], roots[apart]


def near_links(keyed: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, n): a has n more links; and (a, b): a and b are in one component. Rows are sorted by key in each task."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            parts = list(group_links(table, threshold)) if table.num_rows else []
            if parts:
                ids, n, names, roots = (np.concatenate(x) for x in zip(*parts))
                more, ends = pa.nulls(len(names), pa.int64()), pa.nulls(len(ids), pa.int64())
                columns = [[pa.array(ids), pa.array(names)], [ends, pa.array(roots)], [pa.array(n), more]]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "n"])

        for batch in batches:
            # The rows of the last key may go on in the next batch.
            table = pa.Table.from_batches([*held, batch])
            if not table.num_rows:
                continue
            keys = table.column("key")
            cut = int(np.argmax(pa.compute.equal(keys, keys[-1]).to_numpy()))
            if cut:
                yield from found(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    sorted_rows = keyed.repartition("key").sortWithinPartitions("key")
    return sorted_rows.select("key", "left", "id", "members", "vector", "all", "direction").mapInArrow(tidy(compare), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, part_rows: int = PART_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.max(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0)
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & ~zero
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))

    classes = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("members"))
    classes = checkpointed(classes.withColumn("dims", F.size("vector")))
    keyed = filters(packed(classes.select("id", "members", "label", "dims", "vector")), codewords_for(classes.count()))
    keyed = keyed.withColumn("key", F.concat_ws("/", "label", "dims", "direction"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select(
        F.concat_ws("/", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        (F.col("own") <= F.col("other")).alias("left"),
        *["id", "members", "vector", "all", "direction"],
    )
    links = checkpointed(near_links(keyed, threshold))
    degree = links.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    found = components(links.where("b IS NOT NULL").select("a", "b"))
    summary = (
        classes.select("label", "vector", "id", "members")
        .join(degree, "id", "left")
        .join(found, "id", "left")
        .select(
            "label",
            "vector",
            (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    plain = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where("usable").join(summary, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    return joined.unionByName(plain).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM links WHERE a = vec_id), vec_id)) AS c0 FROM embeddings),
closed AS (WITH RECURSIVE r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, links.b FROM r JOIN links ON r.y = links.a)
    SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN closed ON closed.x = e.vec_id
"""
