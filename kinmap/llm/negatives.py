"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For each cluster the candidates are sorted once
by an upper bound of their score with any member: with t the angle between centroid
and candidate, and w the widest angle between the centroid and a member, no member of
length 1 scores higher than |candidate| * cos(max(0, t - w)). A member walks the list
from its top and stops where the bound times its own length falls below the worst of
its best scores: the rest of the list is certified to hold none that belongs there.

Scores are exact whole numbers: components are quantised to floor(scale * x) and
multiplied as doubles where no sum can reach 2^53, else as Python integers (a score
beyond 64 bits is an error).

A list is range-sorted and cut into blocks of `block_rows`. The first block of each
list is walked first; then each anchor knows the block that its walk ends in at the
latest, is sent to the blocks before, and goes on in each with what it knows. A block
streams the anchors that come to it past its sorted rows, so a task holds a block and a
batch of anchors. A cluster with many anchors is cut into slices, each with the blocks
it needs. The same walk finds positives (best rows of the anchor's label) and, for each
positive, negatives (best rows of other labels between `least` and 1 times its score).

Centroids are fitted on at most `FIT_ROWS` anchors, chosen by hash, on the driver; all
anchors are assigned and all rows indexed, and results are exact whatever they are.

Defined results: rows without vec_id, with a null label or vector, or with null or
non-finite components take no part; of rows that share a vec_id one stands (the
largest); zero vectors score 0 with all; vectors of another length than the anchor's
are no candidates; an anchor without another row of its label has no rows, and neither
has a positive without a negative in its range (of a positive below 0 the range is
empty); ties go to the smaller vec_id; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.llm.text import tidy
from kinmap.session import checkpointed

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 5
LEAST, MOST = 80, 100
CLUSTERS, FIT_ROWS = 8, 4096
BLOCK_ROWS, STRIP_ROWS, SLICE_ANCHORS, BATCH_ANCHORS = 16_384, 2_048, 8_192, 128
#: Added to cosines and taken from angles, far over what doubles lose in them.
SLACK = 1e-6
EXACT = 2.0**53


def vectors_of(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """(id, label, dims, vector) of the rows that take part; the vector as bytes of quantised doubles."""
    x = rows.where("vec_id IS NOT NULL").select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    x = x.groupBy("vec_id").agg(F.max(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = x.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.floor(scale * np.asarray(v, np.float64)).astype("<f8").tobytes() for v in batch.column("vector").to_pylist()]
            dims = pa.array([len(b) // 8 for b in blobs], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), dims, pa.array(blobs, pa.binary())], ["id", "label", "dims", "vector"])

    return x.mapInArrow(tidy(pack), "id long, label string, dims int, vector binary")


def matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dims)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths; components near the largest doubles do not overflow."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        return most * np.linalg.norm(rows / np.where(most > 0, most, 1)[:, None], axis=1)


def angles(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angles between rows and unit centroids; 0 for zero rows."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    scaled = rows / np.where(most > 0, most, 1)[:, None]
    norm = np.linalg.norm(scaled, axis=1)
    cosine = (scaled @ centroids.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.where((norm > 0)[:, None], np.arccos(np.clip(cosine, -1, 1)), 0.0)


def fit_centroids(rows: np.ndarray, clusters: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    norm = np.linalg.norm(rows, axis=1)
    units = rows[norm > 0] / norm[norm > 0][:, None]
    if not len(units):
        return np.eye(1, rows.shape[1])
    centroids = units[np.random.default_rng(seed).permutation(len(units))[:clusters]]
    for _ in range(rounds):
        nearest = np.argmax(units @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where((size > 0)[:, None], sums / np.where(size > 0, size, 1)[:, None], centroids)
    return centroids


def fitted(anchors: DataFrame, clusters: int, sample: int) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from at most `sample` anchors."""
    rows = anchors.orderBy(F.xxhash64("id")).limit(sample).select("dims", "vector").toArrow().to_pydict()
    by_dims: dict[int, list[bytes]] = {}
    for dims, blob in zip(rows["dims"], rows["vector"]):
        by_dims.setdefault(dims, []).append(blob)
    return {d: fit_centroids(np.nan_to_num(matrix(blobs, d) / max(1.0, np.abs(matrix(blobs, d)).max(initial=0.0))), clusters) for d, blobs in by_dims.items()}


def clustered(anchors: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """Anchors with their cluster, their angle to its centroid and their length."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                rows = matrix(part.column("vector").to_pylist(), d)
                found = angles(rows, centroids.get(d, np.eye(1, d)))
                nearest = np.argmin(found, axis=1)
                columns = [pa.array(nearest, pa.int32()), pa.array(found[np.arange(len(rows)), nearest]), pa.array(lengths(rows))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "cluster", "angle", "length"])

    return anchors.mapInArrow(tidy(assign), "id long, label string, dims int, vector binary, cluster int, angle double, length double")


def shared_lists(rows: DataFrame, clusters: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """A row for each candidate and cluster of its vector length, with the bound on its score with members of length 1.

    `clusters` has dims, cluster, widest, a row a cluster: at most `CLUSTERS` for each vector length that occurs.
    """
    widest: dict[int, dict[int, float]] = {}
    for r in clusters.collect():
        widest.setdefault(r.dims, {})[r.cluster] = r.widest

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                if d not in widest:
                    continue
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                vectors = matrix(part.column("vector").to_pylist(), d)
                size, found = lengths(vectors), angles(vectors, centroids.get(d, np.eye(1, d)))
                for c, w in widest[d].items():
                    bounds = size * np.minimum(1.0, np.cos(np.minimum(np.pi, np.maximum(0.0, found[:, c] - w - SLACK))) + SLACK)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), c, np.int32)), pa.array(bounds)], [*part.schema.names, "cluster", "bound"])

    return rows.mapInArrow(tidy(bound), "id long, label string, dims int, vector binary, cluster int, bound double")


def in_blocks(lists: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The lists sorted by falling bound and cut into blocks of at most `block_rows`, numbered from 0 in each list."""
    order = ["dims", "cluster", F.desc("bound"), "id"]
    dealt = checkpointed(lists.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("dims", "cluster", "part").agg(F.count("*").alias("n"))  # a row a partition and list
    before = Window.partitionBy("dims", "cluster").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("dims", "cluster", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("dims", "cluster", "part").orderBy(F.desc("bound"), "id")
    placed = dealt.join(F.broadcast(offsets), ["dims", "cluster", "part"]).withColumn("place", F.col("offset") + F.row_number().over(inside) - 1)
    return checkpointed(placed.select("dims", "cluster", F.floor(F.col("place") / block_rows).cast("int").alias("block"), "bound", "id", "label", "vector"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; those beyond 64 bits raise an error."""
    with np.errstate(over="ignore"):
        safe = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1] < EXACT
    if safe:
        return a @ b.T
    whole = [np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)


class Walk:
    """A sorted block of a list, which anchors walk down."""

    def __init__(self, rows: pa.Table, dims: int, k: int):
        self.ids, self.bounds = rows.column("id").to_numpy(), rows.column("bound").to_numpy()
        self.labels = np.asarray(rows.column("label").to_pylist(), object)
        self.vectors, self.k = matrix(rows.column("vector").to_pylist(), dims), k

    def take(self, anchors: dict, least: list[list[int | None]], needs: list[list[tuple[bool, int | None, int | None]]]) -> list[list[list[tuple[int, int]]]]:
        """For each anchor and each of its needs the best (score, id) of the block, and None in place of what ends below `least`.

        A need is (same label, lowest score, highest score); null scores are open ends.
        """
        vectors = matrix(anchors["vector"], self.vectors.shape[1])
        size, ids, labels = np.asarray(anchors["length"]), np.asarray(anchors["id"]), anchors["label"]
        best: list[list[list[tuple[int, int]]]] = [[[] for _ in need] for need in needs]
        floor = [list(f) for f in least]
        active = np.arange(len(vectors))
        for s in range(0, len(self.ids), STRIP_ROWS):
            # A walk ends where no row below can reach the worst that still counts.
            enough = np.array([min((-np.inf if f is None else f) for f in floor[a]) if floor[a] else np.inf for a in active], float)
            active = active[self.bounds[s] * size[active] * (1 + SLACK) + SLACK >= enough]
            if not len(active):
                break
            strip = slice(s, s + STRIP_ROWS)
            scores = products(vectors[active], self.vectors[strip])
            for row, a in enumerate(active.tolist()):
                same = self.labels[strip] == labels[a]
                other = self.ids[strip] != ids[a]
                for j, (wants_same, low, high) in enumerate(needs[a]):
                    ok = other & (same if wants_same else ~same)
                    if high is not None:
                        ok &= scores[row] <= high
                    if floor[a][j] is not None:
                        ok &= scores[row] >= floor[a][j]
                    at = np.flatnonzero(ok)
                    if len(at) > self.k:  # ties of the last one stay for now
                        kth = np.partition(scores[row][at], len(at) - self.k)[len(at) - self.k]
                        at = at[scores[row][at] >= kth]
                        at = at[np.lexsort((self.ids[strip][at], -scores[row][at]))[: self.k]]
                    if len(at):
                        found = best[a][j] + [(int(scores[row][i]), int(self.ids[strip][i])) for i in at]
                        best[a][j] = found = sorted(found, key=lambda x: (-x[0], x[1]))[: self.k]
                        if len(found) == self.k:
                            floor[a][j] = found[-1][0] if floor[a][j] is None else max(floor[a][j], found[-1][0])
        return best


def walked(blocks: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(id, need, found, score): the best of each block for each need of the anchors sent to it.

    `anchors`: dims, cluster, slice, block, id, label, vector, length, needs (array of
    same, low, high, least). Rows of a block come first in its task, anchors after them.
    """
    lists = blocks.join(anchors.select("dims", "cluster", "slice", "block").distinct(), ["dims", "cluster", "block"])
    none = F.lit(None)
    left = lists.select("dims", "cluster", "slice", "block", F.lit(0).alias("kind"), "bound", "id", "label", "vector", none.cast("double").alias("length"), none.cast(NEEDS).alias("needs"))
    right = anchors.select("dims", "cluster", "slice", "block", F.lit(1).alias("kind"), none.cast("double").alias("bound"), "id", "label", "vector", "length", "needs")
    key = ["dims", "cluster", "slice", "block"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in (*key, "kind"))))
            s = 0
            while s < len(names):
                e = s + 1
                while e < len(names) and names[e] == names[s]:
                    e += 1
                part, (*unit, kind) = batch.slice(s, e - s), names[s]
                s = e
                if unit != current:
                    current, held, block = unit, [], None
                if kind == 0:
                    held.append(part)
                    continue
                if block is None:
                    block, held = Walk(pa.Table.from_batches(held).combine_chunks(), unit[0], k), []
                for first in range(0, len(part), BATCH_ANCHORS):
                    some = part.slice(first, BATCH_ANCHORS).select(["id", "label", "vector", "length", "needs"]).to_pydict()
                    needs = [[(n["same"], n["low"], n["high"]) for n in row] for row in some["needs"]]
                    least = [[n["least"] for n in row] for row in some["needs"]]
                    rows = [(a, j, i, v) for a, found in zip(some["id"], block.take(some, least, needs)) for j, pairs in enumerate(found) for v, i in pairs]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["id", "need", "found", "score"])

    sorted_rows = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "kind", F.desc("bound"), "id")
    return sorted_rows.mapInArrow(tidy(walk), "id long, need int, found long, score long")


NEEDS = "array<struct<same:boolean,low:long,high:long,least:long>>"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The first k of each need, with their places from 1; a block has sent k at most."""
    order = Window.partitionBy("id", "need").orderBy(F.desc("score"), "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def walk_lists(blocks: DataFrame, tops: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(id, need, found, score, place): the best k of the whole lists for each need of each anchor.

    `anchors`: id, label, dims, cluster, slice, length, vector, needs (same, low, high).
    `tops`: dims, cluster, block, top: the highest bound of each block.
    """
    start = F.transform("needs", lambda n: F.struct(n["same"].alias("same"), n["low"].alias("low"), n["high"].alias("high"), n["low"].alias("least")))
    first = checkpointed(best_of(walked(blocks, anchors.withColumn("needs", start).withColumn("block", F.lit(0)), k), k))
    # The k-th score so far is the least that counts from here on.
    known = first.where(F.col("place") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("need", "score"))).alias("kth"))
    later = anchors.join(known, "id", "left")
    kth = lambda j: F.when(F.col("kth").isNotNull(), F.try_element_at("kth", j.cast("int")))
    least = F.transform("needs", lambda n, j: F.struct(n["same"].alias("same"), n["low"].alias("low"), n["high"].alias("high"), F.greatest(n["low"], kth(j)).alias("least")))
    # An open need has no least score: its anchor goes to all blocks.
    later = later.withColumn("needs", least).withColumn("enough", F.when(F.exists("needs", lambda n: n["least"].isNull()), F.lit(float("-inf"))).otherwise(F.array_min(F.transform("needs", lambda n: n["least"])).cast("double")))
    later = later.join(tops.where("block > 0"), ["dims", "cluster"]).where(F.col("top") * F.col("length") * (1 + SLACK) + SLACK >= F.col("enough"))
    rest = walked(blocks, later.drop("kth", "enough", "top"), k)
    return best_of(first.drop("place").unionByName(rest), k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    clusters: int = CLUSTERS, block_rows: int = BLOCK_ROWS, slice_anchors: int = SLICE_ANCHORS, scale: float = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; least and most in hundredths of the positive's score."""
    vectors = checkpointed(vectors_of(rows, scale))
    chosen = vectors.where(is_anchor)
    centroids = fitted(chosen, clusters, FIT_ROWS)
    anchors = checkpointed(clustered(chosen, centroids))
    sizes = anchors.groupBy("dims", "cluster").agg(F.max("angle").alias("widest"), F.count("*").alias("n"))
    blocks = in_blocks(shared_lists(vectors, sizes, centroids), block_rows)
    tops = blocks.groupBy("dims", "cluster", "block").agg(F.max("bound").alias("top"))
    slices = F.ceil(F.col("n") / slice_anchors)
    anchors = anchors.join(F.broadcast(sizes.drop("widest")), ["dims", "cluster"]).withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).drop("n", "angle")

    null = F.lit(None).cast("long")
    need = F.array(F.struct(F.lit(True).alias("same"), null.alias("low"), null.alias("high")))
    found = checkpointed(walk_lists(blocks, tops, anchors.withColumn("needs", need), positives))
    pairs = found.select("id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") - 1).alias("need"))
    # 100 * s >= least * p in whole numbers: s is at least the ceiling of least * p / 100.
    p = F.col("positive_score").cast("decimal(30,0)")
    low, high = (-F.floor(-p * least / 100)).cast("long"), F.floor(p * most / 100).cast("long")
    ranges = pairs.where("positive_score >= 0").withColumn("of", F.struct("need", F.lit(False).alias("same"), low.alias("low"), high.alias("high")))
    needs = ranges.groupBy("id").agg(F.array_sort(F.collect_list("of")).alias("needs"))  # as many as positives
    needs = needs.withColumn("needs", F.transform("needs", lambda n: F.struct(n["same"].alias("same"), n["low"].alias("low"), n["high"].alias("high"))))
    chosen = walk_lists(blocks, tops, anchors.join(needs, "id"), negatives)
    out = chosen.join(pairs, ["id", "need"])
    return out.select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


ORACLE = f"""
WITH ok AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM ok a JOIN ok b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES}),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
    FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {MOST} * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= {NEGATIVES}
"""
