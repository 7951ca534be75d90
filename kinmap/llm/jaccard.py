"""N-gram Jaccard join: near copies by prefix filters under several global token orders.

Documents are sets of 5-word shingles, known by 64-bit hashes. Two documents link
when their sets have a Jaccard similarity of at least the threshold.

1. Equal sets are one class and go on as one. A set that links shares at least
   threshold times its size with others. Tasks send the distinct hashes of their
   shingles, sorted and packed, to buckets; a hash that a task holds more than once
   is known to be shared before it is sent, so a hot shingle is one entry a task. A
   bucket counts for each document the shingles that stand in any other document.
   (It may see a few too many as shared, never too few: it gets as many bits of a
   hash as the corpus needs.) Sets with too few shared shingles are done; what is
   left, mostly near copies, goes on.
2. Three global token orders: by document frequency, rarest first, and two orders
   by hash, which have nothing to do with it. A pair that links shares a token of
   both sets' prefixes under each order.
3. First links: sets with the same first shared token under an order by hash meet
   one of them, their hub. What links is one component.
4. Candidates under the order by frequency come from posting lists. Pairs of one
   component need no test, so in each list what is not of its largest component
   meets the list, part by part of it, if sizes and places leave enough to share.
   Candidates that share no prefix token under the other orders go; the rest is
   verified with the whole sets.

No pair that links is left between two components, so components are exact.

Defined results: rows without doc_id are left out; rows that share a doc_id are one
document, the one with the largest set; null or wordless text has size 0 and links
with nothing; texts of fewer words than a shingle have one, their whole sequence;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.components import components
from kinmap.llm.text import blocks, bounded, mixed, pack_sorted, tidy, tidy_group, unpack_sorted, word_hashes
from kinmap.session import checkpointed

SHINGLE = 5
PERCENT = 75
SPARE_BITS = 8
BUCKET_TOKENS = 3_000_000
HELD_TOKENS = 1_500_000
BROADCAST_ROWS = 1_000_000
LIST_ROWS = 4096
SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A63))


def shingle_sets(padded: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of the rows, sorted by row and hash, and where each row starts."""
    n = len(offsets) - 1
    words, rows = word_hashes(padded, offsets)
    m = max(0, len(words) - k + 1)
    hashes = np.full(m, np.uint64(k))
    for j in range(k):
        hashes = mixed(hashes) + words[j : j + m]
    hashes = mixed(hashes)
    inside = rows[:m] == rows[k - 1 : k - 1 + m]
    hashes, owner = hashes[inside], rows[:m][inside]
    counts = np.bincount(rows, minlength=n)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        first = np.searchsorted(rows, few)
        whole = counts[few].astype(np.uint64)
        for j in range(k - 1):
            live = counts[few] > j
            whole[live] = mixed(whole[live]) + words[first[live] + j]
        hashes, owner = np.concatenate([hashes, mixed(whole)]), np.concatenate([owner, few])
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    order = np.argsort(owner, kind="stable")
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(n + 1))


def set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def needed(size: Column, percent: int) -> Column:
    """The least intersection of a set of that size with one that it links with."""
    return F.ceil(size * percent / 100)


def planes(values: np.ndarray) -> bytes:
    """32-bit values byte plane by byte plane, for the sake of compression."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def set_facts(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, name (of the set), shared (at least the number of its shingles that stand in other documents), rows.

    A task deals its documents' hashes to buckets by value; a bucket sends back, to
    each task's chunk of documents, how many hashes of each are shared. Equal sets of
    a chunk are dealt once.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tokens = max(1, int(size) // 5)
    bits = min(64, math.ceil(math.log2(tokens + 1)) + SPARE_BITS)
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    edges = np.array([np.uint64(min((b << bits) // buckets, 2**64 - 1)) for b in range(buckets)], np.uint64)
    drop = np.uint64(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        facts: list[tuple[np.ndarray, np.ndarray]] = []
        places: dict[bytes, int] = {}  # of the first row with a set, by its name
        names: list[bytes] = []
        first: list[int] = []
        chunks = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunks
            values = np.concatenate([h for h, _ in held]) >> drop
            owner = np.concatenate([o for _, o in held])
            held.clear()
            order = np.argsort(values)
            values, owner = values[order], owner[order]
            same = np.zeros(len(values), bool)
            same[1:] = values[1:] == values[:-1]
            several = same.copy()
            several[:-1] |= same[1:]
            known = np.bincount(owner[several], minlength=len(names))
            values, owner = values[~same], np.where(several, 0, owner + 1)[~same]  # 0: nobody waits for an answer
            cut = np.append(np.searchsorted(values, edges), len(values))
            ids = np.concatenate([i for i, _ in facts]).astype("<i8").tobytes()
            sizes = np.concatenate([n for _, n in facts]).astype("<i8").tobytes()
            facts.clear()
            chunk = f"{TaskContext.get().partitionId()}-{chunks}-{xxhash.xxh3_64_hexdigest(ids)}"
            chunks += 1
            rows = [(b, pack_sorted(values[s:e]), planes(owner[s:e])) for b, s, e in zip(range(buckets), cut[:-1].tolist(), cut[1:].tolist()) if s < e]
            rows.append((xxhash.xxh3_64_intdigest(chunk) % buckets, None, None))
            own = [None] * (len(rows) - 1)
            columns = {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "chunk": pa.array([chunk] * len(rows)),
                "hashes": pa.array([r[1] for r in rows], pa.binary()),
                "owner": pa.array([r[2] for r in rows], pa.binary()),
                "ids": pa.array([*own, ids], pa.binary()),
                "sizes": pa.array([*own, sizes], pa.binary()),
                "names": pa.array([*own, b"".join(names)], pa.binary()),
                "first": pa.array([*own, np.array(first, "<i8").tobytes()], pa.binary()),
                "known": pa.array([*own, known.astype("<i8").tobytes()], pa.binary()),
            }
            names.clear(), first.clear(), places.clear()
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            for row, last, padded, offsets in blocks(batch.column("text")):
                hashes, cut = shingle_sets(padded, offsets, k)
                base = len(names)
                names += [set_name(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                first += [places.setdefault(name, base + i) for i, name in enumerate(names[base:])]
                owner = base + np.repeat(np.arange(last - row), np.diff(cut))
                dealt = np.array(first[base:])[owner - base] == owner
                held.append((hashes[dealt], owner[dealt]))
                facts.append((doc_ids[row:last], np.diff(cut)))
                if sum(len(h) for h, _ in held) > HELD_TOKENS or len(names) > HELD_TOKENS // 8:
                    yield from flush()
        if facts:
            yield from flush()

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        facts = group[group.hashes.isna()][["chunk", "ids", "sizes", "names", "first", "known"]].assign(owner=None, shared=None)
        group = group[group.hashes.notna()]
        if not len(group):
            return facts
        values = [unpack_sorted(x) for x in group.hashes]
        lengths = np.array([len(v) for v in values])
        values = np.concatenate(values)
        order = np.argsort(values)
        values = values[order]
        same = np.zeros(len(values), bool)
        same[1:] = values[1:] == values[:-1]
        same[:-1] |= same[1:]
        back = np.empty(len(values), bool)
        back[order] = same
        rows = []
        for chunk, owner, a, n in zip(group.chunk, group.owner, np.cumsum(lengths) - lengths, lengths):
            asked = from_planes(owner)[back[a : a + n]]
            documents, counts = np.unique(asked[asked > 0], return_counts=True)
            if len(documents):
                rows.append((chunk, None, None, None, None, None, planes(np.diff(documents, prepend=np.uint32(0))), planes(counts)))
        counts = pd.DataFrame(rows, columns=["chunk", "ids", "sizes", "names", "first", "known", "owner", "shared"])
        return pd.concat([facts, counts], ignore_index=True) if len(facts) else counts

    def gather(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        own = group[group.ids.notna()].iloc[0]
        ids, sizes, first, known = (np.frombuffer(own[c], "<i8") for c in ("ids", "sizes", "first", "known"))
        shared = known.copy()
        for owner, counts in zip(*(group[c].dropna() for c in ("owner", "shared"))):
            shared[np.cumsum(from_planes(owner)) - 1] += from_planes(counts)
        names = [own["names"][i : i + 16] for i in range(0, 16 * len(ids), 16)]
        return pd.DataFrame({"doc_id": ids, "n": sizes, "name": names, "shared": shared[first]})

    sent = bounded(docs).select("doc_id", "text").mapInArrow(
        tidy(send), "bucket int, chunk string, hashes binary, owner binary, ids binary, sizes binary, names binary, first binary, known binary"
    )
    counted = sent.groupBy("bucket").applyInPandas(
        tidy_group(count), "chunk string, ids binary, sizes binary, names binary, first binary, known binary, owner binary, shared binary"
    )
    facts = counted.groupBy("chunk").applyInPandas(tidy_group(gather), "doc_id long, n long, name binary, shared long")
    facts = facts.groupBy("doc_id").agg(F.max(F.struct("n", "name")).alias("set"), F.sum("shared").alias("shared"), F.count("*").alias("rows"))
    return facts.select("doc_id", "set.n", "set.name", "shared", "rows")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """doc_id, n and the sorted shingles of the wanted (doc_id, name)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, last, padded, offsets in blocks(batch.column("text")):
                hashes, cut = shingle_sets(padded, offsets, k)
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                ids, names = batch.column("doc_id").slice(row, last - row), batch.column("name").slice(row, last - row)
                keep = [i for i, (a, b) in enumerate(spans) if set_name(hashes[a:b]) == names[i].as_py()]
                sets = [hashes[a:b].view(np.int64) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep, pa.int64())), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i] for i in keep], pa.list_(pa.int64()))],
                    ["doc_id", "n", "tokens"],
                )

    few = wanted.count() <= BROADCAST_ROWS  # 24 bytes a row; more are joined by a shuffle
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id")
    return texts.mapInArrow(tidy(build), "doc_id long, n long, tokens array<long>")


def lists_of(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values as lists, by their ascending row numbers."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def prefixes(sets: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """doc_id, n, own (shingles that no other set has), shared (the others), prefixes and hub keys of sets that can link.

    `one` is the prefix under the order by frequency, `two` and `three` those under the
    orders by hash; `keys` are the first shared tokens of these. Tokens of one's own
    count in a prefix and match nothing, so they are left out of it.
    """
    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    tokens = tokens.dropDuplicates(["token", "doc_id"]) if repeated else tokens
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    rows = tokens.join(frequency, "token").groupBy("doc_id", "n").agg(F.collect_list("token").alias("token"), F.collect_list("df").alias("df"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            token = batch.column("token").flatten().to_numpy()
            df = batch.column("df").flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), pa.compute.list_value_length(batch.column("token")).to_numpy())
            need = -(-n * percent // 100)
            n_shared = np.bincount(row, weights=df > 1, minlength=len(n)).astype(np.int64)
            kept = np.flatnonzero(n_shared >= need)
            again = np.full(len(n), -1)
            again[kept] = np.arange(len(kept))
            inside = again[row] >= 0
            row, token, df = again[row[inside]], token[inside], df[inside]
            longest, own = (n - need + 1)[kept], (n - n_shared)[kept]
            start = np.searchsorted(row, np.arange(len(kept)))
            place = np.arange(len(row)) - start[row]

            def first(hashed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
                order = np.lexsort((token, df, row) if hashed is None else (hashed, row))
                there = (place < longest[row]) & (df[order] > 1)
                return row[there], token[order][there]

            keys, heads = [], [first(None)]
            for seed in SEEDS:
                hashed = mixed(token.view(np.uint64) ^ seed)
                heads.append(first(hashed))
                among = np.flatnonzero(df > 1)
                order = among[np.lexsort((hashed[among], row[among]))]
                keys.append(token[order][np.searchsorted(row[order], np.arange(len(kept)))])
            among = df > 1
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(kept)),
                "n": pa.array(n[kept]),
                "own": pa.array(own),
                "shared": lists_of(row[among], token[among], len(kept)),
                **{c: lists_of(*h, len(kept)) for c, h in zip(("one", "two", "three"), heads)},
                "keys": lists_of(np.repeat(np.arange(len(kept)), len(keys)), np.stack(keys, 1).ravel() if len(kept) else token[:0], len(kept)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    lists = ", ".join(f"{c} array<long>" for c in ("shared", "one", "two", "three", "keys"))
    return rows.mapInArrow(tidy(cut), f"doc_id long, n long, own long, {lists}")


def verified(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda s, *lists: heads.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in lists])
    lists = ("two", "three", "shared")
    met = pairs.select("a", "b").join(side("a", *lists), "a").join(side("b", *lists), "b")
    met = met.where(F.arrays_overlap("two_a", "two_b") & F.arrays_overlap("three_a", "three_b"))
    common = F.size(F.array_intersect("shared_a", "shared_b"))
    return met.where(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent).select("a", "b")


def near_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def pair_of(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links_with_hubs(heads: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets with the hub of each of their keys: of the sets with the key, the one with the least part of its own."""
    keys = heads.select("doc_id", "n", "own", F.explode("keys").alias("key"))
    rank = F.struct((F.col("own") / F.col("n")).alias("apart"), F.col("doc_id"), F.col("n"))
    hubs = keys.groupBy("key").agg(F.min(rank).alias("h"), F.count("*").alias("m")).where("m > 1")
    met = keys.join(hubs.select("key", F.col("h.doc_id").alias("hub"), F.col("h.n").alias("hub_n")), "key")
    met = met.where((F.col("doc_id") != F.col("hub")) & near_sizes(F.col("n"), F.col("hub_n"), percent))
    return verified(met.select(*pair_of("doc_id", "hub")).distinct(), heads, percent)


def links_between(heads: DataFrame, component: DataFrame, percent: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """All links (a, b) of sets in different components (doc_id, component)."""
    entries = heads.select("doc_id", "n", "own", "one").join(component, "doc_id", "left")
    entries = entries.select("doc_id", "n", "own", F.coalesce("component", "doc_id").alias("component"), F.posexplode("one").alias("pos", "token"))
    entries = entries.withColumn("left", F.col("n") - F.col("own") - F.col("pos")).drop("own", "pos")
    groups = entries.groupBy("token", "component").agg(F.count("*").alias("m"))
    open_lists = groups.groupBy("token").agg(F.sum("m").alias("m"), F.max_by("component", F.struct("m", "component")).alias("top"), F.count("*").alias("parts"))
    open_lists = open_lists.where("parts > 1").select("token", "top", F.ceil(F.col("m") / list_rows).cast("int").alias("slices"))
    entries = entries.join(open_lists, "token")
    slices = F.sequence(F.lit(0), F.col("slices") - 1)
    asks = entries.where("component <> top").withColumn("slice", F.explode(slices))
    there = entries.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices")).cast("int"))
    x = asks.select("token", "slice", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "component", "n", "left")])
    y = there.select("token", "slice", "top", *[F.col(c).alias(f"{c}_y") for c in ("doc_id", "component", "n", "left")])
    least = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    # The first shared token of a link leaves both sets enough to share.
    fits = near_sizes(F.col("n_x"), F.col("n_y"), percent) & (F.least("left_x", "left_y") >= least)
    once = (F.col("component_y") == F.col("top")) | (F.col("doc_id_x") < F.col("doc_id_y"))
    same_slice = F.col("token_x").eqNullSafe(F.col("token")) & (F.col("slice_x") == F.col("slice"))
    met = x.withColumnsRenamed({"token": "token_x", "slice": "slice_x"}).join(
        y, same_slice & (F.col("component_x") != F.col("component_y")) & once & fits
    )
    return verified(checkpointed(met.select(*pair_of("doc_id_x", "doc_id_y")).distinct()), heads, percent)


def component_of(sets: DataFrame, percent: int, repeated: bool = False, list_rows: int = LIST_ROWS) -> DataFrame:
    """(id, component) of the distinct sets that link with any."""
    heads = checkpointed(prefixes(sets, percent, repeated))
    near = components(links_with_hubs(heads, percent))
    far = links_between(heads, near.withColumnRenamed("id", "doc_id"), percent, list_rows)
    return components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(far))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    facts = checkpointed(set_facts(docs, k))
    # Any member's count of shared shingles is at least that of the class.
    classes = facts.where("n > 0").groupBy("name", "n").agg(F.min("doc_id").alias("doc_id"), F.min("shared").alias("shared"))
    wanted = classes.where(F.col("shared") >= needed(F.col("n"), percent)).select("doc_id", "name")
    repeated = not facts.where("rows > 1").isEmpty()
    merged = component_of(sets_of(docs, wanted, k), percent, repeated, list_rows).withColumnRenamed("id", "first")
    rows = facts.join(classes.select("name", F.col("doc_id").alias("first")), "name", "left")
    rows = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc_id")).alias("first"))
    rows = rows.join(merged, "first", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
