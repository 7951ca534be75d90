"""Best-fit packing of token sequences by patterns of lengths.

Pieces of documents are packed into sequences of at most `size` tokens. Only the
histogram of piece lengths (at most `size` numbers, whatever the corpus) is
planned on the driver:

1. lengths are put into coarse bins and all patterns of up to `depth` bins that
   fill a sequence are enumerated;
2. non-negative least squares fits how often to repeat each pattern so that the
   patterns use up the histogram; repeats are rounded down;
3. patterns are filled with the longest lengths of their bins, and the residual
   pieces go, longest first, to the open sequence that they fit best, or to a new one.

The plan says, for each length, which ranks of its pieces go to which sequences
and offsets. Pieces are ranked within their length in two levels (slices, then
rows), so that a length with a large share of the rows is no single group, and
join the plan.

Defined results: null text is empty, one piece with the end id alone; equal rows
are packed each; documents longer than a sequence are cut, others are never cut;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.llm.text import WORD_BYTE, blocks, bounded, span_hashes, spans, tidy
from kinmap.session import checkpointed

TOKENIZER = "word_bpe_49k.json"
SIZE = 4096
END_ID = 1
DEPTH = 3
BINS = 64
ROWS_PER_SLICE = 65536
CACHE_WORDS = 800_000
ENCODED_AT_ONCE = 4096
BLOCK_BYTES = 4 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class WordIds:
    """Token ids of words between ASCII white space, which this tokenizer never joins over.

    Words met before are kept by hash, in sorted order; the cache starts anew when full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, keys: np.ndarray, words: list[str]) -> None:
        flat, length = [self.flat], []
        for k in range(0, len(words), ENCODED_AT_ONCE):  # an encoding takes a hundred times the room of its ids
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(words[k : k + ENCODED_AT_ONCE], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum())))
            length.append(counts)
        length = np.concatenate(length)
        begin = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.begin = np.insert(self.begin, place, begin)
        self.length = np.insert(self.length, place, length)

    def ids(self, padded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows and the number of ids of each row."""
        n = len(offsets) - 1
        starts, ends, rows = spans(WORD_BYTE[padded], offsets)
        keys, index, inverse = np.unique(span_hashes(padded, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = padded.tobytes()
            self.add(keys[new], [data[a:b].decode("utf-8") for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist())])
        at = np.searchsorted(self.keys, keys)[inverse]
        length, begin = self.length[at], self.begin[at]
        total = int(length.sum())
        shift = np.cumsum(length) - length
        flat = self.flat[np.repeat(begin - shift, length) + np.arange(total)]
        return flat, np.bincount(rows, weights=length, minlength=n).astype(np.int64)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, last, padded, offsets in blocks(batch.column("text"), BLOCK_BYTES):
                flat, counts = encoder.ids(padded, offsets)
                lengths = counts + 1
                cuts = -(-lengths // size)
                doc = np.repeat(np.arange(last - row), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * size
                length = np.minimum(size, lengths[doc] - start)
                base = np.cumsum(counts) - counts
                little = flat.astype("<u4").view(np.uint8).data
                end = int(end_id).to_bytes(4, "little")
                crc = np.empty(len(doc), np.int64)
                for k, (d, s, n) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                    closes = s + n == lengths[d]
                    a = 4 * (base[d] + s)
                    value = zlib.crc32(little[a : a + 4 * (n - closes)])
                    crc[k] = zlib.crc32(end, value) if closes else value
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(row, last - row).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return bounded(docs).select("doc_id", "text").mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-8 * max(1.0, float(np.abs(b).max())):
            return x
        free[best] = True
        while True:
            trial = np.zeros_like(x)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 1e-10)
            if not low.any():
                x = trial
                break
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x = x + min(1.0, step) * (trial - x)
            free &= x > 1e-10
            x[~free] = 0.0
            if not free.any():
                break
    return x


def plan(histogram: np.ndarray, size: int = SIZE, depth: int = DEPTH, bins: int = BINS) -> list[tuple[int, list[int]]]:
    """(repeats, lengths in order) of the sequences; histogram[n] is the number of pieces of length n."""
    left = histogram.astype(np.int64).copy()
    width = -(-size // bins)
    bin_of = -(-np.arange(size + 1) // width)  # a bin holds the lengths up to its number times width
    open_rows: list[tuple[int, list[int], int]] = []  # repeats, lengths, room

    patterns = [p for d in range(1, depth + 1) for p in combinations_with_replacement(range(bins, 0, -1), d) if sum(p) == bins]
    matrix = np.zeros((bins + 1, len(patterns)))
    for k, p in enumerate(patterns):
        for part in p:
            matrix[part, k] += 1
    totals = np.bincount(bin_of, weights=left, minlength=bins + 1)
    weight = np.arange(bins + 1) / bins  # what a long piece leaves over costs more than what a short one does
    repeats = np.floor(nnls(matrix * weight[:, None], totals * weight) + 1e-6).astype(np.int64)
    longest = {b: [n for n in range(min(size, b * width), (b - 1) * width, -1) if left[n]] for b in range(1, bins + 1)}
    for k in np.argsort(-repeats):
        count = int(repeats[k])
        while count > 0:
            lengths: list[int] = []
            for part in patterns[k][:-1]:
                of = longest[part]
                while of and left[of[0]] <= lengths.count(of[0]):
                    of.pop(0)
                pick = next((n for n in of if left[n] > lengths.count(n)), None)
                if pick is None:
                    break
                lengths.append(pick)
            if len(lengths) + 1 == len(patterns[k]):
                # The last part is the longest piece that still fits, which its bin only foretold.
                fits = np.flatnonzero(left[: size - sum(lengths) + 1])[::-1]
                pick = next((int(n) for n in fits[:depth] if left[n] > lengths.count(n)), None)
                lengths += [] if pick is None else [pick]
            if len(lengths) < len(patterns[k]):
                break
            times = min(count, *(int(left[n]) // lengths.count(n) for n in lengths))
            for n in lengths:
                left[n] -= times
            open_rows.append((times, lengths, size - sum(lengths)))
            count -= times

    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    for times, lengths, room in open_rows:
        by_room.setdefault(room, []).append((times, lengths))
    rooms = np.zeros(size + 1, bool)
    rooms[list(by_room)] = True
    for n in range(size, 0, -1):
        while left[n]:
            tight = n + int(np.argmax(rooms[n:])) if rooms[n:].any() else None
            if tight is None:
                each = size // n  # new sequences of this length alone, the last one partly filled
                full, rest = divmod(int(left[n]), each)
                for times, fill in ((full, each), (1, rest)):
                    if times and fill:
                        room = size - n * fill
                        by_room.setdefault(room, []).append((times, [n] * fill))
                        rooms[room] = True
                left[n] = 0
                break
            times, lengths = by_room[tight].pop()
            fill = min(tight // n, int(left[n]))
            used = min(times, int(left[n]) // fill)
            if used < times:
                by_room[tight].append((times - used, lengths))
            if not by_room[tight]:
                rooms[tight] = False
            room = tight - n * fill
            by_room.setdefault(room, []).append((used, [*lengths, *[n] * fill]))
            rooms[room] = True
            left[n] -= used * fill
    return [(times, lengths) for entries in by_room.values() for times, lengths in entries]


def slots(packed: list[tuple[int, list[int]]], size: int = SIZE) -> pd.DataFrame:
    """For each length, which ranks go where: rank r is at `sequence` + (r - `low`) // `each`, with offsets by length."""
    rows, used, sequence = [], np.zeros(size + 1, np.int64), 0
    for times, lengths in packed:
        offset, k = 0, 0
        while k < len(lengths):
            n, each = lengths[k], 1
            while k + each < len(lengths) and lengths[k + each] == n:
                each += 1
            low = int(used[n])
            used[n] += times * each
            rows.append((n, low, low + times * each, each, sequence, offset))
            offset += n * each
            k += each
        sequence += times
    frame = pd.DataFrame(rows, columns=["s_length", "low", "high", "each", "sequence", "place"])
    return frame.astype("int64")


def best_fit_pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = pieces(docs, path or default_path(), size, end_id)
    order = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    found = checkpointed(found.withColumn("order", order))  # small rows; texts are tokenized once
    rows = found.groupBy("length").count().collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in rows:
        histogram[r.length] = r["count"]
    spark = docs.sparkSession
    per_slice = max(1, -(-int(histogram.max()) // ROWS_PER_SLICE))
    found = found.withColumn("slice", F.pmod("order", F.lit(per_slice)))
    in_slices = found.groupBy("length", "slice").count()
    earlier = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = in_slices.select(
        F.col("length").alias("f_length"), F.col("slice").alias("f_slice"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("length", "slice").orderBy("order", "doc_id", "piece")
    ranked = found.withColumn("nth", F.row_number().over(inside) - 1).join(
        first, (F.col("length") == F.col("f_length")) & (F.col("slice") == F.col("f_slice"))
    )
    ranked = ranked.withColumn("rank", F.col("first") + F.col("nth"))
    table = slots(plan(histogram, size), size)
    # One row a length: its places in order of rank, found by a filter over few entries.
    entry = F.struct("low", "high", "each", "sequence", "place")
    places = spark.createDataFrame(table, "s_length long, low long, high long, each long, sequence long, place long")
    wide = max(1, int(table.groupby("s_length").size().max()) // 64) if len(table) else 1
    step = max(1, -(-int(histogram.max()) // wide))
    places = places.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step)))
    )
    places = places.groupBy("s_length", "block").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    joined = ranked.withColumn("r_block", F.floor(F.col("rank") / step)).join(
        places, (F.col("length") == F.col("s_length")) & (F.col("r_block") == F.col("block"))
    )
    hit = F.filter("entries", lambda e: (e["low"] <= F.col("rank")) & (F.col("rank") < e["high"]))[0]
    joined = joined.withColumn("hit", hit)
    into = F.col("rank") - F.col("hit.low")
    each = F.col("hit.each")
    return joined.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("hit.sequence") + F.floor(into / each)).cast("long").alias("sequence_id"),
        (F.col("hit.place") + (into % each) * F.col("length")).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
