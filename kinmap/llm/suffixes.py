"""Suffix-array dedup: exact repeated byte strings by a difference cover.

A byte is removed when a string of `length` bytes that covers it also starts in a
document with a smaller doc_id. The steps are those of the difference-cover
construction of a suffix array, of whose order only equality of the first
`length` bytes of neighbours is needed; the order is that of 64-bit hashes, in
which equal strings are neighbours as in any other.

1. Sample: positions whose remainder modulo 31 lies in a difference cover of 6
   remainders. Of any two places, at the same shift below 31, both are sampled;
   so two equal strings of 50 bytes hold a sampled triple of words (8 + 8 + 4
   bytes) at the same shift. Triples are sorted in buckets, and those that stand
   in two documents get into a table of names. All others are unique and leave
   the recursion, with all strings that hold no other triple.
2. Recurse: the strings that hold a named triple at some shift, which is few of
   all, are named by all their bytes and sorted in buckets.
3. Merge and compare: neighbours of equal names in different documents get into a
   table with their least doc_id. A last pass over the texts looks up the strings
   of step 2 and removes what the table gives to a smaller document.

Tasks combine equal names before sending, so a passage that stands everywhere is
one entry a task. Names in step 1 get as many bits as the corpus needs, as a
wrongly shared triple only costs work; strings in steps 2 and 3 have 64 bits.
Equal texts are one class first: only the least doc_id of each goes through the
steps, and the others lose all their bytes, if they have `length` at least.

The tables are sorted hash arrays in the shared folder, mapped into memory, and
each task touches what its texts need; texts themselves are never shuffled.

Defined results: null text is empty; rows without doc_id are left out; rows that
share a doc_id lose only what stands in smaller ones; texts shorter than the
length lose nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.tables import Arrays, for_all_buckets, least_type, new_folder, runs, saved
from kinmap.llm.text import blocks, bounded, load64, mixed, pack_sorted, tidy, tidy_group, unpack_sorted

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
SPARE_BITS = 8
HELD = 4_000_000
BUCKET_BYTES = 12 << 20
BLOCK_BYTES = 1 << 19


@dataclass(frozen=True)
class Setting:
    folder: str
    buckets: int
    bits: int
    length: int


def spans_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the `length` bytes from each position on."""
    out = np.full(len(at), np.uint64(length))
    for k in range(0, length - 7, 8):
        out = mixed(out) ^ words[at + k]
    if length % 8:
        out = mixed(out) ^ (words[at + length - length % 8] & np.uint64((1 << 8 * (length % 8)) - 1))
    return mixed(out)


def bucket_by_range(values: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Buckets of equal ranges of numbers of so many bits, in their order; by the upper 32 bits, so fewer than 2^32 buckets."""
    upper = min(bits, 32)
    return ((values >> np.uint64(bits - upper)) * np.uint64(buckets) >> np.uint64(upper)).astype(np.int64)


class Texts:
    """Blocks of texts, without copies of smaller documents."""

    def __init__(self, setting: Setting):
        self.setting = setting
        self.tables = Arrays(setting.folder, setting.buckets)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        self.cover = cover

    def originals(self, padded: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each row is the least document with its text."""
        keys, check = text_names(padded, offsets)
        least, other, there = self.tables.find("copy", bucket_by_range(keys, self.setting.buckets), keys, "least", "check", "there")
        return (there == 0) | (other.view(np.uint64) != check) | (least == ids)

    def samples(self, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions of the rows with a whole string left, and their rows."""
        sizes = np.diff(offsets)[rows]
        rows = rows[sizes >= self.setting.length]
        sizes = sizes[sizes >= self.setting.length]
        triple = self.setting.length - PERIOD + 1
        owner = np.repeat(rows, sizes)
        local = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = self.cover[local % PERIOD] & (local <= np.repeat(sizes, sizes) - triple)
        owner, local = owner[keep], local[keep]
        return offsets[owner] + local, owner

    def triples(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        length = self.setting.length - PERIOD + 1
        return spans_hash(words, at, length) >> np.uint64(64 - self.setting.bits)

    def strings(self, padded: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, rows and names of the strings that hold a named triple."""
        words = load64(padded)
        at, owner = self.samples(offsets, rows)
        values, inverse = np.unique(self.triples(words, at), return_inverse=True)
        s = self.setting
        named = self.tables.has("triple", bucket_by_range(values, s.buckets, s.bits), values)[inverse]
        at, owner = at[named], owner[named]
        # Every string from 30 bytes before such a triple up to it, within the row.
        size = int(offsets[-1])
        marks = np.zeros(size + 2, np.int32)
        np.add.at(marks, np.maximum(at - PERIOD + 1, offsets[owner]), 1)
        np.add.at(marks, at + 1, -1)
        inside = np.cumsum(marks[:size]) > 0
        place = np.flatnonzero(inside)
        row = np.searchsorted(offsets, place, "right") - 1
        whole = place + s.length <= offsets[row + 1]
        place, row = place[whole], row[whole]
        return place, row, spans_hash(words, place, s.length)


def text_names(padded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of each row's name."""
    digests = b"".join(xxhash.xxh3_128_digest(padded[a:b].data) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
    return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def batches_of(texts: Texts, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        doc_ids = batch.column("doc_id").to_numpy()
        for row, last, padded, offsets in blocks(batch.column("text"), BLOCK_BYTES):
            yield padded, offsets, doc_ids[row:last]


def combined(values: np.ndarray, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order with their least id and whether they stand in several documents."""
    order = np.argsort(values)
    values, ids, many = values[order], ids[order], many[order]
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    if not len(new):
        return values, ids, many
    least, most = np.minimum.reduceat(ids, new), np.maximum.reduceat(ids, new)
    return values[new], least, np.logical_or.reduceat(many, new) | (least != most)


def packed_names(values: np.ndarray, ids: np.ndarray, many: np.ndarray, with_ids: bool) -> tuple[bytes, bytes, bytes, bytes]:
    names, short = np.unique(ids, return_inverse=True) if with_ids else (ids[:0], ids[:0])
    planes = np.ascontiguousarray(short.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    # Entropy coding takes the half-empty planes, which Spark's own compression leaves.
    pack = zstandard.ZstdCompressor(level=1).compress
    return pack(pack_sorted(values)), pack(planes), pack(pack_sorted(names.astype("<i8").view(np.uint64))), pack(np.packbits(many).tobytes())


def unpacked_names(group: pd.DataFrame, with_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, ids and flags of all blobs of a bucket; without ids, each blob stands for its own document."""
    values, ids, many = [], [], []
    unpack = zstandard.ZstdDecompressor().decompress
    values.append(np.zeros(0, np.uint64)), ids.append(np.zeros(0, np.int64)), many.append(np.zeros(0, bool))
    group = group[group["names"].notna()]
    for k, (v, planes, names, flags) in enumerate(zip(group["names"], group["owner"], group["ids"], group["many"])):
        values.append(unpack_sorted(unpack(v)))
        if with_ids:
            short = np.ascontiguousarray(np.frombuffer(unpack(planes), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            ids.append(unpack_sorted(unpack(names)).view(np.int64)[short])
        else:
            ids.append(np.full(len(values[-1]), k, np.int64))
        many.append(np.unpackbits(np.frombuffer(unpack(flags), np.uint8), count=len(values[-1])).astype(bool))
    return np.concatenate(values), np.concatenate(ids), np.concatenate(many)


SENT = "bucket int, names binary, owner binary, ids binary, many binary"


def send(held: list[tuple], setting: Setting, bits: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has names; what blocks hold, sorted by value, is combined bucket by bucket, so nothing is copied as a whole."""
    parts = [(b, start, end, k) for k, h in enumerate(held) for b, start, end in runs(bucket_by_range(h[0], setting.buckets, bits))]
    for b, found in groupby(sorted(parts), itemgetter(0)):
        slices = [[x[start:end] for x in held[k]] for _, start, end, k in found]
        row = packed_names(*combined(*map(np.concatenate, zip(*slices))), with_ids)
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([x], pa.binary()) for x in row]], ["bucket", "names", "owner", "ids", "many"])
    held.clear()


def name_copies(docs: DataFrame, setting: Setting) -> None:
    """The table of texts that several documents have, with the least of them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for padded, offsets, ids in batches_of(None, batches):
            keys, check = text_names(padded, offsets)
            bucket = bucket_by_range(keys, setting.buckets).astype(np.int32)
            columns = [pa.array(bucket), pa.array(keys.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids)]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "check", "doc_id"])

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Of texts whose first halves agree one gets into the table; the others' copies go through all steps.
        group = group[group.real].drop_duplicates("key")
        keys = group.key.to_numpy().view(np.uint64)
        order = np.argsort(keys)
        least, check = (group[c].to_numpy()[order] for c in ("least", "check"))
        saved(setting.folder, "copy", key[0], key=keys[order], least=least, check=check, there=np.ones(len(keys), np.uint8))
        return pd.DataFrame({"n": [len(keys)]})

    keys = docs.mapInArrow(tidy(digest), "bucket int, key long, check long, doc_id long")
    copies = keys.groupBy("bucket", "key", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = for_all_buckets(copies.select("bucket", "key", "check", "least", F.lit(True).alias("real")), setting.buckets)
    copies = copies.na.fill(0, ["key", "check", "least"]).na.fill(False, ["real"])  # pandas makes floats of numbers with nulls
    copies.groupBy("bucket").applyInPandas(write, "n long").agg(F.sum("n")).collect()


def name_triples(docs: DataFrame, setting: Setting) -> None:
    """The table of sampled triples that stand in several documents."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = Texts(setting), []
        for padded, offsets, ids in batches_of(texts, batches):
            at, owner = texts.samples(offsets, np.flatnonzero(texts.originals(padded, offsets, ids)))
            held.append(combined(texts.triples(load64(padded), at), ids[owner], np.zeros(len(at), bool)))
            if sum(len(h[0]) for h in held) > HELD:
                yield from send(held, setting, setting.bits, False)
        if held:
            yield from send(held, setting, setting.bits, False)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, _, many = combined(*unpacked_names(group, False))
        saved(setting.folder, "triple", key[0], key=values[many])
        return pd.DataFrame({"n": [int(many.sum())]})

    sent = for_all_buckets(docs.mapInArrow(tidy(sample), SENT), setting.buckets)
    sent.groupBy("bucket").applyInPandas(tidy_group(write), "n long").agg(F.sum("n")).collect()


def name_strings(docs: DataFrame, setting: Setting) -> None:
    """The table of strings that stand in several documents, with the least of these."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, held = Texts(setting), []
        for padded, offsets, ids in batches_of(texts, batches):
            _, row, names = texts.strings(padded, offsets, np.flatnonzero(texts.originals(padded, offsets, ids)))
            held.append(combined(names, ids[row], np.zeros(len(row), bool)))
            if sum(len(h[0]) for h in held) > HELD:
                yield from send(held, setting, 64, True)
        if held:
            yield from send(held, setting, 64, True)

    def write(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        values, least, many = combined(*unpacked_names(group, True))
        least = least[many]
        names, short = np.unique(least, return_inverse=True)
        saved(setting.folder, "string", key[0], key=values[many], least=least_type(short), names=names)
        return pd.DataFrame({"n": [int(many.sum())]})

    sent = for_all_buckets(docs.mapInArrow(tidy(collect), SENT), setting.buckets)
    sent.groupBy("bucket").applyInPandas(tidy_group(write), "n long").agg(F.sum("n")).collect()


def tables_for(docs: DataFrame, length: int = LENGTH) -> Setting:
    if len({(a - b) % PERIOD for a in COVER for b in COVER}) != PERIOD:
        raise ValueError("the remainders are no difference cover")
    if length < PERIOD + 7:
        raise ValueError(f"strings need at least {PERIOD + 7} bytes")
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    buckets = max(1, -(-size // BUCKET_BYTES))
    bits = min(64, math.ceil(math.log2(size * len(COVER) / PERIOD + 2)) + SPARE_BITS)
    setting = Setting(new_folder(docs.sparkSession, "strings"), buckets, bits, length)
    name_copies(docs, setting)
    name_triples(docs, setting)
    name_strings(docs, setting)
    return setting


def removed_spans(texts: Texts, padded: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which bytes of a block are removed."""
    s = texts.setting
    size = int(offsets[-1])
    original = texts.originals(padded, offsets, ids)
    place, row, names = texts.strings(padded, offsets, np.flatnonzero(original))
    values, inverse = np.unique(names, return_inverse=True)
    least = np.full(len(values), np.iinfo(np.int64).max)
    for there, at, found in texts.tables.hits("string", bucket_by_range(values, s.buckets), values):
        least[at] = there["names"][there["least"][found]]
    hit = place[least[inverse] < ids[row]]
    marks = np.zeros(size + 1, np.int32)
    np.add.at(marks, hit, 1)
    np.add.at(marks, hit + s.length, -1)
    removed = np.cumsum(marks[:size]) > 0
    for k in np.flatnonzero(~original & (np.diff(offsets) >= s.length)).tolist():
        removed[offsets[k] : offsets[k + 1]] = True
    return removed


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and with_text what is kept.

    The kept text drops bytes of characters that were removed in part. Columns to
    carry are passed through.
    """
    docs = docs.select("doc_id", "text", *carry).where("doc_id IS NOT NULL")
    setting = tables_for(bounded(docs).select("doc_id", "text"), length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = Texts(setting)
        for batch in batches:
            row = 0
            for padded, offsets, ids in batches_of(texts, iter([batch])):
                removed = removed_spans(texts, padded, offsets, ids)
                rows = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    gone, data = removed[a:b], padded[a:b]
                    n = int(gone.sum())
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (b > a and gone[0]))
                    kept = (data[~gone] if n else data).tobytes()
                    text = kept.decode("utf-8", "ignore") if with_text else None
                    rows.append((b - a, n, spans, hashlib.sha256(kept).hexdigest(), text))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                count = 5 if with_text else 4
                carried = [batch.column(c).slice(row, len(ids)) for c in carry]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *made[:count], *carried], ["doc_id", *names[:count], *carry])
                row += len(ids)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept string" * with_text + "".join(f", `{c}` {t}" for c, t in docs.dtypes if c in carry)
    return docs.mapInArrow(tidy(remove), schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
