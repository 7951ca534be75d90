"""Language-model scores: an interpolated, modified Kneser-Ney model of word triples or pairs.

Words, pairs and triples are known by 64-bit hashes. Tasks count the triples of their
texts and send them, combined, to buckets by their last two words, so the pairs of a
frequent word are spread over all buckets. A bucket sums its triples and writes

* pairs: their counts and their numbers of different words before; pairs that stand
  once are a list of their own without numbers;
* triples that stand `cutoff` times at least, with their counts.

It sends on, summed, what other buckets need: to the bucket of a triple's first pair
how its triples count, to that of a pair's first word how often it goes on and to how
many, and to that of its last word its count and number of words before it. These are
written as tables too. Scoring workers map the tables into memory from the shared
folder and look words up by binary search, so that a worker touches what its texts need.

What is sent names frequent words by codes of two bytes and only others by their hashes.
Sent tables get smaller and more as the corpus grows, and lists of words' hashes in each
would make what is sent grow faster than the corpus. Codes are fitted on a bounded sample
of texts (`CODE_BYTES`); they only shorten rows, and no count or score depends on them.

    p(w|u,v) = (c(u,v,w) - D)+ / c(u,v) + g(u,v) p(w|v)
    p(w|v)   = (b(v,w) - E)+ / sum b(v,.) + g(v) p(w)
    p(w)     = (b(w) - E')+ / sum b + g' / (V + 1)

with b the number of different words before, one discount each for counts 1, 2 and
3 or more, and one share of the last term for all unknown words. Triples below the
cutoff (2: most triples stand once, and would take more room than the texts) are
discounted wholly: their share goes to p(w|v), and the model still sums to one.
Cutoff 1 keeps all triples. With order 2, the default, there are no triples and
p(w|v) has counts for b; nothing is cut off. Order 3 takes more disk than the
registered query may (figures in the README).

Defined results: null text is empty and its only token is the end; with nothing to
learn from, all words are unknown; repeated rows are counted and scored each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.tables import Arrays, for_all_buckets, least_type, mapped, new_folder, runs, saved
from kinmap.llm.text import blocks, bounded, mixed, pack_sorted, tidy, tidy_group, unpack_sorted, word_hashes

START, END = np.uint64(1), np.uint64(2)
ORDER, CUTOFF = 2, 2
BUCKET_BYTES = 16 << 20
HELD_TOKENS = 2_000_000
#: Words with codes, the code that stands for all others, and about how many bytes of texts the codes are fitted on.
CODES, NO_CODE, CODE_BYTES = 65535, np.uint64(65535), 16 << 20
#: What is counted over all buckets: triples and pairs in all, and those with 1 to 4.
STATS = [*[f"{c}{k}" for c in ("t", "p", "b") for k in (1, 2, 3, 4)], "words", "tokens", "before"]


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 7 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


def triple_hash(first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    return mixed(pair ^ mixed(first + np.uint64(0x94D049BB133111EB)))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(buckets)).astype(np.int64)


def token_triples(padded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word two before, word before, word, row) of all tokens: each row's words, then its end."""
    n = len(offsets) - 1
    words, rows = word_hashes(padded, offsets)
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    third = np.full(len(words) + n, END)
    plain = np.ones(len(third), bool)
    plain[ends] = False
    third[plain] = words
    second, first = np.full_like(third, START), np.full_like(third, START)
    inner = np.ones(len(third), bool)
    inner[ends - counts] = False  # tokens that another of their row comes before
    at = np.flatnonzero(inner)
    second[at] = third[at - 1]
    first[at] = second[at - 1]
    return first, second, third, np.repeat(np.arange(n), counts + 1)


def summed(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and the sums over each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[new], order[new], [np.add.reduceat(s[order], new) if len(new) else s[:0] for s in sums]


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers byte plane by byte plane: the empty planes vanish in the coding."""
    return np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(packed: bytes, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)


def packed_rows(words: list[np.ndarray], numbers: list[np.ndarray], codes: np.ndarray) -> bytes:
    """Columns of words and of numbers: rows are sorted by the words' codes, words without one are places in a list of these."""
    pack = zstandard.ZstdCompressor(level=1).compress
    key, without = np.zeros(len(words[0]), np.uint64), []
    for k, column in enumerate(words):
        at = np.minimum(np.searchsorted(codes, column), len(codes) - 1)
        without.append(codes[at] != column)
        key |= np.where(without[-1], NO_CODE, at.astype(np.uint64)) << np.uint64(16 * k)
    order = np.argsort(key, kind="stable")
    names, places = np.unique(np.concatenate([w[order][x[order]] for w, x in zip(words, without)]), return_inverse=True)
    blobs = [pack(p) for p in (pack_sorted(key[order]), pack_sorted(names), planes(places, 4), *[planes(n[order], 8) for n in numbers])]
    return np.array([len(b) for b in blobs], "<u4").tobytes() + b"".join(blobs)


def unpacked_rows(packed: bytes, words: int, numbers: int, codes: np.ndarray) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    lengths = np.frombuffer(packed[: 4 * (3 + numbers)], "<u4").astype(np.int64)
    at = 4 * len(lengths) + np.cumsum(lengths) - lengths
    key, names, places, *sums = [unpack(packed[a : a + n]) for a, n in zip(at.tolist(), lengths.tolist())]
    key, names = unpack_sorted(key), unpack_sorted(names)[from_planes(places, 4)]
    columns, used = [], 0
    for k in range(words):
        code = key >> np.uint64(16 * k) & NO_CODE
        without = np.flatnonzero(code == NO_CODE)
        columns.append(codes[np.minimum(code, np.uint64(len(codes) - 1))])
        columns[-1][without] = names[used : used + len(without)]
        used += len(without)
    return columns + [from_planes(n, 8) for n in sums]


def all_rows(blobs: pd.Series, words: int, numbers: int, codes: np.ndarray) -> list[np.ndarray]:
    """The columns of several packed tables, one after the other."""
    parts = [unpacked_rows(b, words, numbers, codes) for b in blobs.dropna()]
    none = [np.zeros(0, np.uint64)] * words + [np.zeros(0, np.int64)] * numbers
    return [np.concatenate(c) for c in zip(*parts)] if parts else none


def dealt(bucket: np.ndarray, words: list[np.ndarray], numbers: list[np.ndarray], codes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    for k, start, end in runs(bucket[order]):
        o = order[start:end]
        yield k, packed_rows([w[o] for w in words], [n[o] for n in numbers], codes)


def frequent_words(docs: DataFrame, size: int) -> np.ndarray:
    """The START, the END and the most frequent words of about CODE_BYTES of texts, chosen by hashes of ids; sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, padded, offsets in blocks(batch.column("text")):
                words, n = np.unique(word_hashes(padded, offsets)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int((1 << 30) * min(1, CODE_BYTES / max(1, size))))
    counts = some.select("text").mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "word").limit(CODES - 2).collect()
    return np.unique(np.append(np.array([r.word for r in rows], np.int64).view(np.uint64), [START, END]))


def classes(values: np.ndarray) -> list[np.ndarray]:
    return [(values == 1).astype(np.int64), (values == 2).astype(np.int64), (values > 2).astype(np.int64)]


def train(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF) -> dict:
    """Counts docs' texts and writes the tables; returns what scoring must know of them."""
    if order not in (2, 3) or cutoff not in (1, 2):
        raise ValueError("the order is 2 or 3 and the cutoff 1 or 2")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(size) // BUCKET_BYTES))
    folder = new_folder(docs.sparkSession, "words")
    saved(folder, "codes", 0, key=frequent_words(bounded(docs), int(size)))

    def coded() -> np.ndarray:
        return mapped(f"{folder}/codes_0")["key"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def combine() -> None:
            u, v, w, n = (np.concatenate(x) for x in zip(*held))
            _, place, (n,) = summed(triple_hash(u, pair_hash(v, w)), n)
            held[:] = [(u[place], v[place], w[place], n)]

        def sent() -> Iterator[pa.RecordBatch]:
            u, v, w, n = held.pop()
            for k, blob in dealt(bucket_of(pair_hash(v, w), buckets), [u, v, w], [n], coded()):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "triples"])

        for batch in batches:
            for _, _, padded, offsets in blocks(batch.column("text")):
                u, v, w, _ = token_triples(padded, offsets)
                held.append((u if order > 2 else np.full_like(u, START), v, w, np.ones(len(w), np.int64)))
                if sum(len(x[0]) for x in held) > HELD_TOKENS:
                    combine()
                    if len(held[0][0]) > HELD_TOKENS // 2:
                        yield from sent()
        if held:
            combine()
            yield from sent()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes = coded()
        u, v, w, n = all_rows(group.triples, 3, 1, codes)
        pair = pair_hash(v, w)
        triples, place, (n,) = summed(triple_hash(u, pair), n)
        u, v, w, pair = u[place], v[place], w[place], pair[place]
        stats = {f"t{k}": int((n == k).sum()) for k in (1, 2, 3, 4)}
        often = n >= (cutoff if order > 2 else 1 << 62)
        saved(folder, "triple", key[0], key=triples[often], count=least_type(n[often]))
        # The triples of each pair that they begin with.
        history, at, sums = summed(pair_hash(u, v)[often], n[often], *classes(n[often]))
        rows = [(k, blob, None, None) for k, blob in dealt(bucket_of(history, buckets), [history], sums, codes)]

        pairs, at, (count_, before) = summed(pair, n, np.ones(len(n), np.int64))
        v, w = v[at], w[at]
        once = count_ == 1
        saved(folder, "once", key[0], key=pairs[once])
        saved(folder, "pair", key[0], key=pairs[~once], count=least_type(count_[~once]), before=least_type(before[~once]))
        value = before if order > 2 else count_
        stats |= {f"p{k}": int((value == k).sum()) for k in (1, 2, 3, 4)}
        contexts, _, sums = summed(v, value, *classes(value))
        rows += [(k, None, blob, None) for k, blob in dealt(bucket_of(contexts, buckets), [contexts], sums, codes)]
        words, _, sums = summed(w, count_, np.ones(len(w), np.int64))
        rows += [(k, None, None, blob) for k, blob in dealt(bucket_of(words, buckets), [words], sums, codes)]
        out = pd.DataFrame(rows, columns=["bucket", "histories", "contexts", "words"])
        return pd.concat([out, pd.DataFrame([{"bucket": key[0]} | stats])], ignore_index=True).reindex(columns=["bucket", "histories", "contexts", "words", *STATS[:8]])

    def finish(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        codes = coded()
        history, *sums = all_rows(group.histories, 1, 4, codes)
        history, _, sums = summed(history, *sums)
        saved(folder, "history", key[0], key=history, **{n: least_type(s) for n, s in zip(("total", "n1", "n2", "n3"), sums)})
        context, *sums = all_rows(group.contexts, 1, 4, codes)
        context, _, sums = summed(context, *sums)
        saved(folder, "context", key[0], key=context, **{n: least_type(s) for n, s in zip(("total", "n1", "n2", "n3"), sums)})
        words, *sums = all_rows(group.words, 1, 2, codes)
        words, _, (counts, before) = summed(words, *sums)
        saved(folder, "word", key[0], key=words, count=least_type(counts), before=least_type(before))
        stats = {c: int(group[c].fillna(0).sum()) for c in STATS[:8]} | {f"b{k}": int((before == k).sum()) for k in (1, 2, 3, 4)}
        return pd.DataFrame([stats | {"words": len(words), "tokens": int(counts.sum()), "before": int(before.sum())}])[STATS]

    triples = for_all_buckets(bounded(docs).select("text").mapInArrow(tidy(count), "bucket int, triples binary"), buckets)
    stats = ", ".join(f"{c} long" for c in STATS[:8])
    merged = triples.groupBy("bucket").applyInPandas(tidy_group(merge), f"bucket int, histories binary, contexts binary, words binary, {stats}")
    every = for_all_buckets(merged, buckets).groupBy("bucket").applyInPandas(tidy_group(finish), ", ".join(f"{c} long" for c in STATS))
    totals = every.agg(*[F.sum(c).alias(c) for c in STATS]).first().asDict()
    return {"folder": folder, "buckets": buckets, "order": order, "cutoff": cutoff, "documents": docs.count()} | totals


def discounts(model: dict, name: str) -> np.ndarray:
    """For counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4; halves where these are missing."""
    n1, n2, n3, n4 = (model[f"{name}{k}"] for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *[min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]])


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs' (doc_id, held_out, text)."""
    of_triples, of_pairs, of_words = (discounts(model, c) for c in "tpb")
    if model["cutoff"] > 1:
        of_triples[1] = 1.0
    order, buckets = model["order"], model["buckets"]
    tokens, vocabulary, before_all = model["tokens"], model["words"], max(1, model["before"])
    left = sum(of_words[k] * model[f"b{k}"] for k in (1, 2))
    left += of_words[3] * (vocabulary - model["b1"] - model["b2"])
    unseen = (left / before_all if vocabulary else 1.0) / (vocabulary + 1)

    def kept(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
        return np.maximum(counts - discount[np.minimum(counts, 3)], 0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Arrays(model["folder"], buckets)
        for batch in batches:
            for row, last, padded, offsets in blocks(batch.column("text")):
                u, v, w, rows = token_triples(padded, offsets)
                n = last - row
                words, back = np.unique(w, return_inverse=True)
                count, before = tables.find("word", bucket_of(words, buckets), words, "count", "before")
                base = np.log10((count + 1) / (tokens + vocabulary + 1))
                p = (kept(before, of_words) / before_all + unseen)[back]

                contexts, of_context = np.unique(v, return_inverse=True)
                total, *seen = tables.find("context", bucket_of(contexts, buckets), contexts, "total", "n1", "n2", "n3")
                rest = np.where(total > 0, sum(d * s for d, s in zip(of_pairs[1:], seen)) / np.maximum(total, 1), 1.0)
                pair = pair_hash(v, w)
                # The pair before a token is the one that its own goes on from.
                starts = v == START
                contexts = np.where(starts, pair_hash(*np.full((2, 1), START)), np.roll(pair, 1))
                pairs, of_pair = np.unique(np.concatenate([pair, contexts]), return_inverse=True)
                bucket = bucket_of(pairs, buckets)
                times, others = tables.find("pair", bucket, pairs, "count", "before")
                rare = np.flatnonzero(times == 0)
                rare = rare[tables.has("once", bucket[rare], pairs[rare])]
                times[rare] = others[rare] = 1
                own, onward = of_pair[: len(w)], of_pair[len(w) :]
                value = (others if order > 2 else times)[own]
                p = kept(value, of_pairs) / np.maximum(total, 1)[of_context] + rest[of_context] * p

                if order > 2:
                    history = tables.find("history", bucket, pairs, "total", "n1", "n2", "n3")
                    taken = history[0] - sum(d * s for d, s in zip(of_triples[1:], history[1:]))
                    all_of = np.where(starts, model["documents"], times[onward])
                    triples, place, of_triple = np.unique(triple_hash(u, pair), return_index=True, return_inverse=True)
                    (there,) = tables.find("triple", bucket[own[place]], triples, "count")
                    known, all_of = all_of > 0, np.maximum(all_of, 1)
                    p = np.where(known, kept(there, of_triples)[of_triple] / all_of + (1 - taken[onward] / all_of) * p, p)
                sums = [np.bincount(rows, weights=x, minlength=n) for x in (np.ones(len(rows)), count[back] > 0, base[back], np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, n),
                        batch.column("held_out").slice(row, n),
                        *[pa.array(s.astype(np.int64)) for s in sums[:2]],
                        pa.array(np.full(n, tokens, np.int64)),
                        *[pa.array(s) for s in sums[2:]],
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(tidy(score), schema)


def score_texts(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF) -> DataFrame:
    """Scores of all rows by the model of those that are not held out."""
    docs = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return scores(docs, train(docs.where(~F.col("held_out")), order, cutoff))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
