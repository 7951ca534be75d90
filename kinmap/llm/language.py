"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of 1 to 3 characters of the lower-cased text, hashed to
2**14 numbers, with their share of the text's n-grams times their inverse
document frequency. Document frequencies are counted over all training rows.
Weights are trained on a bounded sample of labelled rows (`train_rows`, the rows
with the smallest hashes; fitting a classifier on a documented sample) by
follow-the-regularised-leader with an L1 and an L2 penalty per coordinate, in
shards of their own, `PASSES` times each; then the shards' weights are averaged by
their rows. A softmax temperature is fitted on a part of the sample that was not
trained on.

Scoring reads whole texts; a text's score is linear in its n-grams, so long texts
need no more memory than a block of them.

Defined results: a null text, or one without a letter, is `und` with score 1; with
no labelled training row everything is `und` with score 0; ties go to the first
language by code point; repeated rows are predicted each; rows without doc_id are
predicted and never held out; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmap.llm.text import blocks, bounded, mixed, tidy

DIMS = 1 << 14
TRAIN_ROWS = 6000
SHARDS = 6
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 100.0
UNKNOWN = "und"
#: ASCII other than letters counts as a blank, so that marks and numbers between words say nothing.
LETTERISH = np.arange(256, dtype=np.uint8)
LETTERISH[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
SEEDS = [np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # DIMS x languages: weight times idf times SCALE
    bias: np.ndarray
    temperature: float


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, feature numbers, row of each feature) for blocks of texts."""
    lowered = pa.compute.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    for row, last, padded, offsets in blocks(lowered, 1 << 18):
        size = int(offsets[-1])
        padded = LETTERISH[padded]
        data = padded[:size]
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = padded[at].astype(np.uint64)
        width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        point = lead.copy()
        for k in (1, 2, 3):
            point |= np.where(width > k, padded[at + k].astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
        owner = np.searchsorted(offsets, at, "right") - 1
        features, rows = [], []
        gram = np.zeros(len(at), np.uint64)
        for n in range(3):
            if len(at) <= n:
                break
            m = len(at) - n
            gram = mixed(gram[:m] * np.uint64(31) + point[n:] + SEEDS[n])
            inside = owner[:m] == owner[n:]
            features.append((gram[inside] & np.uint64(DIMS - 1)).astype(np.int64))
            rows.append(owner[:m][inside])
        yield row, last, np.concatenate(features or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros(0, np.int64)])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, and the number of texts; every task sends DIMS sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for row, last, features, rows in gram_blocks(batch.column("text")):
                seen = np.unique(rows * DIMS + features)
                total += np.bincount(seen & (DIMS - 1), minlength=DIMS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], total]))], ["feature", "n"]
        )

    counted = bounded(docs).select("text").mapInArrow(tidy(count), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    out = np.zeros(DIMS + 1, np.int64)
    out[found.feature.to_numpy() + 1] = found.n.to_numpy()
    return out[1:], int(out[0])


def sparse_rows(texts: list[str], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for row, last, features, rows in gram_blocks(pa.array(texts, pa.large_string())):
        both, n = np.unique(rows * DIMS + features, return_counts=True)
        cut = np.searchsorted(both, np.arange(last - row + 1) * DIMS)
        for k in range(last - row):
            f, c = both[cut[k] : cut[k + 1]] & (DIMS - 1), n[cut[k] : cut[k + 1]]
            out.append((f, c / max(1, c.sum()) * idf[f] * SCALE))
    return out


def leader_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader: zero where |z| stays within L1."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow_leader(rows: list, labels: np.ndarray, z: np.ndarray, n: np.ndarray) -> None:
    """One pass of the proximal leader over the rows; z and n are updated. Row DIMS is the bias."""
    for (f, x), y in zip(rows, labels):
        f, x = np.append(f, DIMS), np.append(x, 1.0)
        w = leader_weights(z[f], n[f])
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1.0
        g = x[:, None] * p
        step = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
        z[f] += g - step * w
        n[f] += g * g


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model from docs' (doc_id, text, lang); rows without text or lang teach nothing."""
    taught = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    df, total = document_frequencies(taught)
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + df))
    languages = sorted(r.lang for r in taught.select("lang").distinct().collect())
    draw = F.xxhash64("doc_id", "lang")
    sample = taught.withColumn("draw", draw)
    bound = min(1.0, train_rows / total)  # rows are drawn by their hash, so their number is near the bound
    sample = sample.where(F.col("draw") < F.lit(int((2.0 * bound - 1.0) * 2**63) if bound < 1 else 2**63 - 1))
    shard = F.pmod(F.xxhash64("draw"), F.lit(SHARDS + 1)).cast("int")  # the last shard calibrates

    def rows_of(group: pd.DataFrame) -> tuple[list, np.ndarray]:
        group = group.sort_values(["draw", "doc_id", "text"])
        return sparse_rows(group.text.tolist(), idf), group.lang.map({v: k for k, v in enumerate(languages)}).to_numpy()

    def train(group: pd.DataFrame) -> pd.DataFrame:
        shape = (DIMS + 1, len(languages))
        z, n = np.zeros(shape), np.zeros(shape)
        rows, labels = rows_of(group)
        for _ in range(PASSES):
            follow_leader(rows, labels, z, n)
        return pd.DataFrame({"w": [leader_weights(z, n).astype("<f8").tobytes()], "rows": len(rows)})

    def logits(group: pd.DataFrame) -> pd.DataFrame:
        rows, labels = rows_of(group)
        s = np.array([x @ weights[f] for f, x in rows]) + weights[DIMS] if rows else np.zeros((0, len(languages)))
        return pd.DataFrame({"s": [s.astype("<f8").tobytes()], "y": [labels.astype("<i8").tobytes()]})

    sample = sample.withColumn("shard", shard)
    shards = sample.where(F.col("shard") < SHARDS).groupBy("shard").applyInPandas(train, "w binary, rows long").collect()
    weights = np.zeros((DIMS + 1, len(languages)))
    for r in shards:  # SHARDS tables of DIMS x languages, whatever the corpus
        weights += np.frombuffer(r.w, "<f8").reshape(weights.shape) * (r.rows / sum(s.rows for s in shards))
    held = sample.where(F.col("shard") == SHARDS).groupBy("shard").applyInPandas(logits, "s binary, y binary").collect()
    temperature = 1.0
    if held:
        y = np.frombuffer(held[0].y, "<i8")
        temperature = best_temperature(np.frombuffer(held[0].s, "<f8").reshape(len(y), -1), y)
    return Model(languages, weights[:DIMS] * idf[:, None] * SCALE, weights[DIMS], temperature)


def best_temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        v = s / np.exp(t)
        top = v.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(v - top).sum(axis=1)) + top[:, 0] - v[np.arange(len(y)), y])) if len(y) else 0.0

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score, in place of columns of these names; only the text is looked at."""
    docs = docs.drop("lang_pred", "score")
    names = np.array(model.languages if model else [UNKNOWN], object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sums, sizes = np.zeros((len(texts), len(names))), np.zeros(len(texts))
            if model:
                for row, last, features, rows in gram_blocks(texts):
                    sizes[row:last] = np.bincount(rows, minlength=last - row)
                    for k in range(len(names)):
                        sums[row:last, k] = np.bincount(rows, weights=model.table[features, k], minlength=last - row)
                s = (sums / np.maximum(sizes, 1)[:, None] + model.bias) / model.temperature
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
            else:
                p = np.zeros((len(texts), 1))
            best = p.argmax(axis=1)
            lang, score = names[best], p[np.arange(len(p)), best]
            letterless = ~pa.compute.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            lang[letterless], score[letterless] = UNKNOWN, 1.0
            kept = [batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return bounded(docs).mapInArrow(tidy(label), f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learning from the rows that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), train_rows)
    found = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.drop("text")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
