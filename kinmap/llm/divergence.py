"""How far the sources of a language stand apart in their words, by in-mapper stripes.

A term is a run of letters A to Z, lowered, and of characters beyond ASCII. Each task
folds whole documents into stripes: for a language and term, the number of documents
that hold it and its occurrences by source. When a task's stripes get large they are
spilled; stripes are dealt by language and term, sorted, and merged as they stream by,
so a task holds a batch of them. Terms in fewer than `least_docs` documents of their
language go as soon as they are whole.

The shares of a group are p = 1 + floor(UNIT * (count + 5) / (N + 5 * V)). Merged
stripes of a language are cut into chunks by a hash of the term, as many as bound
terms times sources, and meet there the language's sources with their totals. A chunk
emits, for each two sources, the sum of |p - q| over its terms, and for each source
its `top` terms that stand out most from the language. Sums are added and the few
best of each chunk ranked. A frequent term is one entry a source in one stripe a task,
and a hot source is summed before anything is sent.

Defined results: null text, lang and source count as ''; every row is a document, so
repeated rows and null ids count; sources without a kept term have pairs, too; a
language with one source has no pairs; ties go to the item first in UTF-8; extra
columns are ignored; an empty table gives an empty result. A stripe has an entry a
source of its language, which tasks hold in memory, as they do one row of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmap.llm.text import LOWER, blocks, bounded, spans, tidy
from kinmap.session import broadcast_up_to, stored

LEAST_DOCS, TOP = 30, 50
UNIT, SMOOTH = 1_000_000_000, 5
#: Entries of stripes that a task holds before it spills them; terms times sources of a chunk.
SPILL, CELLS = 2_000_000, 2_000_000
TERM_BYTE = np.ones(256, bool)
TERM_BYTE[:128] = False
TERM_BYTE[[*range(65, 91), *range(97, 123)]] = True
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 5) / (total + 5 * terms)) in whole numbers, by long division three digits at a time."""
    below = np.maximum(total + SMOOTH * terms, 1)
    whole, rest = np.divmod(count + SMOOTH, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def terms_of(padded: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of the rows in their order, and the row of each."""
    lowered = LOWER[padded]
    inside = TERM_BYTE[lowered]
    starts, ends, rows = spans(inside, offsets)
    size = int(offsets[-1])
    data = np.ascontiguousarray(lowered[:size][inside[:size]])
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data)), rows


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Numbers:
    """Consecutive numbers for values, in the order of their first appearance."""

    def __init__(self) -> None:
        self.number: dict = {}

    def of(self, values: list) -> np.ndarray:
        return np.fromiter((self.number.setdefault(v, len(self.number)) for v in values), np.int64, len(values))

    def __len__(self) -> int:
        return len(self.number)


class Stripes:
    """A task's stripes: (language, term) to documents, and (group, term) to occurrences, as sorted runs of keys."""

    def __init__(self) -> None:
        self.terms, self.langs, self.groups = Numbers(), Numbers(), Numbers()
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def fold(self, padded: np.ndarray, offsets: np.ndarray, lang: list[str], source: list[str]) -> None:
        words, rows = terms_of(padded, offsets)
        if not len(words):
            return
        coded = words.dictionary_encode()
        term = self.terms.of(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        lang_of = self.langs.of(lang)
        group_of = self.groups.of(list(zip(lang, source)))
        # A term's occurrences in each document, then the documents of each language.
        pair, times = np.unique(rows.astype(np.int64) << 40 | term, return_counts=True)
        row, term = pair >> 40, pair & ((1 << 40) - 1)
        self.counts.append(summed(group_of[row] << 40 | term, times))
        self.docs.append(summed(lang_of[row] << 40 | term, np.ones(len(row), np.int64)))
        self.held += len(self.counts[-1][0])
        if self.held > SPILL and len(self.counts) > 1:
            self.docs, self.counts = ([summed(*map(np.concatenate, zip(*runs)))] for runs in (self.docs, self.counts))
            self.held = len(self.counts[0][0])

    def batches(self, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        """The stripes, sorted by language and the number of the term."""
        if not self.counts:
            return
        docs, n_docs = summed(*map(np.concatenate, zip(*self.docs)))
        keys, times = summed(*map(np.concatenate, zip(*self.counts)))
        names = list(self.groups.number)
        lang_of_group = self.langs.of([lang for lang, _ in names])
        group, term = keys >> 40, keys & ((1 << 40) - 1)
        order = np.lexsort((group, lang_of_group[group] << 40 | term))
        group, term, times = group[order], term[order], times[order]
        cut = np.searchsorted(lang_of_group[group] << 40 | term, docs, "left")
        cut = np.append(cut, len(group))
        terms, langs = pa.array(list(self.terms.number), pa.string()), pa.array(list(self.langs.number), pa.string())
        sources = pa.array([source for _, source in names], pa.string())
        for s in range(0, len(docs), rows):
            e = min(len(docs), s + rows)
            places = pa.array(cut[s : e + 1] - cut[s], pa.int32())
            part = slice(cut[s], cut[e])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(docs[s:e] >> 40)),
                    terms.take(pa.array(docs[s:e] & ((1 << 40) - 1))),
                    pa.array(n_docs[s:e]),
                    pa.ListArray.from_arrays(places, sources.take(pa.array(group[part]))),
                    pa.ListArray.from_arrays(places, pa.array(times[part])),
                ],
                ["lang", "term", "docs", "sources", "counts"],
            )


def stripes(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, sources, counts): one row a language and term of each spill of each task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stripes()
        for batch in batches:
            lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for first, last, padded, offsets in blocks(batch.column("text")):
                held.fold(padded, offsets, lang[first:last], source[first:last])
                if held.held > SPILL or 2 * len(held.terms) > SPILL:
                    yield from held.batches()
                    held = Stripes()
        yield from held.batches()

    return bounded(docs).select("text", "lang", "source").mapInArrow(tidy(fold), STRIPE)


def merged_batch(table: pa.Table, more: bool, least_docs: int) -> tuple[pa.RecordBatch, pa.Table | None]:
    """Rows sorted by language and term, merged: the whole ones in enough documents, and the last one if `more` of it may come."""
    lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
    n = len(table)
    new = np.ones(n, bool)
    new[1:] = np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])))
    first = np.flatnonzero(new)
    docs = np.add.reduceat(table.column("docs").to_numpy(), first)
    lists = table.column("sources").combine_chunks()
    values = lists.flatten().dictionary_encode()
    of_row = np.repeat(np.cumsum(new) - 1, np.asarray(lists.value_lengths()))
    counts = table.column("counts").combine_chunks().flatten().to_numpy()
    keys, times = summed(of_row << 32 | np.asarray(values.indices), counts)
    kept = docs >= least_docs
    if more:
        kept[-1] = True
    inside = kept[keys >> 32]
    keys, times = keys[inside], times[inside]
    cut = np.append(np.searchsorted(keys >> 32, np.flatnonzero(kept)), len(keys))
    at = pa.array(first[kept])
    out = pa.RecordBatch.from_arrays(
        [
            lang.take(at),
            term.take(at),
            pa.array(docs[kept]),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values.dictionary.take(pa.array(keys & ((1 << 32) - 1)))),
            pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times)),
        ],
        ["lang", "term", "docs", "sources", "counts"],
    )
    return (out.slice(0, len(out) - 1), pa.Table.from_batches([out.slice(len(out) - 1)])) if more else (out, None)


def merged(parts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One stripe for each language and term in at least `least_docs` documents of the language."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held.cast(table.schema), table])
            out, held = merged_batch(table, True, least_docs)
            yield out
        if held is not None:
            yield merged_batch(held, False, least_docs)[0]

    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(tidy(merge), STRIPE)


def chunk_results(top: int):
    """The function of a chunk's stripes and its language's sources."""

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, terms, lang_total = (right.column(c)[0].as_py() for c in ("lang", "terms", "lang_total"))
        right = right.sort_by("source")
        names, totals = right.column("source").combine_chunks(), right.column("total").to_numpy()
        n = len(names)
        items, lists = left.column("term").combine_chunks(), left.column("sources").combine_chunks()
        place = np.asarray(pc.index_in(lists.flatten(), value_set=names)).astype(np.int64)
        row = np.repeat(np.arange(len(items)), np.asarray(lists.value_lengths()))
        times = left.column("counts").combine_chunks().flatten().to_numpy()
        count = np.zeros((len(items), n), np.int64)
        count[row, place] = times
        p = shares(count, totals[None, :], terms)
        q = shares(count.sum(axis=1), np.int64(lang_total), terms)
        ends, values, kinds, places = [], [], [], []
        for a in range(n - 1):
            values.append(np.abs(p[:, a + 1 :] - p[:, a : a + 1]).sum(axis=0, dtype=np.int64))
            places.append(np.full(n - 1 - a, a))
            ends.append(np.arange(a + 1, n))
        pairs = pa.table(
            {
                "source": names.take(pa.array(np.concatenate(places) if places else np.zeros(0, int))),
                "item": names.take(pa.array(np.concatenate(ends) if ends else np.zeros(0, int))),
                "value": pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)),
            }
        ).append_column("part", pa.array(["pair"] * sum(map(len, ends)), pa.string()))
        by_item = np.asarray(pc.rank(items, "ascending")).astype(np.int64) if len(items) else np.zeros(0, np.int64)
        for a in range(n):
            over = np.flatnonzero((count[:, a] > 0) & (p[:, a] > q))
            best = over[np.lexsort((by_item[over], -(p[over, a] - q[over])))[:top]]
            kinds.append((np.full(len(best), a), best, p[best, a] - q[best]))
        of, best, value = (np.concatenate(x) for x in zip(*kinds))
        found = pa.table({"source": names.take(pa.array(of)), "item": items.take(pa.array(best)), "value": pa.array(value)})
        found = found.append_column("part", pa.array(["term"] * len(of), pa.string()))
        out = pa.concat_tables([t.cast(pa.schema([(c, pa.int64() if c == "value" else pa.string()) for c in t.column_names])) for t in (pairs, found)])
        return out.append_column("lang", pa.array([lang] * len(out), pa.string())).select(["lang", "source", "part", "item", "value"])

    return results


def source_divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
    kept = stored(merged(stripes(docs), least_docs), "stripes")
    entries = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "e.sources", "e.counts")
    totals = entries.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("total"))
    sources = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    of_lang = sources.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n")).join(sizes, "lang", "left").fillna(0, ["terms"])
    chunks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("n") / F.lit(cells))).cast("int")
    of_lang = of_lang.withColumn("chunks", chunks)

    groups = sources.join(of_lang, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    groups = groups.select("lang", "chunk", "source", "total", "terms", "lang_total")
    dealt = kept.join(broadcast_up_to(of_lang.select("lang", "chunks")), "lang")  # a row a language
    dealt = dealt.select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), "term", "sources", "counts")
    found = dealt.groupBy("lang", "chunk").cogroup(groups.groupBy("lang", "chunk"))
    found = stored(found.applyInArrow(chunk_results(top), "lang string, source string, part string, item string, value long"), "divergences")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = pairs.unionByName(back).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", F.row_number().over(order)).select(columns).unionByName(terms.select(columns))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT i, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST_DOCS}),
v AS (SELECT lang, (SELECT count(*) FROM k WHERE k.lang = l.lang) AS v FROM (SELECT DISTINCT lang FROM d) l),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
p AS (SELECT lang, source, term, n, 1 + ({UNIT} * (n + {SMOOTH})) // ((sum(n) OVER (PARTITION BY lang, source))::HUGEINT + {SMOOTH} * v) AS p,
    1 + ({UNIT} * ((sum(n) OVER (PARTITION BY lang, term))::HUGEINT + {SMOOTH})) // ((sum(n) OVER (PARTITION BY lang))::HUGEINT + {SMOOTH} * v) AS q
    FROM c JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY rank <= {TOP}
"""
