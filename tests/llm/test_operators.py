"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmap.llm import fingerprints, jaccard, language, licenses, mixing, packing, scoring, suffixes, token_counts, vectors

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, rank long, token string, component long"
WORDS = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    line = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k))
    base = [line(60) for _ in range(8)]
    out = [None, "", " \t\n", "one", "a b c d", "ÉÉ été 日本 🙂\r\n\x0bx", "word " * 3000, "don't we'll I've <|endoftext|> 12ab!!  \n\n x"]
    while len(out) < n:
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 12])):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        out.append(" ".join(words) + rnd.choice(["", "\nAll rights reserved.", "\nReleased under the MIT License.", "\n" + base[0]]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with clashing extra columns."""
    rows = [(3 * k + 5, t, ["en", "de", None][k % 3], ["a", None, "b"][k % 3], None, 1, 0.5, 2, "t", 7) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="module")
def local(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def split_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


OPERATORS = {
    "fingerprints": fingerprints.fingerprints,
    "packing": packing.best_fit_pack,
    "dedup": suffixes.dedup,
    "language": language.identify,
    "jaccard": jaccard.jaccard_components,
    "mixing": lambda d: mixing.mix(d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))),
    "scoring": scoring.score_texts,
    "licenses": licenses.license_scan,
    "tokens": token_counts.token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids_and_repeated_rows_do_not_fail(spark, name):
    rows = [(None, "some text here", "en", None), (1, None, None, None), (1, "some text here", "en", "s"), (1, "some text here", "en", "s"), (2, "some text here", "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    ids = {r.doc_id for r in OPERATORS[name](d).collect()}
    assert {1, 2} <= ids


def test_fingerprints(docs, local):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(local, reverse=True)
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        text, after = local[i] or "", local[ids[(k + 1) % len(ids)]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    by_text = collections.defaultdict(set)
    for i, t in local.items():
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_are_sums_over_paragraphs(spark):
    rows = [(1, "one. two\nthree"), (2, "three\none. two"), (3, "one. two"), (4, "three"), (5, "one. two\nthree\n!")]
    d = spark.createDataFrame(rows, "k long, text string")
    prints = fingerprints.unit_sums(d, ["k"]).select("k", fingerprints.fingerprint_of(F.struct(*fingerprints.SUMS)).alias("f"))
    sums = {r.k: r.f for r in prints.collect()}
    assert sums[1] == sums[2] != sums[5]
    pair = prints.where("k = 3").select(F.col("f").alias("a")).crossJoin(prints.where("k = 4").select(F.col("f").alias("b")))
    whole = pair.select(fingerprints.combined(F.col("a"), F.col("b")).alias("c"), "a", "b")
    back = whole.select("c", fingerprints.combined(F.col("c"), F.col("b"), -1).alias("d"), fingerprints.as_text(F.col("c")).alias("t")).first()
    assert back.c == sums[1] and back.d == sums[3]
    assert back.t == prints.where("k = 2").select(fingerprints.as_text(F.col("f"))).first()[0]


def test_packing(docs, local):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_path())
    want = {}
    for i, t in local.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 256):
            piece = ids[k : k + 256]
            want[i, k // 256] = (k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))
    rows = packing.best_fit_pack(docs, size=256).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    halves = sum(r.length > 128 for r in rows)  # no two of these share a sequence
    assert len(sequences) <= max(halves, 1.1 * math.ceil(sum(r.length for r in rows) / 256)) + 1


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(0)
    for size in (64, 4096):
        histogram = np.bincount(np.minimum(size, 1 + rng.geometric(4 / size, 3000)), minlength=size + 1)
        packed = packing.plan(histogram, size)
        assert (np.bincount([n for times, lengths in packed for n in lengths for _ in range(times)], minlength=size + 1) == histogram).all()
        assert all(sum(lengths) <= size for _, lengths in packed)
        bound = math.ceil((np.arange(size + 1) * histogram).sum() / size)
        assert sum(times for times, _ in packed) <= 1.002 * bound + 1


def brute_dedup(rows, length):
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if seen.setdefault(data[k : k + length], i) < i:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_dedup(docs, local):
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.dedup(docs).collect()}
    assert got == brute_dedup(local.items(), 50)


def test_dedup_leaves_copies_out(spark):
    """The table of copies holds whole keys, so that copies send no names."""
    import pyarrow as pa

    from kinmap.llm.text import blocks

    rows = [(k, "a text that stands in three documents, long enough to be cut " + "z" * (k % 2)) for k in range(6)]
    setting = suffixes.tables_for(spark.createDataFrame(rows, "doc_id long, text string"))
    found = suffixes.Texts(setting)
    _, _, padded, offsets = next(blocks(pa.array([t for _, t in rows])))
    assert found.originals(padded, offsets, np.arange(6)).tolist() == [True, True, False, False, False, False]


def test_dedup_of_short_periods(spark):
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abé") for _ in range(rnd.randint(20, 80))) for _ in range(6)]
    rows = [(k, "".join(rnd.choice(parts)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 6)))) for k in range(80)] + [(100, "a" * 300), (101, "a" * 120)]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows, 50)


def brute_jaccard(rows, percent=75, k=5):
    sets = {}
    for i, t in rows:
        w = split_words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, local):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_jaccard(local.items())


def test_jaccard_of_chains_and_hubs(spark):
    rnd = random.Random(7)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rnd.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(words)))
    shift = [f"s{k}" for k in range(200)]
    rows += [(100 + k, " ".join(shift[3 * k : 3 * k + 60])) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)


def test_components_of_chains_and_random_edges(spark):
    from kinmap.llm.components import components

    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + k, 1001 + k) for k in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_language(spark):
    rnd = random.Random(2)
    syllables = {"en": ["the", "ing", "th", "er", "on"], "fr": ["eau", "é", "ou", "ment", "que"]}
    rows = []
    for k in range(400):
        lang = ["en", "fr"][k % 2]
        rows.append((k, " ".join("".join(rnd.choices(syllables[lang], k=3)) for _ in range(12)), lang))
    rows += [(1000, None, "en"), (1001, "12 !! 3", "fr"), (1002, "", None)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(found[i].lang_pred, lang) for i, _, lang in rows[:400] if found[i].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(found[i].lang_pred == "und" for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_scores_against_loops(spark, docs, local):
    """Every text's score by the fitted table, n-gram by n-gram."""
    wide = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & wide
        x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & wide
        return x ^ (x >> 32)

    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    for i, t in local.items():
        points = [int.from_bytes(c.encode(), "little") for c in "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (t or "").lower())]
        features, grams = [], [0] * len(points)
        for n in range(3):
            grams = [mixed((g * 31 + p + int(language.SEEDS[n])) & wide) for g, p in zip(grams, points[n:])]
            features += [g & (language.DIMS - 1) for g in grams]
        s = (model.table[features].sum(0) / max(1, len(features)) + model.bias) / model.temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 1.0)
        else:
            assert got[i].score == pytest.approx(p.max()) and got[i].lang_pred == model.languages[p.argmax()]


def test_mixing_targets(docs, local):
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(rows, rows_per_slice=8).collect()
    assert len(got) == len(local)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", local[r.doc_id] or "")) and r.times in (0, 1, 2)
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.times
        targets[r.source] = r.target
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    budget, largest = 1.5 * sum(sizes.values()), max(r.size for r in got)
    assert abs(sum(taken.values()) - budget) <= largest / 2
    # A source may miss its own longest document, whose words then go to the others.
    assert all(abs(taken[s] - targets[s]) <= 1.5 * largest for s in sizes)
    again = {(r.doc_id, r.times) for r in mixing.mix(rows.repartition(5), rows_per_slice=8).collect()}
    assert again == {(r.doc_id, r.times) for r in got}


def brute_mix(rows, repeats=2):
    """Copies of (doc_id, source, size) that the budget reaches in the order of virtual finish times, with their number."""
    sizes = collections.Counter()
    for _, source, size in rows:
        sizes[source] += size
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= repeats * sizes[s]]
        for s in full or open_:
            target[s] = min(repeats * sizes[s], level * weight[s])
        left -= sum(target[s] for s in full)
        open_ = open_ - set(full) if full else set()
    place = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16)
    copies, sent = [], collections.Counter()
    for i, source, size in sorted(rows, key=lambda r: (place(r[0]), r[0], r[2])):
        sent[source] += size
        copies += [((sent[source] + k * sizes[source]) / target[source], place(i), i, k, size) for k in range(repeats)]
    out, running = collections.Counter(), 0
    for _, _, i, _, size in sorted(copies):
        if running + size / 2 <= 1.5 * sum(sizes.values()):
            out[i] += 1
        running += size
    return out


def test_mixing_order_and_budget(spark):
    rnd = random.Random(8)
    some = [(i, rnd.choice(["a", "b", "c", "d", None]), rnd.choice([1, 3, 10, 400])) for i in range(300)]
    ones = [(i, f"s{i:04d}", 10) for i in range(600)]  # a budget of 9,000 words, where all that is due by time 1 has 10,000
    for rows in (some, ones):
        frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
        got = {r.doc_id: r.times for r in mixing.mix(frame, rows_per_slice=16).collect()}
        want = brute_mix(rows)
        assert got == {i: want[i] for i, _, _ in rows}
        _, kept = mixing.served(frame, rows_per_slice=16)
        order = [(r.time, r.place, r.doc_id, r.round) for r in mixing.in_order(kept).collect()]
        assert order == sorted(order) and len(order) == sum(want.values())


@pytest.mark.parametrize("rows", [0, 1, 7, 500])
@pytest.mark.parametrize("columns", [1, 2, 3])
def test_rows_packed_by_codes(rows, columns):
    draw = np.random.default_rng(rows + columns)
    codes = np.unique(draw.integers(0, 1 << 63, 50).astype(np.uint64))
    others = draw.integers(0, 1 << 63, (columns, rows)).astype(np.uint64) * np.uint64(2)
    words = [np.where(draw.random(rows) < 0.5, draw.choice(codes, rows), x) for x in others]
    numbers = [draw.integers(0, 1 << 40, rows) for _ in range(2)]
    got = scoring.unpacked_rows(scoring.packed_rows(words, numbers, codes), columns, 2, codes)
    assert sorted(zip(*(c.tolist() for c in got))) == sorted(zip(*(c.tolist() for c in words + numbers)))


@pytest.mark.parametrize("order", [2, 3])
def test_scores_do_not_depend_on_codes_or_buckets(docs, order, monkeypatch):
    def rows():
        return sorted(tuple(r) for r in scoring.score_texts(docs, order).collect())

    want = rows()
    monkeypatch.setattr(scoring, "CODES", 7)
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 50_000)
    got = rows()
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:]) for r in want]


@pytest.mark.parametrize("order, cutoff", [(3, 2), (3, 1), (2, 2)])
def test_scoring(docs, local, order, cutoff):
    got = {r.doc_id: r for r in scoring.score_texts(docs, order, cutoff).collect()}
    tokens = {i: [*split_words(t), None] for i, t in local.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in local}
    counts, pairs, triples = (collections.Counter() for _ in range(3))
    for i, t in tokens.items():
        if not held[i]:
            counts.update(t)
            pairs.update(zip(["<"] + t[:-1], t))
            triples.update(zip(["<", "<", *t[:-2]] if len(t) > 1 else ["<"], ["<"] + t[:-1], t))
    n, v = sum(counts.values()), len(counts)
    before = collections.Counter(b for _, b in pairs)
    value = collections.Counter(x[1:] for x in triples) if order > 2 else pairs

    def discount(values, cutoff=1):
        n1, n2, n3, n4 = (sum(x == k for x in values) for k in (1, 2, 3, 4))
        d = [0, 0.5, 0.5, 0.5]
        if n1 and n2 and n3:
            y = n1 / (n1 + 2 * n2)
            d = [0] + [min(max(d, 0.05), k + 0.95) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]
        return d if cutoff == 1 else [0, 1.0, *d[2:]]

    d3, d2, d1 = discount(triples.values(), cutoff), discount(value.values()), discount(before.values())

    def table(counter, d):
        total, kept = collections.Counter(), collections.Counter()
        for key, c in counter.items():
            total[key[:-1]] += c
            kept[key[:-1]] += c - d[min(c, 3)]
        return total, kept

    totals3, kept3 = table(triples, d3)
    totals2, kept2 = table(value, d2)
    left = sum(d1[min(x, 3)] for x in before.values()) / len(pairs)

    def mixed(counter, d, total, kept, key, low):
        c = counter[key]
        return (c - d[min(c, 3)]) / total[key[:-1]] + (1 - kept[key[:-1]] / total[key[:-1]]) * low if total[key[:-1]] else low

    def p(x):
        low = max(before[x[2]] - d1[min(before[x[2]], 3)], 0) / len(pairs) + left / (v + 1)
        low = mixed(value, d2, totals2, kept2, x[1:], low)
        return mixed(triples, d3, totals3, kept3, x, low) if order > 2 else low

    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        each = zip(["<", "<", *t[:-2]] if len(t) > 1 else ["<"], ["<"] + t[:-1], t)
        assert r.score == pytest.approx(sum(math.log10(p(x)) for x in each))
    # Probabilities of all known words and an unknown one sum to one.
    some = next(iter(totals3))
    assert sum(p((*some, w)) for w in counts) + p((*some, "unknown")) == pytest.approx(1)


def test_licenses(docs, local):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for i, t in local.items():
        w, places, labels = find(t), [], set()
        for phrase, label in licenses.PHRASES.items():
            q = phrase.split()
            here = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            places += here
            labels |= {label} if here else set()
        own = set(labels)
        paragraphs = [p for p in re.split(licenses.PARAGRAPH_END, t or "") if "\n" in p]
        for block in [*(t or "").split("\n"), *paragraphs]:
            b = set(find(block))
            for label, template in licenses.TEMPLATES:
                words = set(template.split())
                if len(b & words) >= math.ceil(licenses.THRESHOLD * len(words) - 1e-9):
                    own.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(labels)), ",".join(sorted(own)))


def test_long_paragraphs_are_matched(spark):
    """A license in a comment whose empty lines have a comment mark is one paragraph, many times a template's size."""
    template = next(t for label, t in licenses.TEMPLATES if label == "bsd" and len(t.split()) > 20).split()
    lines = [" * " + " ".join(template[k : k + 7]) for k in range(0, len(template), 7)]
    comment = "/*\n * Copyright\n *\n" + "\n".join(lines) + "\n *\n" + "\n".join(f" * {w} {w}{k}" for k, w in enumerate(WORDS * 40)) + "\n */"
    d = spark.createDataFrame([(1, comment), (2, comment.replace(" *\n", "\n"))], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(d).collect()} == {1: ("bsd", 1.0), 2: ("bsd", 1.0)}


def test_wrapped_licenses(spark):
    mit = """Copyright (c) Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
    words = " ".join(licenses.TEMPLATES[2][1].split())
    rows = [(1, mit), (2, words.replace(" license", "\nlicense")), (3, mit.replace("\nof", "\n" + " ".join(f"w{k}" for k in range(400)) + "\nof")), (4, None)]
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "mit", 3: "mit", 4: ""}  # blocks of any size match


def machine():
    path = token_counts.default_path()
    return token_counts.counter(path, token_counts.class_ranges(path))


def library(rows, path=None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or token_counts.default_path())
    return [len(x.ids) for x in tokenizer.encode_batch(rows, add_special_tokens=False)]


def test_token_counts_whole_and_in_chunks(docs, local):
    ids = sorted(local)
    want = dict(zip(ids, library([local[i] or "" for i in ids])))
    for chunk, context in ((1 << 16, 64), (37, 24)):
        few = docs if chunk > 37 else docs.where(F.coalesce(F.length("text"), F.lit(0)) < 2000)
        rows = token_counts.token_counts(few, chunk_chars=chunk, context=context).collect()
        assert all(r.n_tokens == want[r.doc_id] and r.n_bytes == len((local[r.doc_id] or "").encode()) for r in rows)
        assert len(rows) == few.count()


def test_token_state_maps_meet(spark):
    """Texts without white space, longer than a chunk: states cross the borders; periodic ones must be mapped anew."""
    rnd = random.Random(11)
    rows = ["a" * 997, "ab" * 400, "the" * 333, "'s" * 300, "é" * 500, "日本語" * 150, "!" * 700, "1234567" * 90, " " * 600, " \n" * 300, "x" + " " * 500 + "y"]
    rows += ["".join(rnd.choice(["a", "th", "ing", "'", "s", "ll", " ", "<|endoftext|>", "<|endof", "text|>", "é", "9", "\n"]) for _ in range(400)) for _ in range(25)]
    rows += [rows[0], rows[-1]]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(0, rows[0]), (None, rows[1])], "doc_id long, text string")
    got = token_counts.token_counts(frame, chunk_chars=50, context=24).collect()
    want = library(rows)
    assert len(got) == len(rows) + 2
    assert all(r.n_tokens == want[1 if r.doc_id is None else r.doc_id] for r in got)
    one = spark.createDataFrame([(1, "lorem ipsum " * 20_000), (2, "q" * 150_000)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(one).collect()} == dict(zip((1, 2), library(["lorem ipsum " * 20_000, "q" * 150_000])))


def test_token_transducer_on_odd_texts():
    import pyarrow as pa

    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "'", "s", "ll", "re", "a", "the", "ing", "É", "日", " ", "1", "23", "!", "<|endoftext|>", "🙂", "'s", "\x85"]
    rows = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    assert token_counts.count_texts(pa.array(rows), machine()).tolist() == library(rows)


def test_token_counts_of_every_code_point():
    import pyarrow as pa

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c >= 0xE0000)]
    rows = ["".join(f"a{c}b {c}{c} 1{c}  {c}'s" for c in points[k : k + 16]) for k in range(0, len(points), 16)]
    assert token_counts.count_texts(pa.array(rows), machine()).tolist() == library(rows)


def test_token_counts_with_two_special_strings(tmp_path):
    import json

    import pyarrow as pa

    with open(token_counts.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    one = spec["added_tokens"][0]
    spec["added_tokens"] += [one | {"id": one["id"] + 1, "content": "<|end|>"}, one | {"id": one["id"] + 2, "content": "<|endoftext|>!"}]
    path = str(tmp_path / "two.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    rows = ["a<|end|>b<|endoftext|>", "<|endoftext|><|end|>", "x <|endoftext|>! y", "<|end|> <|end|>  <|end", "plain"]
    assert token_counts.count_texts(pa.array(rows), token_counts.counter(path, token_counts.class_ranges(path))).tolist() == library(rows, path)


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            v = rng.normal(size=16)
            for cos in (1.0, 1.0, 0.995, 0.985, 0.975):
                o = rng.normal(size=16)
                o -= o @ v / (v @ v) * v
                u = v if cos == 1.0 else cos * v / np.linalg.norm(v) + math.sqrt(1 - cos * cos) * o / np.linalg.norm(o)
                rows.append((k, [float(x) for x in u], label, "x"))
                k += 1
    rows += [(k, None, 0, "x"), (k + 1, [0.0] * 16, 0, "x"), (k + 2, [float("nan")] * 16, 0, "x"), (k + 3, [None] * 16, 0, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, part_rows=4).collect()}
    use = [(i, np.array(e), label) for i, e, label, _ in rows[: 60 * 2]]
    links = {(a, b) for a, x, p in use for b, y, q in use if a != b and p == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98}
    found = sum(r.n_links for r in got.values())
    assert found <= len(links) and found >= 0.99 * len(links)
    assert all(got[i].n_links == 0 and got[i].kept for i, *_ in rows[120:])
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def test_vectors_of_odd_rows(spark):
    """Null and repeated ids, very small and large numbers, other lengths; one large group of near copies in many parts."""
    rows = [(None, [1.0, 0.0], "x"), (1, [1e-200, 2e-200], "x"), (2, [1e200, 2e200], "x"), (3, [1.0, 2.0], "x"), (3, [1.0, 2.0], "x"), (4, [1.0, 2.0, 0.0], "x"), (5, [float("inf"), 1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True)}
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    many = [base + 0.02 * rng.normal(size=24) for _ in range(150)]
    many += many[:20]
    frame = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(many)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame, part_rows=16).collect()}
    assert got == {k: (len(many) - 1, 0) for k in range(len(many))}


STAGE_NAMES = ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "mixing_sources", "best_fit_packing"]


@pytest.mark.parametrize("name", STAGE_NAMES)
def test_pipeline_stages_on_odd_rows(spark, none, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, none, "").collect() == []
    text = "the same words again and again in one text of its own that is long enough to be cut where it repeats"
    rows = [(None, text, "en", "a"), (1, None, None, None), (2, "", "en", None), (3, text, "en", "a"), (3, text, "en", "a"), (4, text, "en", "b"), (5, "12 !! 3", "en", "b"), (6, text[::-1] + "\n" + text, "en", "b")]
    frame = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "extra") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, token string")
    out = stage(spark, frame, "").collect()
    if name == "best_fit_packing":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, *_ in rows)
        return
    assert all(list(r.asDict()) == corpus_pipeline.COLUMNS for r in out)
    ids = sorted(r.doc_id for r in out if r.doc_id is not None)
    if name == "language_id":  # no letter, no language; the row without an id stays, and so does each repeated row
        assert ids == [3, 3, 4, 6] and len(out) == 5
    elif name == "ngram_jaccard_join":  # one row an id, the least of a group; texts without words are kept
        assert ids == [1, 2, 3, 5, 6] and len(out) == 5
    elif name == "suffix_array_dedup":  # 4 is cut to nothing, 6 to its own line; empty texts stay
        assert ids == [1, 2, 3, 3, 5, 6] and len(out) == 6
        assert next(r for r in out if r.doc_id == 6).text == text[::-1] + "\n" and next(r for r in out if r.doc_id == 6).n_chars == len(text) + 1
    else:  # nothing is taken more than twice, rows that agree share what is taken
        assert all(ids.count(i) <= (4 if i == 3 else 2) for i in ids) and {3, 4, 6} & set(ids)


def test_pipeline_stages_feed_each_other(spark, docs, tmp_path):
    import corpus_pipeline

    d = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, d, "").write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert d.columns == corpus_pipeline.COLUMNS
    one = spark.read.parquet(f"{tmp_path}/language_id")
    kept = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/ngram_jaccard_join").collect()}
    components = brute_jaccard([(r.doc_id, r.text) for r in one.collect()])
    assert kept == {c for _, c in components.values()}
    assert set(d.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_buckets_of_ranges_keep_the_order_and_are_even():
    from kinmap.llm.suffixes import bucket_by_range
    from kinmap.llm.tables import runs

    for bits, buckets in ((64, 1), (64, 79_000), (40, 777), (20, 5), (64, 9_000_000)):
        values = np.sort(np.random.default_rng(7).integers(0, 2**bits, 4_000, np.uint64, endpoint=False))
        values[0], values[-1] = 0, np.uint64(2**bits - 1)
        bucket = bucket_by_range(values, buckets, bits)
        assert (np.diff(bucket) >= 0).all() and bucket[0] == 0 and bucket[-1] == buckets - 1
        exact = np.array([int(v) * buckets >> bits for v in values])
        assert (np.abs(bucket - exact) <= 1).all()
        found = list(runs(bucket))
        assert [b for b, _, _ in found] == sorted(set(bucket.tolist()))
        assert sum(end - start for _, start, end in found) == len(values)
        assert all((bucket[start:end] == b).all() for b, start, end in found)
    assert not list(runs(np.zeros(0, np.int64)))


def test_lookups_among_many_buckets_open_only_those_with_keys(tmp_path):
    from kinmap.llm.tables import Arrays, saved

    keys = np.arange(0, 2_000, 2, dtype=np.uint64)
    for b in (3, 500_000):
        saved(str(tmp_path), "word", b, key=keys, count=keys.view(np.int64) + b)
    asked = np.array([4, 5, 1_998, 0, 4], np.uint64)
    bucket = np.array([500_000, 3, 3, 500_000, 3])
    tables = Arrays(str(tmp_path), 1_000_000)
    assert tables.find("word", bucket, asked, "count")[0].tolist() == [500_004, 0, 2_001, 500_000, 7]
    assert tables.has("word", bucket, asked).tolist() == [True, False, True, True, True]
