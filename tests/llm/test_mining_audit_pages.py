"""Hard negatives, source divergences and main texts against plain loops, with odd rows."""

import collections
import html
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinmap.llm import divergence, negatives, pages

VECTORS = "vec_id long, label int, embedding array<float>, score long, cluster int, n int"


def odd_vectors(seed, n=260, dims=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dims))
    out = []
    for i in range(n):
        v = centres[rnd.integers(5)] + 0.2 * rnd.normal(size=dims)
        out.append((i, int(rnd.integers(3)), [float(x) for x in np.float32(v)]))
    copy = out[17][2]
    out[40:60] = [(i, i % 2, copy) for i in range(40, 60)]  # ties
    out[100] = (100, 1, copy)
    out[3], out[4], out[5], out[6] = (3, None, copy), (4, 1, None), (5, 1, [1.0] * 5 + [None]), (6, 1, [float("inf")] + [0.0] * 5)
    out[7], out[200], out[9] = (7, 1, [0.0] * dims), (200, 2, [0.0] * dims), (9, 1, [1.0, 2.0])
    out += [(None, 1, copy), out[40], out[40], (300, 9, copy), (400, 1, [float(np.float32(1e20))] + [0.0] * (dims - 1)) if seed == 0 else (400, 1, copy)]
    return out


def brute_negatives(rows, is_anchor):
    chosen = {}
    for i, label, v in rows:
        if i is not None:
            chosen[i] = max(chosen.get(i, ("",)), (str(label), v)) if i in chosen else (str(label) if label is not None else None, v)
    ok = {i: (c[0], [math.floor(256.0 * x) for x in c[1]]) for i, c in chosen.items() if c[0] is not None and c[1] is not None and all(x is not None and math.isfinite(x) for x in c[1])}
    out = set()
    for a in filter(is_anchor, ok):
        label, v = ok[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in ok.items() if i != a and len(w) == len(v))
        for p, pid, other in [s for s in scores if s[2] == label][:5]:
            found = [(s, i) for s, i, o in scores if o != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out |= {(a, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("seed,clusters,block_rows,slice_anchors", [(1, 3, 64, 1000), (2, 1, 16, 4), (3, 8, 16_384, 8_192)])
def test_hard_negatives(spark, monkeypatch, seed, clusters, block_rows, slice_anchors):
    rows = odd_vectors(seed)
    monkeypatch.setattr(negatives, "STRIP_ROWS", 8)
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(3)
    got = negatives.hard_negatives(table, F.col("id") % 10 == 0, clusters=clusters, block_rows=block_rows, slice_anchors=slice_anchors)
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows, lambda i: i % 10 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    big = [float(2**30 + 2**10), 3.0, -1.0]
    rows = [(0, 1, big), (1, 1, big), (2, 2, [float(2**30), 3.0, -1.0]), (3, 2, [1.0, 2.0, 3.0]), (4, 2, big[:2])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {tuple(r) for r in negatives.hard_negatives(table, F.col("id") == 0, scale=1.0).collect()}
    whole = (2**30 + 2**10) ** 2 + 10
    assert got == {(0, 1, 1, 2, whole, (2**30 + 2**10) * 2**30 + 10)}


def test_walks_end_early_on_clustered_vectors():
    rnd = np.random.default_rng(0)
    centres = np.eye(8) * 100
    rows = np.floor(np.concatenate([c + rnd.normal(size=(200, 8)) for c in centres]))
    centroid = negatives.fit_centroids(centres, 8)
    angle = negatives.angles(rows, centroid)
    best = rows[:1] @ rows.T
    near = np.argmin(angle[0])
    bounds = negatives.lengths(rows) * np.cos(np.maximum(0, angle[:, near] - angle[0, near]))
    assert (bounds * negatives.lengths(rows[:1]) + 1e-3 >= best[0]).all()
    kth = np.sort(best[0])[-5]
    assert (bounds * negatives.lengths(rows[:1]) >= kth).mean() < 0.2


def test_empty_tables(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("id") % 2 == 0).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, term string, docs long")
    assert divergence.source_divergences(docs).collect() == []
    assert pages.main_texts(spark.createDataFrame([], "page_id long, url string, html string, text string")).collect() == []


def brute_divergences(rows, least_docs, top):
    docs = [(t or "", lang or "", source or "") for t, lang, source in rows]
    held, counts = collections.defaultdict(set), collections.Counter()
    for k, (text, lang, source) in enumerate(docs):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered):
            held[lang, term].add(k)
            counts[lang, source, term] += 1
    out = set()
    for lang in {d[1] for d in docs}:
        sources = sorted({d[2] for d in docs if d[1] == lang})
        terms = sorted(t for (x, t), ids in held.items() if x == lang and len(ids) >= least_docs)
        share = lambda count, total: 1 + (10**9 * (count + 5)) // (total + 5 * len(terms))
        totals = {s: sum(counts[lang, s, t] for t in terms) for s in sources}
        p = {(s, t): share(counts[lang, s, t], totals[s]) for s in sources for t in terms}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(totals.values())) for t in terms}
        for s in sources:
            pairs = [(-sum(abs(p[s, t] - p[o, t]) for t in terms), o.encode()) for o in sources if o != s]
            best = sorted((-(p[s, t] - q[t]), t.encode()) for t in terms if counts[lang, s, t] and p[s, t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", best)):
                out |= {(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(sorted(found))}
    return out


@pytest.mark.parametrize("spill,cells", [(10**6, 10**6), (40, 30)])
def test_source_divergences(spark, monkeypatch, spill, cells):
    rnd = random.Random(5)
    words = "alpha Beta gamma été naïve 日本 don't x1y ZETA eta-theta iota \U0001f600 ÀÉ àÉ".split()
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(12))), rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "b", "é", "z", None])) for _ in range(150)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("only once", "it", None), ("alpha " * 300_000 + "Beta", "en", "a")] + [rows[0]] * 5
    monkeypatch.setattr(divergence, "SPILL", spill)
    table = spark.createDataFrame([(k, *r, "x", 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, docs int")
    got = divergence.source_divergences(table.repartition(5), least_docs=4, top=3, cells=cells).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_divergences(rows, 4, 3)


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(2000):
        total = rnd.randrange(10 ** rnd.randrange(1, 15))
        count, terms = rnd.randrange(total + 1), rnd.randrange(1, 10**6)
        assert divergence.shares(np.array([count]), np.array([total]), terms)[0] == 1 + (10**9 * (count + 5)) // (total + 5 * terms)


LONG = "Some long paragraph of real prose that goes on for a good while and says a few things."
PAGES = {
    "": "",
    "<p>1 < 2 &amp &lt;b&gt; <b>bo</b>ld<br>next&nbsp; line <!-- no <p>no</p> --><p>more<!-- open <p>no": "1 < 2 & <b> bold next line more",
    "<article><h1>The.</h1><p>The.</article>": "The. The.",
    f"<body><nav><a href=/>Home</a></nav><main><h1>T</h1><p>{LONG}<aside>no</aside><p>Hi.<section><h2>3 Comments</h2><p>{LONG} no</section></main><p>{LONG} no</body>": f"T {LONG} Hi.",
    f"<article><header><h1>T</h1></header><p>{LONG}</p><div class='readerComments'><article><p>{LONG} no</p></article></div><p>last</p></article>": f"T {LONG} last",
    f"<body><div class=wrap><div class='cookie-notice'>{LONG} no</div><div><p>{LONG} 1</p></div><div><p>x</p></div><div><p>{LONG} 2</p></div></div>": f"{LONG} 1 x {LONG} 2",
    f"<body><div><h1>T</h1><p>{LONG}<p>Hi.<p>{LONG}</div><div>Copyright us</div></body>": f"T {LONG} Hi. {LONG}",
    f"<article><p>{LONG}<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><ul><li>a <a>b</a></ul><form><p>no</form><p>x": f"{LONG} a b x",
    f"<script>var a = '</p>' + \"<p>{LONG}\";</script><style>p {{}}</style><p hidden>no<p style='display: none'>no<p title='a > b'>{LONG}": LONG,
    f"<p>{LONG}</p><p>cut <a hre": f"{LONG} cut",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b c",
    f"<body><div class=post><p>{LONG}</p><span class=ad>no</span></div><footer>&copy; no</footer></body>": LONG,
    f"<body class='no-sidebar'><article class='post has-comments'><p>{LONG}</p></article></body>": LONG,
}


def test_main_texts(spark):
    rows = [(k if k else None, "u", page, "t", 1) for k, page in enumerate([*PAGES, None, "<p>a</p>" * 300_000])]
    table = spark.createDataFrame(rows + [rows[1]], "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in pages.main_texts(table).collect())
    want = [*PAGES.values(), "", " ".join("a" * 300_000)]
    expected = [(k if k else None, "u", text, len(text)) for k, text in enumerate(want)]
    assert got == collections.Counter(expected + [expected[1]])


def test_main_texts_of_given_pages():
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S).group(1)
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article)]
        assert pages.main_text(row["html"]) == " ".join(" ".join(blocks).split())
