"""HTML extraction, whitening and importance resampling against independent twins."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sluicework.llm.queries")

from sluicework.llm import html_text, importance, queries, whitening  # noqa: E402

# ---- pages


def article(page):
    """The article of a given page, cut out by text search: its blocks between <p> and <h1> tags."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_given_pages_equal_their_articles(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        want = article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


LONG = "A paragraph that is long enough to be read as the text of a page, whatever stands around it."
PAGES = {
    f'<body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">{LONG}{LONG}</div><main><article><header><h1>Title</h1></header><p>{LONG}</p><p>x<br>y</p><ul><li>a<li>b</ul><aside>side</aside><form><p>mail</p></form><footer>share</footer></article><section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>': f"Title\n{LONG}\nx y\na\nb",
    f'<div class="page-with-sidebar"><div class="nav"><a href=x>home</a></div><div class="content"><h2>Head</h2><p>{LONG}<p>Short.<p>{LONG}</div><div class="widget">buy</div></div>': f"Head\n{LONG}\nShort.\n{LONG}",
    f"<table><tr><td><a href=1>menu</a> <a href=2>more</a><td><p>{LONG}</table>": LONG,
    f"<article><p>{LONG}<article><p>{LONG}</article></article>": LONG,
    f"<article><p>unclosed <b>bold <i>it</b> tail</i><p>{LONG}": f"unclosed bold it tail\n{LONG}",
    "<article>a &nbsp;b\n\tc<!-- no --> &lt;d&gt; &amp;amp; &#233;</article>": "a b c <d> &amp; é",
    '<article><p>To.</p></article><div class="ad">' + LONG + "</div>": "To.",
    "<article><pre>a\n b</pre><table><tr><th>h<td>d</table></article>": "a b\nh\nd",
    "plain &lt;text&gt;  only": "plain <text> only",
    "<ul><li><a href=1>one</a><li><a href=2>two</a></ul>": "one\ntwo",
    "<nav>menu</nav><script>var x = '<p>no</p>'</script><style>p{}</style>": "",
    f"<div hidden>{LONG}</div><p>{LONG} <button>press</button></p><template><p>no</p></template>": LONG,
    "": "",
    "</p></div><p>": "",
    None: "",
}


def test_hand_written_pages():
    for page, want in PAGES.items():
        assert html_text.main_text(page)[0] == want, page


def test_two_means_and_smoothing():
    assert html_text.dense([0.0, 0.1, 9.0, 8.0]) == [False, False, True, True] and html_text.dense([3.0, 3.0]) == [True, True] and html_text.dense([]) == []
    flat = html_text.smoothed([1.0] * 20)
    assert flat[10] == pytest.approx(1) and flat[0] < 0.75


def test_pages_with_odd_columns(spark):
    rows = [(i, k, "old", {"a": 1}, -1) for i, k in enumerate(PAGES)] + [(None, None, None, None, None)] + [(0, next(iter(PAGES)), "old", None, 5)]
    d = spark.createDataFrame(rows, "page_id long, html string, Text string, extra map<string,int>, N_lines int")
    out = html_text.extract(d)
    assert out.columns == ["page_id", "extra", "text", "n_chars", "n_blocks", "n_lines"]
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect())
    assert got == sorted((i is None, i or 0, PAGES[k], len(PAGES[k])) for i, k, *_ in rows)
    assert html_text.extract(d.where("false")).count() == 0


def test_very_long_page():
    page = "<nav>" + "<a href=x>y</a>" * 2000 + "</nav><article>" + f"<p>{LONG}</p>" * 5000 + "<p>" + "word " * 200_000 + "</article>"
    text, blocks, _ = html_text.main_text(page)
    assert blocks == 5001 and len(text) == 5000 * (len(LONG) + 1) + 5 * 200_000 - 1


# ---- vectors


def twin(vectors):
    """Rows by numpy's own eigensolver: (n, deviations, |whitened|, explained)."""
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    e, v = np.linalg.eigh(np.cov(u.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v[:, :4] / np.sqrt(e[:4]), e[:4] / e.sum()


def test_given_vectors_equal_numpy(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, white, share = twin([vectors[i] for i in ids])
    rows = queries.op12_whitening(spark, sf).collect()
    assert len(rows) == 4 * len(ids)
    got = np.zeros_like(white)
    for r in rows:
        k = ids.index(r["vec_id"])
        assert (r["n"], r["deviation"]) == (n, deviation[k]) and r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
        got[k, r["component"] - 1] = r["whitened"]
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-7


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_jacobi_equals_numpy(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d)) * 10.0 ** r.integers(-4, 4, d)
    a = a @ a.T
    e, v = whitening.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(v * e @ v.T, a, atol=1e-12 * abs(a).max())
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * abs(a).max()) and (np.diff(e) <= 0).all()


def test_jacobi_keeps_small_eigenvalues():
    """Graded matrices: small eigenvalues to full relative accuracy, which a solver of absolute accuracy doesn't give."""
    scale = np.diag([1.0, 1e-6, 1e-12])
    core = np.array([[1.0, 0.5, 0.2], [0.5, 1.0, 0.3], [0.2, 0.3, 1.0]])
    e, _ = whitening.jacobi(scale @ core @ scale)
    assert e[2] * e[1] * e[0] == pytest.approx(np.linalg.det(core) * 1e-36, rel=1e-12)


def test_vectors_that_are_odd(spark):
    nan, inf = float("nan"), float("inf")
    v = [[0.5, 1.0, -2.25], [0.1, 0.2, 0.3], [1.0, -1.0, 4.0], [0.1, 0.2, 0.3], [2.0, 0.0, 1.5]]
    rows = [(i, x, "keep", -1) for i, x in enumerate(v)] + [(None, v[0], None, None), (7, None, "", 0), (8, [1.0, None, 2.0], "", 0), (9, [nan, 1.0, 1.0], "", 0), (10, [inf, 1.0, 1.0], "", 0), (11, [1.0, 2.0], "", 0), (12, [], "", 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, extra string, N int").repartition(3)
    got = whitening.whiten(d).collect()
    n, deviation, white, share = twin(v)
    assert Counter(r["vec_id"] for r in got) == {i: 3 for i in [0, 1, 2, 3, 4, None]} and n == 4
    for r in got:
        k = r["vec_id"] or 0
        assert r["n"] == 4 and r["deviation"] == deviation[k] and r["extra"] == ("keep" if r["vec_id"] is not None else None)
        assert abs(r["whitened"]) == pytest.approx(abs(white[k][r["component"] - 1]), abs=1e-9)
    assert whitening.whiten(d.where("false")).count() == 0 and whitening.whiten(d.where("vec_id = 12")).count() == 0
    alone = whitening.whiten(d.where("vec_id in (1, 3)")).collect()
    assert len(alone) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in alone)


def test_vectors_beyond_the_grid(spark):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, -0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 6 and {r["vec_id"]: (r["n"], r["deviation"]) for r in got} == {0: (3, None), 1: (3, None), 2: (3, 768**2 + 1)}


# ---- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs=1):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, runs + 1) for i in range(len(w) - k + 1)], len(w)


def draws(docs, target, runs=1, least=20, percent=10):
    f = {i: features(t, runs) for i, t in docs}
    s, t = Counter(b for v, _ in f.values() for b in v), Counter(b for x in target for b in features(x, runs)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = {}
    for i, (v, _) in f.items():
        w = sum(map(gain, v))
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(v), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    apt = sorted((i for i in f if f[i][1] >= least), key=lambda i: (-out[i][2], i))
    for k, i in enumerate(apt[: percent * len(apt) // 100]):
        out[i][3] = k + 1
    return out


def test_given_documents_equal_a_loop(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in queries.op13_importance(spark, sf).collect()}
    assert got == draws(docs, target)


@pytest.mark.parametrize("runs", [1, 3])
def test_documents_that_are_odd(spark, runs, monkeypatch):
    text = "The quick, brown-fox 42 ÉTÉ naïve 北京大学 x_y Z" + "z" * 300
    rows = [(i, " ".join([text] * (i % 5)) + f" w{i}" * (i % 40), "keep", 9) for i in range(150)] + [(200, None, None, None), (201, "", "", 0), (202, "...", "", 0), (203, "q" * 100_000, "", 0), (204, "a b " * 50_000, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra string, Weight int").repartition(4)
    target = spark.createDataFrame([(text,), (None,), (text,)], "text string")
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in importance.resample(d, target, runs=runs).collect()}
    assert got == draws([r[:2] for r in rows], [text, text], runs)


def test_words_at_borders():
    """Words and texts on the borders of pieces, sliced and null entries."""
    import pyarrow as pa

    texts = ["ab", None, "cd", "ef gh", "", "x" * 50, " y", "é", "北京"]
    column = pa.array(["skip me", *texts]).slice(1)
    for piece in (1, 2, 3, 7, 1000):
        importance.PIECE = piece
        data, at = importance.buffers(column)
        starts, ends = importance.words(data, at)
        assert [bytes(data[a:z]).decode() for a, z in zip(starts, ends, strict=True)] == ["ab", "cd", "ef", "gh", "x" * 50, "y", "é", "北京"], piece
    importance.PIECE = 4 << 20


def test_resampling_edges(spark):
    d = spark.createDataFrame([(None, "w " * 30), (1, "w " * 30), (1, "w " * 30), (2, "w " * 19)], "doc_id long, text string")
    none = d.where("false")
    got = importance.resample(d, none, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and [r["rank"] for r in got if r["doc_id"] == 2] == [None]
    assert importance.resample(none, d.select("text")).count() == 0
    assert importance.resample(d, d.select("text"), percent=0).where(F.col("rank").isNotNull()).count() == 0
