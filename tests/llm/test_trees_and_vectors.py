"""HTML extraction, the Merkle manifest and whitening: built pages, brute force, numpy."""

import hashlib
import html
import math
import string
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import extract, manifest, whitening
from corpuscope.llm.extract import main_text

PROSE = "The quick brown fox, which was not lazy, jumped over the fence & ran along the river until night fell. "


# -- extraction -----------------------------------------------------------------------------
def page(blocks, wrap, menu=5, side="", tail=""):
    """A page around ``blocks`` (tag, text) and the text that should come back."""
    body = "".join(f"<{t}>{html.escape(x)}</{t}>" for t, x in blocks)
    links = "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(menu))
    return (f"<!DOCTYPE html><html><head><title>No title</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header>"
            f"<nav><ul>{links}</ul></nav>{wrap[0]}{body}{wrap[1]}{side}<footer>&copy; all rights</footer>{tail}</body></html>"), "\n".join(" ".join(x.split()) for _, x in blocks if x.split())


WRAPS = [("<article>", "</article>"), ('<div id="content">', "</div>"), ('<main><div class="post-body">', "</div></main>"),
         ('<form id="f"><div class="entry"><article>', "</article></div></form>"), ('<div class="x1"><section>', "</section></div>")]
SIDES = ["", f"<aside><p>{PROSE}</p></aside>", f'<div class="sidebar"><p>{PROSE * 3}</p></div>', f'<div id="comments"><div class="comment"><p>{PROSE * 9}</p></div></div>',
         '<div class="cookie-notice">We use cookies, as all do.</div>', f"<form><p>{PROSE}</p><input><button>Send</button></form>",
         f'<div class="related"><a href="x">{PROSE}</a></div>', f"<!-- {PROSE} --><noscript>{PROSE}</noscript>"]


@settings(max_examples=120, deadline=None)
@given(st.sampled_from(WRAPS), st.lists(st.sampled_from(SIDES), max_size=3), st.lists(
    st.tuples(st.sampled_from(["p", "p", "p", "blockquote", "pre", "h2"]), st.integers(1, 6), st.text(alphabet="ab <&>é\n ", max_size=8)), min_size=2, max_size=9))
def test_built_pages_come_back(wrap, sides, blocks):
    blocks = [("h1", "The Title")] + [(t, PROSE * n + extra) for t, n, extra in blocks]
    source, expected = page(blocks, wrap, side="".join(sides))
    assert main_text(source) == expected


@pytest.mark.parametrize("source, expected", [
    (None, ""), ("", ""), ("plain, no tags &amp; so on", "plain, no tags & so on"),
    ("<article><p>Hi <script>if(a<b)write('<p>no</p>')</script>there 3 < 4 &lt;t&gt; &eacute;&#65;&#x42;</p></article>", "Hi there 3 < 4 <t> éAB"),
    ("<div><p>text <a href='x", "text"), ("<p>a</p><!-- never <p>b</p>", "a"),
    ("<article><h1>T.</h1><p><b>T.<br><p>two<p>th<i>re</i>e</article>", "T.\nT.\ntwo\nthree"),
    ("<ARTICLE><P>Upper\n\t case<BR>line<ul><li>a<li>b</ul></ARTICLE>", "Upper case line\na\nb"),
    ("<article><table><tr><td>c1<td>c2<tr><td>c3</table><p hidden>no</p><p style='display: none'>no</p></article>", "c1\nc2\nc3"),
    ("<body><div class='post'><p>Short.</p></div><div class='comments'>" + f"<p>{PROSE}</p>" * 9 + "</div></body>", "Short."),
    (f"<div class='article'><div class='article-header'><h1>Mine</h1></div><div class='article-body'><p>{PROSE}</p><p>{PROSE}</p></div></div>",
     f"Mine\n{PROSE.strip()}\n{PROSE.strip()}"),
    (f"<div class='wrapper has-sidebar'><div class='page-header'>Site</div><div class='widget-post-content'><h2>T</h2><p>{PROSE}</p><p>{PROSE}</p></div>"
     f"<div class='sidebar'><p>{PROSE}</p></div></div><div id='bottom'>Copyright</div>", f"T\n{PROSE.strip()}\n{PROSE.strip()}"),
    (f"<div id=a><div id=b><h2>T</h2><p>{PROSE}</p><p>{PROSE}</p><section><h3>12 Comments:</h3><p>{PROSE * 5}</p></section></div></div>", f"T\n{PROSE.strip()}\n{PROSE.strip()}"),
    (f"<article><p>{PROSE}</p><ul><li><a href=a>See also this</a><li><a href=b>and that</a></ul></article>", PROSE.strip()),
])
def test_pages(source, expected):
    assert main_text(source) == expected


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "x", "<p>" + "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>a" * 100_000, "<script" * 100_000, '<a "' * 100_000,
                                    '<a b="' * 100_000 + ">", "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<p>" + "word, " * 3_000_000, "&" * 500_000, "<" * 500_000])
def test_parsing_is_linear(source):
    began = time.time()
    main_text(source)
    assert time.time() - began < 10


def test_extract_rows(spark):
    rows = [(1, "u", "<p>one</p>", "old", 5), (1, "u", "<p>one</p>", "old", 5), (2, None, None, None, None), (None, "v", "", "x", 1)]
    got = extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "u", "one", 3), (1, "u", "one", 3), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


# -- manifest -------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h(*(enc(v) for v in (r[0], r[3], r[2], r[4], text)))


def tree(nodes, fanout):
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p // fanout * fanout
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + fanout])))
            place[i] = p // fanout
        nodes = [h(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def proofs(rows, fanout=8):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    for own in by_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    lower = {x: tree([leaf(r, r[1]) for r in by_lang[x]], fanout) for x in langs}
    root, upper = tree([lower[x][0] for x in langs], fanout) if langs else (None, [])
    fold = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    out = []
    for lang, up in zip(langs, upper):
        for r, low in zip(by_lang[lang], lower[lang][1]):
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(fold)
            node = leaf(r, text)
            for before, after in low + up:
                node = h(before, node, after)
            out.append((r[0], leaf(r, r[1]), lower[lang][0], root, h(*(a + b for a, b in low + up)), node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
TABLE = "doc_id long, text string, lang string, source string, n_chars long, digest string, lo int"


def proved(spark, rows, fanout=8):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], TABLE)
    return sorted(map(tuple, manifest.prove_rows(frame, fanout).select(COLUMNS).collect()), key=repr)


def test_manifest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    langs = ["en"] * 6 + ["de", "fr", None, "É", "z" * 40]
    rows = [(int(rng.integers(0, 400)) if i % 50 else None, f"Text {i % 90} ÄB" if i % 7 else None, langs[i % len(langs)], "s" if i % 5 else None, i % 9 if i % 4 else None)
            for i in range(700)]
    rows += [(5, "Hot row", "en", "s", 7)] * 300  # one row a third of its lang
    assert proved(spark, rows) == proofs(rows)


@pytest.mark.parametrize("n, fanout", [(1, 8), (2, 8), (8, 8), (9, 8), (65, 8), (30, 2)])
def test_manifest_shapes(spark, n, fanout):
    rows = [(i, "A" * i, "x", "", i) for i in range(n)]
    assert proved(spark, rows, fanout) == proofs(rows, fanout)


def test_manifest_many_langs_and_none(spark):
    rows = [(i, f"T{i}", f"l{i:03}", "s", i) for i in range(70)]
    assert proved(spark, rows) == proofs(rows)
    assert manifest.prove_rows(spark.createDataFrame([], TABLE)).count() == 0


def test_manifest_intervals(spark):
    rows = [(i, "t", "x", "s", i) for i in range(75)]
    nodes = manifest.tree_nodes(spark.createDataFrame([(*r, "", 0) for r in rows], TABLE)).collect()
    assert {(r.level, r.lo, r.hi) for r in nodes if r.level} == {(1, a, min(a + 7, 74)) for a in range(0, 75, 8)} | {(2, 0, 63), (2, 64, 74), (3, 0, 74)}


# -- whitening ------------------------------------------------------------------------------
def numpy_whitening(x, k):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, (x - s / n) @ q / np.sqrt(e), e / np.trace(v), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = np.round(rng.standard_normal((400, 20)) * np.linspace(0.1, 1, 20), 3)
    data = np.concatenate((data, np.repeat(data[:1], 200, axis=0)))  # a hot vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(data)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 3, 1), (903, [None] + [0.0] * 19, 1), (904, [math.nan] * 20, 1), (905, [math.inf] * 20, 1), (None, data[3].tolist(), 1)]
    got = whitening.whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()
    x = np.floor(64 * data).astype(np.int64)
    n, white, share, deviation = numpy_whitening(x, 16)
    assert len(got) == 601 * 16 and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    mine = np.zeros((600, 16))
    for r in got:
        if r.vec_id is not None:
            mine[r.vec_id, r.component - 1] = r.whitened
            assert r.deviation == deviation[r.vec_id]
            assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine - white * sign).max() < 1e-9
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_little(spark):
    def run(rows):
        return whitening.whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = run([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])
    assert len(got) == 3 and {r.explained for r in got} == {1.0} and {abs(r.whitened) for r in got} == {1.0}


def test_whitening_of_large_entries(spark):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((50, 3)) * 1e12
    got = whitening.whiten_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")).collect()
    x = np.array([[math.floor(64 * c) for c in v] for v in data], object)
    s = x.sum(axis=0)
    for r in got:
        exact = sum(int(d) ** 2 for d in 50 * x[r.vec_id] - s)
        assert r.deviation == (exact if exact < 1 << 63 else None)
    assert len(got) == 150 and max(r.identity_error for r in got) < 1e-9


def test_polynomial_is_exact(spark):
    b = np.random.default_rng(7).integers(-9, 10, (6, 8))
    a = (b.T @ b).astype(object)
    poly = whitening.characteristic_polynomial(spark, a)
    for t in range(-4, 5):  # nine points fix a polynomial of degree eight
        m = [[int(t * (i == j) - a[i, j]) for j in range(8)] for i in range(8)]
        assert whitening.value(poly, t) == determinant(m)


def determinant(m):
    """Fraction-free elimination."""
    m, sign, last = [row[:] for row in m], 1, 1
    for k in range(len(m) - 1):
        if m[k][k] == 0:
            swap = next((i for i in range(k + 1, len(m)) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, len(m)):
            for j in range(k + 1, len(m)):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // last
        last = m[k][k]
    return sign * m[-1][-1]


def test_equal_and_zero_roots(spark):
    d = np.diag([5, 5, 5, 3, 3, 0, 0]).astype(object)
    roots = whitening.rounded_roots(whitening.characteristic_polynomial(spark, d), 7)
    assert [round(float(r), 12) for r in roots] == [5, 5, 5, 3, 3]
    v = whitening.null_vectors(d, roots, roots[0]).astype(float)
    assert np.abs(v @ v.T - np.eye(5)).max() < 1e-15
    assert np.abs(v @ d.astype(float) @ v.T - np.diag([5, 5, 5, 3, 3])).max() < 1e-14
