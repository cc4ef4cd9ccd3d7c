"""Nearest neighbours, page extraction and the pipeline."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediafuse.llm import block_labeller, html_extract, nearest
from mediafuse.llm.html_blocks import blocks
from mediafuse.llm.html_layouts import Pages


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[j], ids[j]))[:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_order_and_ties(spark, scratch, scaled, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_VECTORS", 64)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 8)
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= r.uniform(0.7, 1.0, (600, 1)).astype(np.float32)
    x[100:160] = x[100]
    ids = np.arange(600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = nearest.nearest(df, scratch, F.col("vec_id") % 20 == 0).toPandas().sort_values(["query_id", "rank"])
    want = brute(ids, x.astype(np.float64), 20)
    hits = sum(len(set(g.vec_id) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / sum(map(len, want.values())) >= 0.9
    for _, g in got.groupby("query_id"):
        assert list(g["rank"]) == list(range(1, 21)) and list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
    assert list(got[got.query_id == 100].vec_id)[:20] == list(range(101, 121))
    assert np.allclose(got.score, [x[q].astype(float) @ x[v].astype(float) for q, v in zip(got.query_id, got.vec_id)], atol=1e-12)


def test_unequal_norms_and_few_vectors_keep_recall(spark, scratch):
    r = np.random.default_rng(7)
    x = r.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one_long, spread = x.copy(), x * r.lognormal(0, 0.5, (1500, 1))
    one_long[7] *= 100
    for v, least in ((one_long, 0.9), (spread, 0.9), (r.standard_normal((15, 64)), 1.0)):
        ids = np.arange(len(v))
        df = spark.createDataFrame([(int(i), w.tolist()) for i, w in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
        found = {}
        for row in nearest.nearest(df, scratch, F.col("vec_id") % 20 == 0).collect():
            found.setdefault(row.query_id, set()).add(row.vec_id)
        want = brute(ids, v, 20)
        assert {q: len(f) for q, f in found.items()} == {q: len(w) for q, w in want.items()}
        assert sum(len(found[q] & set(w)) for q, w in want.items()) >= least * sum(map(len, want.values()))


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0, 2.0])
def test_recall_whatever_the_spread_of_norms(spark, scratch, spread):
    """Random directions, the hardest for an index by angle, with norms of that lognormal spread."""
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 64))
    x *= (np.exp(spread * r.standard_normal(3000)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for row in nearest.nearest(df, scratch, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(row.query_id, set()).add(row.vec_id)
    want = brute(np.arange(3000), x, 20)
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in want.items()]) >= 0.9


def test_vectors_that_take_no_part(spark, scratch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id").collect()) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch, F.lit(True)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><div class="cookie-banner"><p>We use cookies. Accept</p></div><header class="site-header"><a href="/">Daily Site</a></header>
<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><aside class="sidebar"><h3>Related posts</h3><ul><li><a href=z>Other story</a></li></ul></aside><!-- ad --><div class="ad">Buy now and save</div>
<article><h1>Caf&eacute; &amp; more</h1><p>First   paragraph with\n some <b>bold</b> words &#8212; and an end.<p>Second paragraph of the story<br>goes on here for a while.</p><ul><li>A point that matters in the story.</li></ul></article>
<form><label>Email</label><input><button>Send</button></form><section id="comments"><h3>Comments</h3><div class="comment"><p>Great post, thanks!</p></div></section><footer>&copy; 2024 Daily Site. All rights reserved.</footer></body></html>"""
MAIN = "Café & more First paragraph with some bold words — and an end. Second paragraph of the story goes on here for a while. A point that matters in the story."


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, None, "<article><p>Only &am"), (6, "u", "<article>" + "<p>A sentence of the long story goes here.</p>" * 3000 + "</article>"), (None, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_kept": F.lit(0)})
    got = {r.page_id: r for r in html_extract.extract(df, keep=["page_id", "url"]).collect()}
    assert got[1].text == MAIN and got[1].n_chars == len(MAIN) and got[None].text == MAIN
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[5].text == "Only &am"
    assert got[6].text == " ".join(["A sentence of the long story goes here."] * 3000)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_labeller_on_pages_it_has_not_seen():
    pages = block_labeller.labelled_pages(150, 4242)
    found = block_labeller.trained().predict([b for b, _ in pages])
    right = np.concatenate([(p > 0.5) == (y > 0.5) for p, (_, y) in zip(found, pages, strict=True)])
    assert right.mean() > 0.98


@pytest.mark.parametrize("names", ["invented", "none"])
def test_labeller_on_layouts_without_names_that_tell(names, monkeypatch):
    """Held-out pages on which every element has an invented name, or none, the article's wrapper included."""
    class Unnamed(Pages):
        def page(self):
            choice, self.r.choice = self.r.choice, lambda c: names if "own" in c else choice(c)
            try:
                return super().page()
            finally:
                self.r.choice = choice
    monkeypatch.setattr(block_labeller, "Pages", Unnamed)
    pages = block_labeller.labelled_pages(150, 777)
    found = block_labeller.trained().predict([b for b, _ in pages])
    right = np.concatenate([(p > 0.5) == (y > 0.5) for p, (_, y) in zip(found, pages, strict=True)])
    assert right.mean() > 0.95


@pytest.mark.parametrize("wrapper", ['<div class="x-7">', '<div class="c1">', '<div id="css-1ab9zq">', "<table><tr><td>", "<div>", ""])
def test_an_article_is_kept_whatever_it_lies_in(wrapper):
    story = "<h1>Reko lami doto sa</h1>" + "".join(f"<p>Paragraph {i} of the story runs on for a good number of words, as they do in prose.</p>" for i in range(2))
    links = "".join(f"<li><a href=/{i}>Tulo {i}</a></li>" for i in range(6))
    close = {"<t": "</td></tr></table>", "<d": "</div>", "": ""}[wrapper[:2]]
    page = blocks(f'<html><body><div class="menu"><ul>{links}</ul></div>{wrapper}{story}{close}<div><ul>{links}</ul></div><div class="footer">Copyright 2024</div></body></html>')
    kept = block_labeller.trained().predict([page])[0] > 0.5
    assert kept.tolist() == [False] * 6 + [True] * 3 + [False] * 7


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_main_text_of_the_table_is_what_lies_in_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages, keep=["page_id"]).collect()}
    same = [got[r.page_id] == " ".join(b.text for b in blocks(r.html or "") if any(t == "article" and "comment" not in n for t, n in b.path)) for r in pages.collect()]
    assert len(same) == len(got) and sum(same) >= 0.99 * len(same)


def test_long_pages_are_labelled_as_others(monkeypatch):
    page = blocks("<nav><a>Home</a></nav><article>" + "".join(f"<p>A sentence number {i} of the story goes here.</p>" for i in range(60)) + "</article><footer>&copy; x</footer>")
    whole = block_labeller.trained().predict([page])[0]
    monkeypatch.setattr(block_labeller, "CHUNK", 7)
    assert np.allclose(block_labeller.trained().predict([page])[0], whole, atol=1e-5)


def test_blocks_of_broken_markup():
    text = lambda h: [b.text for b in blocks(h)]
    assert text('<p class="x>Hello world</p><p>b') == ["Hello world", "b"] and text('<p class="x>Hello <a href="y">link</a></p>') == ["Hello link"]
    assert text('<p title="a > b">c</p><p data-h="<b>x</b>">d</p>') == ["c", "d"] and text("<select>" * 20000 + "<p>e") == ["e"]
    assert [b.text for b in blocks("a<p>b<p>c</div>d<br>e <i>f</i>g<script>no<td>")] == ["a", "b", "c", "d e fg"]
    for n in (10, 1900, 2100, 100_000):
        assert text(f'<p><img alt="x > y {"z " * n} < q">a <b title=\'< {"z" * n} >\'>b</b></p>') == ["a b"]
    assert blocks("") == [] and blocks("<!-- x") == [] and [b.text for b in blocks("<p>1 < 2 &lt; 3</p>")] == ["1 < 2 < 3"]


def test_pipeline_stages_take_effect(spark, tmp_path):
    words = lambda s, n=80: " ".join(f"w{i}" for i in np.random.default_rng(s).integers(0, 900, n))
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(i, f"Shared menu line\n{words(i)}", "en", "a", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "a", 0), (101, rows[4][1] + " w1", "en", "b", 0), (102, f"{words(500)} {item}", "en", "c", 0), (103, "12 34", "en", "a", 0), (104, None, "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert set(left["language"]) == {*range(30), 100, 101, 102}
    assert left["lines"][0].text == words(0) and left["lines"][0].n_chars == len(words(0)) and left["lines"][101].text.startswith("Shared")
    assert set(left["near_duplicates"]) == {*range(30), 102} and set(left["benchmark"]) == set(left["packing"]) == set(range(30))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(30))
