"""Operator 10 on real, held-out and odd pages; the pipeline against brute force."""

import html
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import bpe, dom, extract, language, mixing, neardup, quality

PAGES = "page_id long, url string, html string, main_text string, extra int"


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), pages=120)


def article(h):
    a = h[h.index("<article>"): h.index("</article>")]
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", a)).split())


def test_op10_whole_table(spark, sf):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in extract.op10_dom_boosted_extract(spark, sf).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_op10_other_layouts(spark, model):
    """Layouts of pages that training has not seen."""
    r, found, right = random.Random(99), [], 0
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id >= 2000").limit(150).collect()
    for row in rows:
        page = dom.parse(row.html)
        other = dom.parse(extract.variant(page, extract.labels(page) > 0, r))
        keep = extract.labels(other) > 0
        other.words = [tuple(w for w in ws if not w.startswith("xx")) for ws in other.words]
        a = dom.kept_text(other, extract.decode(other.parents, model.score(dom.features(other)))).split()
        b = dom.kept_text(other, keep).split()
        found.append(2 * sum((Counter(a) & Counter(b)).values()) / max(1, len(a) + len(b)))
        right += a == b
    assert np.mean(found) > 0.9 and right > 0.75 * len(rows)


def test_op10_odd_pages(spark, write, model):
    page = ('<html><body><nav><a href="/">Home</a></nav><article><h1>T &amp; x</h1><p>One <b>bo</b>ld,\n two&lt;3.<p>Next<br>line'
            '<script>var t="</p>";</script><!-- no --></article><footer>&copy; me</footer></body></html>')
    deep = "<div>" * 3000 + "x"
    rows = [(1, "u", page, "clash", 1), (1, "u", page, "clash", 1), (2, None, None, None, None), (3, "", "", None, None),
            (4, "u", "<p", None, None), (5, "u", deep, None, None), (6, "u", "</b></p><td>", None, None),
            (7, "u", page.replace("One", "One " * 20000), None, None), (None, None, "<!-- open", None, None)]
    df = spark.read.parquet(write("pages", rows, PAGES) + "/pages.parquet")
    out = extract.extract(df, model)
    assert out.columns == ["page_id", "url", "extra", "main_text"]
    got = [(r.page_id, r.main_text) for r in out.collect()]
    assert len(got) == len(rows)
    assert got.count((1, "T & x One bold, two<3. Next line")) == 2
    assert dict(got)[2] == "" and dict(got)[3] == "" and len(dict(got)[7]) > 60000


def test_op10_empty_table(spark, write):
    assert extract.op10_dom_boosted_extract(spark, write("pages", [], PAGES)).count() == 0
    got = extract.op10_dom_boosted_extract(spark, write("pages", [(1, "u", None, None, None)], PAGES)).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)]


def test_decoding_is_the_cheapest_consistent_choice():
    r = np.random.default_rng(3)
    for _ in range(40):
        n = int(r.integers(1, 8))
        parents = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        score = r.normal(size=n) * 2
        cost = {1: np.logaddexp(0, -score), 0: np.logaddexp(0, score), 2: np.logaddexp(0, score)}
        best = None
        for code in range(3 ** n):
            s = [code // 3 ** i % 3 for i in range(n)]
            if s[0] == 0 or any(p >= 0 and (s[p] == 0 and s[i] or s[p] == 1 and s[i] == 2) for i, p in enumerate(parents)):
                continue
            c = sum(cost[x][i] for i, x in enumerate(s))
            if best is None or c < best:
                best = c
        inside = extract.decode(parents, score)
        # the same cost with the states that the answer implies
        got = sum(cost[1][i] if inside[i] else cost[0][i] for i in range(n))
        assert abs(got - best) < 1e-9


def test_pipeline_against_its_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.op6_quality_rules(spark, sf).filter("kept").collect()}
    step = docs.filter(docs.doc_id.isin(list(good)))
    names = [n for n, _ in corpus_pipeline.STAGES]
    fs = dict(corpus_pipeline.STAGES)
    first = fs[names[0]](spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    pred = language.identify(step.select("doc_id", "text"), language.train(step)).collect()
    sure = {r.doc_id for r in pred if r.lang_pred != "und" and r.score >= language.MIN_SCORE}
    step = docs.filter(docs.doc_id.isin(list(sure)))
    alone = {r.doc_id for r in neardup.near_duplicates(step).filter("kept").collect()}
    step = docs.filter(docs.doc_id.isin(list(alone)))
    chosen = {r.doc_id for r in mixing.select_mix(step, corpus_pipeline.MIX).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == chosen and 0 < len(chosen) < len(alone)
    memo = bpe.model(bpe.tokenizer_path())[1]
    assert all(bytes(r.ids) == memo.ids_of([rows[d].text])[0].tobytes() for d, r in got.items())


def test_pipeline_on_an_empty_table(spark, write):
    sf = write("documents", [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, sf).count() == 0
