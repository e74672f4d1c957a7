"""Operator 10 on tables whose pages don't use article elements."""

import html
import re

import numpy as np
import pytest

from quarry.llm import dom, extract

PAGES = "page_id long, url string, html string"


def article(h):
    a = h[h.index("<article>"): h.index("</article>")]
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", a)).split())


@pytest.mark.parametrize("begin, end", [
    ('<div class="content">', "</div>"), ("<div>", "</div>"), ("<main>", "</main>"), ('<div role="main">', "</div>"),
    ('<section itemprop="articleBody">', "</section>"), ('<td id="x7">', "</td>")])
def test_op10_renamed_articles(spark, sf, write, begin, end):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    want = {r.page_id: article(r.html) for r in rows}
    other = [(r.page_id, r.url, r.html.replace("<article>", begin).replace("</article>", end)) for r in rows]
    got = {r.page_id: r.text for r in extract.op10_dom_boosted_extract(spark, write("pages", other, PAGES)).collect()}
    assert got == want


def test_main_parts_by_what_a_page_says():
    def tags(h):
        page = dom.parse(h)
        roots, how = extract.main_roots(page)
        return how, [page.tags[i] for i in roots]

    side = "<div class=sidebar><p>" + "much " * 200 + "</p></div>"
    assert tags(f"<body>{side}<article><p>a</p></article><main>x</main></body>") == ("article", ["article"])
    assert tags(f"<body>{side}<main><p>a</p></main></body>") == ("main", ["main"])
    assert tags(f'<body>{side}<div role="article"><p>a</p></div></body>') == ("main", ["div"])
    assert tags(f"<body>{side}<section><h1>T</h1><p>a text</p><p>of <b>two</b></p></section></body>") == ("densest", ["section"])
    assert tags("<body><nav><a>x</a></nav></body>") == ("densest", [])
    assert tags("") == ("densest", [])


def test_off_parts_inside_a_main_element():
    page = dom.parse("<main><p>a</p><aside><p>b</p></aside><div class='comments'>c</div><p>d</p></main>")
    y = extract.labels(page)
    kept = dom.kept_text(page, y > 0)
    assert kept == "a d"


def test_guesses_teach_only_where_most_pages_say_nothing():
    known = "<body><article><p>{}</p></article><footer>f</footer></body>"
    guess = "<body><div><p>{}</p></div><footer>f</footer></body>"
    words = " ".join(f"w{k}" for k in range(60))
    x, y = extract.examples([known.format(words)] * 2 + [guess.format(words)])
    z, _ = extract.examples([known.format(words)] * 2)
    assert len(x) == len(z) and np.array_equal(x, z) and y.any()
    x, y = extract.examples([guess.format(words)] * 2 + [known.format(words)])
    assert len(x) > len(z)
