"""Operator 10 on tables whose pages are all long, or nearly all empty."""

from quarry.llm import extract

PAGES = "page_id long, url string, html string"


def page(k, words):
    text = "".join(f"<p>{' '.join(f'w{k}x{i}y{j}' for j in range(40))}.</p>" for i in range(words // 40))
    return (f'<html><body><nav><ul><li><a href="/">Home {k}</a></li></ul></nav><article><h1>Title {k}</h1>{text}</article>'
            f"<footer>copyright {k}</footer></body></html>")


def test_op10_long_pages_only(spark, write):
    rows = [(k, "u", page(k, 5000)) for k in range(12)]
    assert min(len(r[2]) for r in rows) > 30_000
    got = extract.op10_dom_boosted_extract(spark, write("pages", rows, PAGES)).collect()
    assert all(f"w{r.page_id}x0y0 " in r.text and f"w{r.page_id}x124y39." in r.text for r in got) and len(got) == 12


def test_op10_sample_is_bounded_in_total(spark):
    df = spark.createDataFrame([(k, "u", page(k, 2000)) for k in range(10)], PAGES)
    size = len(page(0, 2000))
    assert 2 <= len(extract.sample(df, chars=3 * size)) <= 3
    assert len(extract.sample(df, chars=10)) == 1  # none fits: still a page
    assert len(extract.sample(df, pages=4)) == 4


def test_op10_few_pages_among_empty_ones(spark):
    """The share of a large table is taken of the pages with text; equal ids are no gap."""
    rows = [(k, "u", page(k, 80) if k % 400 == 7 else None) for k in range(4000)] + [(None, "u", page(1, 80))]
    df = spark.createDataFrame(rows, PAGES)
    assert len(extract.sample(df, pages=2)) == 2
    same = spark.createDataFrame([(5, "u", page(k, 40)) for k in range(300)], PAGES)
    assert len(extract.sample(same, pages=3)) == 3
