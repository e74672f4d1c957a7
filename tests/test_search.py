"""Exact search with pruning: equal to brute force, and something is pruned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import postings as PO
from quarry.operators import vectors as V


def brute(q, b, ids, k):
    out = {}
    for qid, x in q:
        d = np.floor(((b - x) ** 2).sum(1) * 1e9 + 0.5) / 1e9
        order = np.lexsort((ids, d))[:k]
        out[qid] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.id, r.dist))
    return got


def frames(spark, q, b, ids):
    base = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, b)], "id bigint, vec array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in q], "qid bigint, vec array<double>")
    return queries, base


def test_blocks_that_cannot_help_are_skipped(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 6)) * 30
    b = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 6))).round(3)
    b[2000:2300] = b[0]  # a group of equal vectors
    ids = rng.permutation(3000)
    q = [(k, b[k * 50] + 0.01) for k in range(40)] + [(99, np.zeros(6))]
    got, share = V.knn_search(*frames(spark, q, b, ids), k=7, query_block_rows=5, base_block_rows=100)
    assert answers(got) == brute(q, b, ids, 7)
    assert share["visited"] < 0.5 * share["pairs"]


def test_queries_travel_once_a_bundle(spark):
    """Also where every block is visited: as many copies of a query as bundles, not as blocks."""
    rng = np.random.default_rng(8)
    b = rng.normal(size=(2000, 24))
    queries, base = frames(spark, [(k, b[k]) for k in range(30)], b, np.arange(2000))
    index = V.build_index(base, 50)
    blocks, bundles = len(index.blocks.size), int(index.blocks.bundle.max()) + 1
    assert blocks > 4 * bundles and (np.diff(index.blocks.bundle) >= 0).all()
    far = V._visits(queries.withColumn("bound", F.lit(1e6)), index.blocks, 3, False)
    assert far.count() <= 30 * bundles and far.groupBy("qid", "bundle").count().filter("count > 1").isEmpty()
    assert answers(V.knn_topk(queries, base, 3, 7, 50)) == brute([(k, b[k]) for k in range(30)], b, np.arange(2000), 3)


@pytest.mark.parametrize("rows, k", [(3, 5), (1, 1), (40, 40)])
def test_fewer_rows_than_asked_for(spark, rows, k):
    rng = np.random.default_rng(6)
    b, ids = rng.integers(0, 3, (rows, 4)).astype(float), np.arange(rows)
    q = [(0, b[0]), (1, b[0] + 1)]
    assert answers(V.knn_topk(*frames(spark, q, b, ids), k=k, base_block_rows=8)) == brute(q, b, ids, k)


def test_empty_sides_and_rows_without_a_vector(spark):
    queries = spark.createDataFrame([(1, [1.0]), (2, None)], "qid bigint, vec array<double>")
    base = spark.createDataFrame([(1, [0.0]), (2, None)], "id bigint, vec array<double>")
    assert answers(V.knn_topk(queries, base, 2)) == {1: [(1, 1.0)]}
    assert V.knn_topk(queries, base.limit(0), 2).count() == 0
    assert V.knn_topk(queries.limit(0), base, 2).count() == 0


@pytest.mark.parametrize("in_a_key", [1 << 16, 5])
def test_inverted_index_against_all_pairs(spark, monkeypatch, in_a_key):
    monkeypatch.setattr(PO, "POSTINGS", in_a_key)
    rng = np.random.default_rng(7)
    n, terms, k = 120, 40, 5
    df = rng.random(terms) ** 3
    df[0] = 0.9  # nearly every row has the first term

    def vectors(rows):
        w = np.where(rng.random((rows, terms)) < df, rng.random((rows, terms)) + 0.1, 0.0)
        w[::17] = 0.0  # rows without terms
        return w / np.maximum(np.sqrt((w * w).sum(1, keepdims=True)), 1e-300)

    b, q = vectors(n), vectors(30)
    b[50:60] = b[49]
    q[3] = 0.0
    q[3, 39] = 1.0
    b[:, 39] = 0.0  # a term of a query only

    def long(m, key, w):
        return spark.createDataFrame([(i, f"t{j}", float(m[i, j])) for i, j in zip(*map(lambda a: a.tolist(), np.nonzero(m)))],
                                     f"{key} bigint, term string, {w} double")

    got = answers(PO.topk_unit(long(q, "qid", "q"), long(b, "id", "w"), spark.range(30).withColumnRenamed("id", "qid"),
                               spark.range(n), k))
    assert len(got) == 30
    for i in range(30):
        d = np.floor((2 - 2 * (b @ q[i])) * 1e9 + 0.5) / 1e9
        want = [(int(j), float(d[j])) for j in np.lexsort((np.arange(n), d))[:k]]
        assert [w for w, _ in got[i]] == [w for w, _ in want]
        assert np.allclose([x for _, x in got[i]], [x for _, x in want], atol=2e-9)


def test_terms_are_counted_in_their_rows(spark, tmp_path):
    """No exchange before the counts are stored; equal keys, nulls and empty rows as a plain count has them."""
    from collections import Counter

    from quarry.operators import text_features as TF

    rows = [(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["a"] * 5 + ["c"]), (5, ["", "z", ""])]
    for some in (rows, [*rows, (4, ["c", "d"]), (None, ["a"]), (None, ["a"])]):
        df = spark.createDataFrame(some, "k int, t array<string>")
        got, n = TF.term_counts(df, ["k"], F.col("t"))
        want = Counter((k, x) for k, t in some for x in t or () if x is not None)
        assert n == len(some) and {(r.k, r.term): r.tf for r in got.collect()} == dict(want)
    plan = TF.row_terms(df, ["k"], F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
