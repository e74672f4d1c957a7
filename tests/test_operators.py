"""Operator-level properties on tiny inputs: null semantics, ties,
duplicate keys, round trips."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.operators import profile as P
from quarry.operators import ranking as RK
from quarry.operators import raster as RA
from quarry.operators.graph import reachability
from quarry.operators.vectors import knn_topk


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    idx = RK.sequential_id(df, ["k"]).collect()
    assert sorted((r["id"], r["k"]) for r in idx) == [(i + 1, i) for i in range(1000)]


def test_exact_quantiles_interpolate(spark):
    df = spark.range(0, 60).select(F.col("id").cast("double").alias("v"))
    q = {r["q"]: r["value"] for r in P.exact_quantiles(df, ["v"], [0.25, 0.5, 0.75]).collect()}
    assert q == {0.25: 14.75, 0.5: 29.5, 0.75: 44.25}


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (None, None)], "a int, b string")
    got = {r["column"]: r["n_null"] for r in P.null_counts(df).collect()}
    assert got == {"a": 2, "b": 2}


def test_histogram_last_bin_closed_and_empty_bins_kept(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,)], "v double")
    got = {r["bin"]: r["n"] for r in P.histogram_bins(df, "v", 5).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 2}


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in P.correlation_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and abs(got[("a", "a")] - 1.0) < 1e-12


def test_lookup_last_wins_needs_ordinal(spark):
    df = spark.createDataFrame([("k", 6, 1), ("k", 4, 2), ("j", 1, 1)], "key string, v int, ord int")
    got = {r["key"]: r["v"] for r in J.build_lookup_last_wins(df, "key", "v", "ord").collect()}
    assert got == {"k": 4, "j": 1}


def test_keyword_classify_priority(spark):
    rules = spark.createDataFrame([(2, "b", "x"), (1, "a", "yy"), (3, "c", "")], "p int, l string, k string")
    df = spark.createDataFrame([("xyy",), ("x",), ("q",)], "t string")
    got = [r["intent"] for r in J.keyword_classify(df, F.col("t"), rules, "none").collect()]
    assert got == ["a", "b", "c"]  # empty keyword matches everything at the lowest priority


def test_latest_per_key_tie_break(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 10, 7), (2, 3, 1)], "k int, ts int, id int")
    got = {r["k"]: r["id"] for r in RK.latest_per_key(df, ["k"], ["ts", "id"], ["id"]).collect()}
    assert got == {1: 7, 2: 1}


def test_take_until_sentinel(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "stop"), (1, 3, "b"), (2, 1, "c")], "k int, o int, e string")
    got = sorted((r["k"], r["o"]) for r in RK.take_until_sentinel(df, "k", ["o"], F.col("e") == "stop").collect())
    assert got == [(1, 1), (2, 1)]


def test_reachability_min_hops_on_cycle(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,)], "node bigint")
    got = {r["node"]: r["hop"] for r in reachability(edges, seeds).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_knn_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(40, 4)).round(3)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id bigint, vec array<double>")
    q = base.withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rank"]): r["id"] for r in knn_topk(q, base, k=3, base_block_rows=8).collect()}
    for i in range(40):
        d = ((vecs - vecs[i]) ** 2).sum(1)
        order = sorted(range(40), key=lambda j: (d[j], j))[:3]
        assert [got[(i, r + 1)] for r in range(3)] == order


def test_morphology_bounds_and_translation_identity(spark):
    rows = [(0, 0, y, x, (y * 5 + x * 3) % 17) for y in range(5) for x in range(5)]
    r = spark.createDataFrame(rows, "img bigint, ch int, y int, x int, v int")
    ero = {(a["y"], a["x"]): a["v"] for a in RA.morph(r, "erode", 1).collect()}
    dil = {(a["y"], a["x"]): a["v"] for a in RA.morph(r, "dilate", 1).collect()}
    for (_, _, y, x, v) in rows:
        assert ero[(y, x)] <= v <= dil[(y, x)]
    same = {(a["y"], a["x"]): a["v"] for a in RA.translate(r, 0, 0).collect()}
    assert same == {(y, x): v for (_, _, y, x, v) in rows}


def test_split_merge_round_trip(spark):
    rows = [(0, c, 0, x, c * 10 + x) for c in range(3) for x in range(3)]
    r = spark.createDataFrame(rows, "img bigint, ch int, y int, x int, v int")
    back = RA.merge_channels(RA.split_channels(r))
    assert sorted(map(tuple, back.select("img", "ch", "y", "x", "v").collect())) == sorted(rows)


def _boxes(rnd, n, images):
    """Negative and real coordinates, ties, boxes without an area; the first image is the hot one."""
    return [(i, rnd.randrange(images) if i % 2 else 0, rnd.choice([rnd.randrange(-20, 20), rnd.uniform(-20, 20)]) * 1.0,
             rnd.randrange(-5, 40) * 1.0, rnd.choice([0.0, 0.5, rnd.randrange(1, 15) * 1.0]),
             rnd.choice([0.0, -1.0, 3.0, rnd.uniform(1, 15)])) for i in range(n)]


_BOX = "id bigint, img bigint, x double, y double, w double, h double"


@pytest.mark.parametrize("slab", [1 << 16, 64, 7])
def test_box_overlap_counts_match_brute_force(spark, slab):
    """In one slab, and in so many that blocks of slabs count."""
    from quarry.operators.boxes import overlap_counts
    rows = _boxes(random.Random(7), 260, 4)
    got = {r["id"]: r["n_overlap"] for r in overlap_counts(spark.createDataFrame(rows, _BOX), slab=slab).collect()}
    for a in rows:
        want = sum(1 for b in rows if b[0] != a[0] and b[1] == a[1] and min(a[4], a[5], b[4], b[5]) > 0
                   and b[2] < a[2] + a[4] and a[2] < b[2] + b[4] and b[3] < a[3] + a[5] and a[3] < b[3] + b[5])
        assert got[a[0]] == want


def test_boxes_that_overlap_nothing(spark):
    from quarry.operators.boxes import overlap_counts
    rows = [(1, 1, 0.0, 0.0, 5.0, 5.0), (2, 1, None, 0.0, 5.0, 5.0), (3, None, 0.0, 0.0, 5.0, 5.0), (4, None, 0.0, 0.0, 5.0, 5.0),
            (5, 1, 0.0, 0.0, None, 5.0), (6, 1, 5.0, 0.0, 1.0, 1.0), (7, 2, -0.0, 0.0, 1.0, 1.0), (8, 2, -1.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, _BOX)
    assert {(r["id"], r["n_overlap"]) for r in overlap_counts(df).collect()} == {(k, 0) for k in range(1, 9)}
    assert overlap_counts(df.limit(0)).count() == 0


def test_one_image_of_many_boxes(spark):
    from quarry.operators.boxes import overlap_counts
    n = 100_000
    u = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1_000_000)) / 1000.0 for k in range(4)]
    df = spark.range(n).select("id", F.lit(1).cast("bigint").alias("img"), u[0].alias("x"), (u[1] - 500).alias("y"),
                               (u[2] / 50).alias("w"), (u[3] / 50).alias("h"))
    got = {r["id"]: r["n_overlap"] for r in overlap_counts(df, slab=1 << 14).collect()}
    m = np.array([tuple(r) for r in df.select("id", "x", "y", "w", "h").collect()])
    x, y, x2, y2 = m[:, 1], m[:, 2], m[:, 1] + m[:, 3], m[:, 2] + m[:, 4]
    assert len(got) == n
    solid = (m[:, 3] > 0) & (m[:, 4] > 0)
    for k in range(0, n, 97):
        want = int(((x < x2[k]) & (x[k] < x2) & (y < y2[k]) & (y[k] < y2) & solid).sum()) - 1 if solid[k] else 0
        assert got[int(m[k, 0])] == want


def test_global_index_with_payload_columns(spark):
    """Ids are 1..n in order whatever the frame carries and later drops."""
    from pyspark.sql import functions as F
    from quarry.operators.ranking import sequential_id
    df = spark.range(120_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.lit("x"), 40).alias("payload"),
                                     (F.col("id") % 7).alias("cls"))
    got = sequential_id(df.withColumnRenamed("id", "orig"), ["k"], name="pos")
    assert got.select("pos").distinct().count() == 120_000
    assert got.agg(F.min("pos"), F.max("pos")).first()[:] == (1, 120_000)
    rows = got.filter("pos % 1000 = 1").orderBy("pos").collect()
    ks = sorted(r.k for r in df.select("k").collect())
    assert [r.k for r in rows] == ks[::1000] and len(rows[0].payload) == 40


def test_split_stratified_with_payload_columns(spark):
    from pyspark.sql import functions as F
    from quarry.operators.ml import split_stratified
    df = spark.range(50_000).select("id", (F.col("id") % 5).alias("cls"), F.repeat(F.lit("y"), 30).alias("payload"))
    got = {r.cls: r.n for r in split_stratified(df, "cls", "id").filter("split = 'test'").groupBy("cls").agg(
        F.count("*").alias("n")).collect()}
    assert got == {k: 2000 for k in range(5)}


def test_split_bucket_spreads_equal_steps(spark):
    from pyspark.sql import functions as F
    from quarry.functions.common import is_test
    n = spark.range(20_000).select((F.col("id") * 100).alias("i")).filter(is_test("i")).count()
    assert 3600 < n < 4400


def test_csv_round_trip_keeps_every_cell(spark, tmp_path):
    from quarry.sources import files as FS
    rows = [(1, "  blanks  "), (2, 'quo"te, comma'), (3, "line\nend\r\nand \\ back\\n"), (4, ""), (5, None), (6, "\t"),
            (7, "é漢🙂"), (8, '"'), (9, "a\rb"), (10, ",")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = FS.write_csv(df, str(tmp_path / "csv"))
    back = FS.read_csv(spark, path, "id long, text string")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows
    assert back.count() == back.select("id").count() == back.select("text").count() == len(rows)


def test_csv_rejects_are_kept_apart(spark, tmp_path):
    from quarry.sources import files as FS
    root = tmp_path / "tree" / "a=1"
    root.mkdir(parents=True)
    (root / "x.csv").write_text('id,v\n1,2.5\nbad,3\n4,zz\n5,6\n')
    good, bad = FS.read_csv_tree(spark, str(tmp_path / "tree"), "id long, v double")
    assert good.count() == good.select("v").count() == len(good.collect()) == 2
    assert sorted(r._corrupt_record for r in bad.collect()) == ["4,zz", "bad,3"]


def test_confusion_matrix_counts_null_labels(spark):
    from quarry.operators.metrics import classification_report, confusion_matrix
    df = spark.createDataFrame([(1, 1), (None, 1), (0, None), (1, 0)], "actual int, predicted int")
    got = {(r.actual, r.predicted): r.n for r in confusion_matrix(df).collect()}
    assert len(got) == 9 and sum(got.values()) == 4 and got[None, 1] == 1 and got[0, None] == 1
    assert {r.label: r.support for r in classification_report(df).collect()}["accuracy"] == 2


def test_histogram_of_a_constant_column(spark):
    from quarry.operators.profile import histogram_bins
    df = spark.createDataFrame([(3.0,)] * 5 + [(None,)], "v double")
    rows = sorted(map(tuple, histogram_bins(df, "v", 4).collect()))
    assert (rows[0][1], rows[-1][2]) == (2.5, 3.5) and sum(r[3] for r in rows) == 5
    assert [r[3] for r in sorted(map(tuple, histogram_bins(df.filter("v < 0"), "v", 2).collect()))] == [0, 0]


def test_lexicon_with_repeated_words_and_shared_keys(spark):
    from pyspark.sql import functions as F
    from quarry.operators.text_features import lexicon_sentiment
    df = spark.createDataFrame([(1, 1, "good bad good"), (1, 2, "none"), (2, 1, None)], "a int, b int, t string")
    lex = [("good", 5, 2), ("good", 7, 1), ("bad", -4, 8)]
    got = {(r.a, r.b): (r.n_hits, round(r.polarity, 6)) for r in lexicon_sentiment(df, ["a", "b"], F.split("t", " "), lex).collect()}
    assert got == {(1, 1): (3, 0.2), (1, 2): (0, 0.0), (2, 1): (0, 0.0)}
    many = [(f"w{i}", 1, 1) for i in range(25_000)] + [("good", 5, 2), ("bad", -4, 8)]
    got = {(r.a, r.b): r.n_hits for r in lexicon_sentiment(df, ["a", "b"], F.split("t", " "), many).collect()}
    assert got[1, 1] == 3


def test_rules_of_any_number(spark):
    from pyspark.sql import functions as F
    from quarry.operators import joins as J
    rules = spark.createDataFrame([(i, f"L{i}", f"key{i:04d}") for i in range(1200)], "priority int, label string, keyword string")
    df = spark.createDataFrame([("has key1100 and key0007",), ("key1199",), ("nothing",)], "t string")
    got = [r.intent for r in J.keyword_classify(df, F.col("t"), rules, "none").collect()]
    assert got == ["L7", "L1199", "none"]


def test_label_encode_keeps_nulls(spark):
    from quarry.operators.ml import label_encode
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, c string")
    out, maps = label_encode(df, ["c"])
    assert {r.id: r.c_code for r in out.collect()} == {1: 1, 2: None, 3: 0, 4: 1}
    assert {r._v: r._code for r in maps["c"].collect()} == {"a": 0, "b": 1}


def test_edges_at_the_default_thresholds_and_large_image_ids(spark):
    """A high-contrast step edge at 100/700, image ids beyond 2^23, wide images."""
    from quarry.operators import raster as RA
    rows = [(1 << 40, 0, y, x, 255 if x >= 4 else 0) for y in range(6) for x in range(8)]
    r = spark.createDataFrame(rows, "img bigint, ch int, y int, x int, v int")
    got = {(t["y"], t["x"]) for t in RA.canny(r).filter("v = 255").collect()}
    assert got and {x for _, x in got} <= {3, 4} and {y for y, _ in got} == set(range(6))


def test_reachability_stops_at_the_goal(spark):
    from quarry.operators.graph import reachability
    edges = spark.createDataFrame([(i, i + 1) for i in range(10)], "src int, dst int")
    seeds = spark.createDataFrame([(0,)], "node int")
    got = {r.node: r.hop for r in reachability(edges, seeds, goal=3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_stratified_folds_deal_every_class_out(spark):
    from pyspark.sql import functions as F
    from quarry.operators.ml import stratified_folds
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("cls"))
    got = {(r.cls, r.fold): r.n for r in stratified_folds(df, "cls", "id").groupBy("cls", "fold").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {(c, f) for c in (0, 1) for f in range(3)}
    assert all(abs(got[c, f] - n / 3) < 1 for c, n in ((0, 900), (1, 100)) for f in range(3))


def test_cubic_weights_sum_to_one_and_keep_flat_images(spark):
    from quarry.operators import raster as RA
    assert all(abs(sum(w) - 1) < 1e-12 for _, w in RA.cubic_taps(3) + RA.cubic_taps(4))
    r = spark.createDataFrame([(0, 0, y, x, 77) for y in range(3) for x in range(5)], "img bigint, ch int, y int, x int, v int")
    got = RA.resize_cubic(r, 3).collect()
    assert len(got) == 135 and {t["v"] for t in got} == {77}
