"""Forests of cells: the trees against a plain version, the forest against Spark ML's,
its growth with the rows, and a stored model."""

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quarry.operators import forest as FO
from quarry.operators import ml as ML


def cells(n=120, classes=3, seed=3):
    r = np.random.default_rng(seed)
    bins = np.unique(r.integers(0, [5, 9, 4], (n, 3)), axis=0).astype(np.uint8)
    return bins, r.integers(0, 6, (len(bins), classes))


def gini(w):
    return 1 - ((w / w.sum()) ** 2).sum()


def test_each_split_of_a_tree_is_the_best_one():
    """With all features allowed, every node's split has the gain of the best of all cuts."""
    bins, counts = cells()
    w = counts.astype(float)
    node = np.random.default_rng(0).integers(0, 4, len(bins))
    total = np.stack([w[node == k].sum(0) for k in range(4)])
    feature, cut = FO.best_splits(node, bins.astype(int), w, total, np.ones((4, 3), bool))

    def gain(k, f, c):
        side = bins[node == k, f] > c
        l, r = w[node == k][~side].sum(0), w[node == k][side].sum(0)
        if not l.sum() or not r.sum():
            return 0.0
        return gini(l + r) - (l.sum() * gini(l) + r.sum() * gini(r)) / (l + r).sum()
    for k in range(4):
        best = max(gain(k, f, c) for f in range(3) for c in range(9))
        assert best > 0 and abs(gain(k, feature[k], cut[k]) - best) < 1e-12


def test_a_deep_tree_tells_every_drawn_cell():
    """Of two features every node may use both."""
    r = np.random.default_rng(3)
    bins = np.unique(r.integers(0, [6, 20], (150, 2)), axis=0).astype(np.uint8)
    counts = r.integers(0, 6, (len(bins), 3))
    tree = FO.grow(bins, counts, 30, np.random.default_rng(5))
    drawn = np.random.default_rng(5).poisson(counts)  # the tree's own first draw
    got = FO.answers(tree, bins)
    assert np.allclose(got.sum(1), 1)
    assert all(np.allclose(g, d / d.sum()) for g, d in zip(got, drawn) if d.sum())
    shallow = FO.grow(bins, counts, 1, np.random.default_rng(5))
    assert len(shallow[0]) == 3 and (shallow[0] >= 0).tolist() == [True, False, False]


def table(spark, n):
    df = spark.range(n).selectExpr("id", "pmod(hash(id), 12) AS a", "CAST(pmod(hash(id, 7), 1000) AS double) AS b", "rand(3) AS u")
    return ML.assemble(["a", "b"]).transform(df.withColumn(
        "label", F.when(F.col("u") < 0.1, 2.0).when(F.col("a") * 80 + F.col("b") > 900, 1.0).otherwise(0.0)))


def test_scores_like_spark_mls_forest(spark):
    train, test = (table(spark, 6000).filter(F.expr(f"(id % 4 = 0) = {t}")) for t in ("false", "true"))
    mine = ML.cell_forest("label", 20, 8).fit(train).transform(test)
    other = ML.rf_classifier("label", 20, 8).fit(train).transform(test)
    a, b = ML.accuracy_of(mine, "label"), ML.accuracy_of(other, "label")
    assert mine.count() == test.count() and abs(a - b) < 0.02 and a > 0.8


def test_trees_do_not_grow_with_the_rows(spark):
    """Labels that the features can't tell: a tree holds at most a leaf a cell, whatever the rows."""
    nodes = []
    for n in (20_000, 80_000):
        df = ML.assemble(["a", "b"]).transform(
            spark.range(n).selectExpr("pmod(hash(id), 12) AS a", "rand(5) AS b", "floor(rand(9) * 3) AS label"))
        model = ML.cell_forest("label", 4).fit(df)
        nodes.append(spark.read.parquet(model.path).select(F.max(F.size("feature"))).first()[0])
    assert max(nodes) <= 2 * 12 * FO.BINS - 1


def test_missing_values_and_unknown_labels(spark):
    rows = [(i, float(i % 3 == 0) if i % 7 else None, None if i % 3 else 1.0, float(i % 5)) for i in range(200)]
    df = ML.assemble(["a", "b"]).transform(spark.createDataFrame(rows, "id long, label double, a double, b double"))
    got = ML.cell_forest("label", 9).fit(df).transform(df).collect()
    assert len(got) == 200 and all(r.prediction == float(r.id % 3 == 0) for r in got)


def test_a_stored_pipeline_predicts_the_same(spark, tmp_path):
    df = table(spark, 500)
    model = Pipeline(stages=[ML.cell_forest("label", 6)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.stages[0].path != model.stages[0].path
    a, b = ({r.id: (r.prediction, r.probs) for r in m.transform(df).collect()} for m in (model, again))
    assert a == b and len(a) == 500


def test_cuts_are_all_values_or_quantiles(spark):
    df = spark.range(1000).selectExpr("CAST(id % 5 AS double) AS a", "CAST(id AS double) AS b", "CAST(NULL AS double) AS c")
    a, b, c = FO.cuts_of(df, ["a", "b", "c"])
    assert a == [0.0, 1.0, 2.0, 3.0, 4.0] and len(b) == FO.BINS - 1 and b == sorted(b) and c == []


def test_the_order_jobs_fit_this_forest(spark):
    from quarry.plans import ml_jobs
    df = ML.assemble(ml_jobs.ORDER_FEATURES).transform(
        spark.range(300).selectExpr("id % 7 AS year", "id % 12 AS month", "id * 1.5 AS o_totalprice", "id % 5 AS prio", "id % 3 AS label"))
    assert isinstance(ml_jobs.ORDER_MODELS["rf_classifier"](df).__self__, FO.CellForestModel)
