"""The batched linear solver against direct minimisation in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import linear as LI


def sparse_rows(rng, n, d, classes):
    x = np.where(rng.random((n, d)) < 0.3, rng.normal(size=(n, d)), 0.0)
    x[0] = 0.0  # a row without features
    w = rng.normal(size=(d, classes))
    y = (x @ w + 0.3 * rng.normal(size=(n, classes))).argmax(1)
    return x, y


def frame(spark, x, y, folds):
    rows = [(i, int(k), i % folds, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]])
            for i, (r, k) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, label int, fold int, idx array<int>, val array<double>")


def hinge(w, x, y, c):
    s = np.maximum(0, 1 - y * (x @ w))
    return 0.5 * w @ w + c * (s * s).sum(), w - 2 * c * x.T @ (y * s)


def test_descent_finds_the_minimum_of_a_quadratic():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    h, b = a @ a.T + np.eye(6), rng.normal(size=6)
    run = LI.Descent(np.zeros(6), 1e-9, 200)
    while run.point is not None:
        run.tell(0.5 * run.point @ h @ run.point - b @ run.point, h @ run.point - b)
    assert run.converged and np.allclose(run.x, np.linalg.solve(h, b), atol=1e-6)


def test_every_problem_is_at_its_own_minimum(spark):
    rng = np.random.default_rng(2)
    x, y = sparse_rows(rng, 90, 12, 3)
    folds, size = 3, 12
    svm = LI.calibrated_svm(frame(spark, x, y, folds), "label", "fold", 3, size, folds, tol=1e-7)
    ones = np.hstack([x, np.ones((len(x), 1))])
    at = np.arange(len(x)) % folds
    for f in range(folds):
        for k in range(3):
            yk = np.where(y == k, 1.0, -1.0)
            _, g = hinge(svm.weights[f, k], ones[at != f], yk[at != f], 1.0)
            _, g0 = hinge(np.zeros(size + 1), ones[at != f], yk[at != f], 1.0)
            assert np.linalg.norm(g) <= 1e-6 * np.linalg.norm(g0)
            # the sigmoid: no gradient left on the rows of the fold
            m, rows = ones[at == f] @ svm.weights[f, k], y[at == f] == k
            t = np.where(rows, (rows.sum() + 1) / (rows.sum() + 2), 1 / ((~rows).sum() + 2))
            d = 1 / (1 + np.exp(-(svm.slopes[f, k, 0] * m + svm.slopes[f, k, 1]))) - t
            assert abs(d @ m) < 1e-3 and abs(d.sum()) < 1e-3


def test_scores_are_probabilities_and_nearly_separate(spark):
    rng = np.random.default_rng(3)
    x, y = sparse_rows(rng, 120, 10, 4)
    df = frame(spark, x, y, 5)
    svm = LI.calibrated_svm(df, "label", "fold", 4, 10)
    got = svm.transform(df.select("id", "label", F.lit("clash").alias("probs"), "idx", "val")).collect()
    assert len(got) == 120 and all(abs(sum(r.probs) - 1) < 1e-9 for r in got)
    assert all(r.prediction == int(np.argmax(r.probs)) for r in got)
    assert np.mean([r.prediction == r.label for r in got]) > 0.75


@pytest.mark.parametrize("missing", [0, 2])
def test_a_class_without_rows_and_null_features(spark, missing):
    rows = [(i, 1 if i % 2 else (missing + 1) % 3, i % 2, [i % 2], [1.0]) for i in range(12)] + [(99, 1, 0, None, None)]
    df = spark.createDataFrame(rows, "id long, label int, fold int, idx array<int>, val array<double>")
    svm = LI.calibrated_svm(df, "label", "fold", 3, 2, folds=2)
    assert np.isfinite(svm.weights).all() and np.isfinite(svm.slopes).all()


def test_partial_sums_are_added_in_rounds(spark):
    parts = spark.range(0, 100, 1, 100).select(F.lit(np.arange(6.0).tobytes()).alias("total"))
    assert np.allclose(LI._total(parts, 100, (2, 3)), 100 * np.arange(6.0).reshape(2, 3))


def test_blocks_of_rows_share_one_clean_buffer():
    """No matrix is made for each block, and nothing of a block is left in the next one."""
    import pyarrow as pa
    x, _ = sparse_rows(np.random.default_rng(7), 2 * LI.ROWS + 5, 9, 2)
    idx = pa.array([np.flatnonzero(r).astype(np.int32) for r in x], pa.list_(pa.int32()))
    val = pa.array([r[r != 0] for r in x], pa.list_(pa.float64()))
    seen = set()
    for at, block in LI._dense(idx, val, 9):
        assert (block[:, :9] == x[at: at + LI.ROWS]).all() and (block[:, 9] == 1).all()
        seen.add(block.__array_interface__["data"][0])
    assert len(seen) == 1 and [b.shape for _, b in LI._dense(idx[:0], val[:0], 9)] == []
