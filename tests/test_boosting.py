"""Multinomial boosting against a plain numpy version, round by round."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import boosting as B


def data(n=300, seed=1):
    r = np.random.default_rng(seed)
    x = np.stack([r.normal(size=n), r.integers(0, 5, n).astype(float), r.normal(size=n)], axis=1)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * r.normal(size=n) > 1).astype(int) + (x[:, 2] > 0.8)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(k), *map(float, v)) for i, (v, k) in enumerate(zip(x, y))],
                                 "id long, label int, a double, b double, c double")


def plain_tree(bins, r, h, depth, classes):
    """Value of each row, by recursion over sets of rows."""
    out = np.zeros(len(r))

    def go(rows, left):
        best = (1e-12, None)
        if left:
            for f in range(bins.shape[1]):
                for cut in range(B.BINS):
                    a, b = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                    if len(a) and len(b):
                        gain = len(a) * len(b) / len(rows) * (r[a].mean() - r[b].mean()) ** 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (a, b))
        if best[1] is None:
            out[rows] = (classes - 1) / classes * r[rows].sum() / h[rows].sum() if h[rows].sum() > 1e-12 else 0.0
            return
        for side in best[1]:
            go(side, left - 1)

    go(np.arange(len(r)), depth)
    return out


def test_rounds_equal_plain_numpy(spark):
    x, y = data()
    rounds = 6
    model = B.fit_boosting(frame(spark, x, y), "label", ["a", "b", "c"], 3, rounds=rounds, rewrite=2)
    bins = model.binned(x)
    share = np.log(np.bincount(y, minlength=3) / len(y))
    assert np.allclose(model.prior, share)
    scores = np.tile(share, (len(y), 1))
    for k in range(rounds):
        r, h = B.residuals(scores, y)
        for c in range(3):
            want = plain_tree(bins, r[:, c], h[:, c], 3, 3)
            assert np.allclose(model.rounds[k][c].of(bins), want, atol=1e-9), (k, c)
        for c in range(3):
            scores[:, c] += 0.1 * model.rounds[k][c].of(bins)
    assert np.allclose(model.scores(x), scores)


def test_it_learns_and_keeps_columns(spark):
    x, y = data(400, 2)
    df = frame(spark, x, y)
    model = B.fit_boosting(df.filter("id % 4 <> 0"), "label", ["a", "b", "c"], 3, rounds=25)
    got = model.transform(df.filter("id % 4 = 0").withColumn("prediction", F.lit("clash")), ["a", "b", "c"]).collect()
    assert len(got) == 100 and all(abs(sum(r.probs) - 1) < 1e-9 for r in got)
    right = np.mean([r.prediction == r.label for r in got])
    assert right > 0.8 > max(np.bincount(y)) / len(y)


def test_constant_features_missing_values_and_an_absent_class(spark):
    rows = [(i, i % 2, 1.0, None if i % 3 else float(i), 2.0) for i in range(30)] + [(99, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double, c double")
    model = B.fit_boosting(df, "label", ["a", "b", "c"], 3, rounds=3)
    got = model.transform(df, ["a", "b", "c"]).collect()
    assert len(got) == 31 and all(np.isfinite(r.probs).all() and r.prediction in (0.0, 1.0) for r in got)


def test_the_rows_of_a_round_do_not_grow_with_the_table(spark, monkeypatch):
    """Rows of one class and the same bins travel as one, and count as many."""
    x, y = data(200, 3)
    x = np.round(x, 1)
    seen = []
    monkeypatch.setattr(B, "parts_for", lambda spark, rows, per_task: seen.append(rows) or 2)
    one, many = (B.fit_boosting(frame(spark, np.tile(x, (n, 1)), np.tile(y, n)), "label", ["a", "b", "c"], 3, rounds=4)
                 for n in (1, 20))
    assert len(seen) == 2 and max(seen) <= 200
    assert np.allclose(one.scores(x), many.scores(x))
