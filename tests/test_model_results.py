"""The model queries' own results (``<key>_result``): scores, importances and
predictions, against what SQL knows of the table."""

import pytest

from quarry.functions.common import split_bucket_sql
from quarry.plans.catalog import load_all

REG = load_all()
MODELS = ["train_rf_regressor", "train_logistic", "train_rf_classifier", "train_gbt_classifier", "train_svm_calibrated",
          "compare_models", "grid_search_cv", "feature_importance", "refit_and_predict", "sink_model"]


@pytest.mark.parametrize("key", MODELS)
def test_results_are_registered(key):
    assert f"{key}_result" in REG


def test_score_beside_the_majority_share(spark, duck):
    from conftest import SMALL
    r = REG["train_logistic_result"].job(spark, SMALL).first()
    share, n = duck.execute(f"""SELECT max(c) / sum(c), sum(c) FROM (SELECT count(*) AS c FROM orders
        WHERE {split_bucket_sql('o_orderkey')} < 20 GROUP BY o_orderstatus)""").fetchone()
    assert (r.model, r.metric, r.n_test) == ("logistic", "accuracy", n)
    assert abs(r.baseline - share) < 1e-12 and 0 < r.value <= 1


def test_score_is_that_of_the_stored_predictions(spark, duck):
    from conftest import SMALL
    for key in ("train_logistic", "train_rf_classifier"):
        r = REG[key].job(spark, SMALL).first()
        assert (r.in_range, r.score_of_predictions, r.unknown) == (True, True, 0)


def test_the_grids_winner_is_refitted_and_predicts(spark, duck):
    from conftest import SMALL
    got = REG["refit_and_predict_result"].job(spark, SMALL).collect()
    grid = REG["grid_search_cv_result"].job(spark, SMALL).collect()
    best = [r.params for r in grid if r.is_best]
    assert best == [max(grid, key=lambda r: r.cv_accuracy).params] and {r.params for r in got} == set(best)
    truth = dict(duck.execute("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 FROM orders").fetchall())
    assert len({r.prediction for r in got}) > 1 and all(r.o_orderkey in truth for r in got)


def test_importances(spark):
    from conftest import SMALL
    got = REG["feature_importance_result"].job(spark, SMALL).collect()
    assert {r.feature for r in got} == {"p_size", "p_brand_code", "p_type_code"}
    assert abs(sum(r.importance for r in got) - 1) < 1e-9


def test_grid_search_runs_the_whole_grid(spark):
    from conftest import SMALL
    got = REG["grid_search_cv_result"].job(spark, SMALL).collect()
    assert {r.params for r in got} == {f"maxDepth={d}, numTrees={t}" for d in (10, 20, 30) for t in (100, 200)}
    assert sum(r.is_best for r in got) == 1


def test_a_forests_beginning_is_a_forest(spark):
    """The first trees of a forest give the mean of these trees' own answers."""
    from quarry.operators import ml as ML
    df = spark.range(200).selectExpr("cast(id % 3 AS double) AS label", "cast(id % 7 AS double) AS a", "cast(id % 11 AS double) AS b")
    df = ML.assemble(["a", "b"]).transform(df)
    whole = ML.rf_classifier("label", 12, 5).fit(df)
    some = ML.forest_prefix(whole, 4)
    assert len(some.trees) == 4
    got = [r[0] for r in some.transform(df).select("probability").collect()]
    each = [[r[0] for r in t.transform(df).select("probability").collect()] for t in whole.trees[:4]]
    for k, p in enumerate(got):
        mean = sum(e[k].toArray() for e in each) / 4
        assert max(abs(mean - p.toArray())) < 1e-9


def test_text_comparison_serves_its_winner(spark):
    from conftest import SMALL
    rows = {r.model: r for r in REG["compare_text_models_result"].job(spark, SMALL).collect()}
    assert set(rows) == {"random_forest", "logistic", "svm_calibrated"} and sum(r.is_best for r in rows.values()) == 1
    assert all(r.valid_acc > 0.8 for r in rows.values())
    served = REG["predict_topk_enriched"].job(spark, SMALL).collect()
    first = {r.doc_id: r for r in served if r["rank"] == 1}
    assert len(first) > 30 and all(len(r.precautions) in range(1, 5) for r in served)
