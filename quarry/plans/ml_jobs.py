"""Feature, split and model jobs. Feature and split jobs
have SQL oracles; model jobs are checked on rows (training is not
SQL-expressible)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.functions.common import split_bucket_sql
from quarry.operators import boosting as BO
from quarry.operators import joins as J
from quarry.operators import linear as LI
from quarry.operators import ml as ML
from quarry.operators import sparse_forest as SF
from quarry.operators import text_features as TF
from quarry.operators.ranking import sequential_id
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.session import arrow_batches, drop_shuffles, scratch_path
from quarry.sources import files as FS
from quarry.sources.tables import Tables

R = T.round_half_up
RS = S.round_half_up


@register("label_encode", sql="""
SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS p_brand_code,
       (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS p_type_code FROM part""")
def label_encode(spark, d):
    out, _ = ML.label_encode(Tables(spark, d).part, ["p_brand", "p_type"])
    return out.select("p_partkey", "p_brand_code", "p_type_code")


_Z = ["l_quantity", "l_discount"]


@register("standardize", sql=f"""
WITH st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _Z)} FROM lineitem
            WHERE {split_bucket_sql('l_orderkey')} >= 20)
SELECT l_orderkey, l_linenumber, {', '.join(f"{RS(f'({c} - m_{c}) / s_{c}', 6)} AS {c}_z" for c in _Z)} FROM lineitem, st""")
def standardize(spark, d):
    """Fitted on the train split (by order key), applied to every line."""
    li = Tables(spark, d).lineitem
    train = ML.split_random(li, "l_orderkey").filter(F.col("split") == "train")
    z = ML.standardize(train, li, _Z)
    return z.select("l_orderkey", "l_linenumber", *[R(f"{c}_z", 6).alias(f"{c}_z") for c in _Z])


@register("split_random", sql=f"""
SELECT o_orderkey, CASE WHEN {split_bucket_sql('o_orderkey')} < 20 THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_random(spark, d):
    return ML.split_random(Tables(spark, d).orders.select("o_orderkey"), "o_orderkey")


@register("split_stratified", sql=f"""
SELECT doc_id, quality, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {split_bucket_sql('doc_id')}, doc_id) AS rn,
         count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def split_stratified(spark, d):
    lab = Tables(spark, d).labels.select("doc_id", "quality")
    return ML.split_stratified(lab, "quality", "doc_id", 0.2).select("doc_id", "quality", "split")


# ------------------------------------------------------------ model data

PART_FEATURES = ["p_size", "p_brand_code", "p_type_code"]
TEXT_FEATURES = 2000
ORDER_FEATURES = ["year", "month", "o_totalprice", "prio"]


def part_table(t):
    enc, _ = ML.label_encode(t.part, ["p_brand", "p_type"])
    return ML.split_random(enc, "p_partkey")


def order_table(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"),
                        F.month("o_orderdate").alias("month"), "o_totalprice",
                        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("prio"))
    o = StringIndexer(inputCol="o_orderstatus", outputCol="label", stringOrderType="alphabetAsc").fit(o).transform(o)
    o = ML.split_random(o, "o_orderkey")
    train = o.filter(F.col("split") == "train")
    z = ML.standardize(train, o, ORDER_FEATURES, suffix="")
    return ML.assemble(ORDER_FEATURES).transform(z)


def doc_table(t):
    """documents → cleaned n-gram terms → sublinear TF-IDF (2000 terms, min df
    2, fitted on the training rows); label = language."""
    docs = t.documents.select("doc_id", "lang", "text")
    lab = ML.split_stratified(docs.select("doc_id", "lang"), "lang", "doc_id", 0.2)
    docs = docs.join(lab.select("doc_id", "split"), "doc_id")
    counts, _ = TF.term_counts(TF.with_ngrams(docs, T.preprocess_tokens("text")), ["doc_id", "split"], F.col("terms"))
    in_train = F.col("split") == "train"
    vocab = TF.vocabulary(counts.filter(in_train), lab.filter(in_train).count(), 2, TEXT_FEATURES)
    long = TF.tfidf_weights(counts, "doc_id", vocab)
    docs = docs.drop("text")
    docs = TF.with_sparse_vector(docs, long, "doc_id", TEXT_FEATURES)
    index = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(docs)
    return index.transform(docs), index.labels


# A training job is two queries on one stored run: ``<key>_result`` gives what the
# source's step gives (score, winner, importances, predictions), ``<key>`` what
# another engine can check of it from the table: the rows on both sides, what a
# constant answer scores, that the score is the one of the stored predictions
# joined to the table's own labels, that every prediction is one of these, that
# the winner is the one with the best stored score.

def _once(spark, d, table, key, build):
    return FS.once_per_input(spark, f"{d.rstrip('/')}/{table}.parquet", key, build)


_SCORE = ("model string, n_train bigint, n_test bigint, metric string, value double, baseline double, "
          "recomputed double, unknown bigint")


def _accuracy_row(spark, name, n_train, pred, key, labels, truth):
    """``pred``: key, label (number), prediction; ``truth``: key, actual (the table's own label)."""
    path = scratch_path(spark, "predictions")
    names = F.array(*[F.lit(x) for x in labels])  # the classes of the fitted indexer
    pred.select(key, "label", "prediction", F.get(names, F.col("prediction").cast("int")).alias("predicted")
                ).write.parquet(path)
    stored = spark.read.parquet(path)
    classes = [r["count"] for r in stored.groupBy("label").count().collect()]
    n, right, unknown = stored.join(truth, key).agg(
        F.count("*"), F.avg((F.col("actual") == F.col("predicted")).cast("double")), F.count_if(F.col("predicted").isNull())).first()
    unknown += stored.filter(F.col("predicted").isNotNull()).join(
        truth.select(F.col("actual").alias("predicted")).distinct(), "predicted", "left_anti").count()
    return spark.createDataFrame([(name, n_train, n, "accuracy", ML.accuracy_of(stored, "label"),
                                   max(classes) / sum(classes), right, unknown)], _SCORE)


def _result(scores):
    return scores.select("model", "n_train", "n_test", "metric", "value", "baseline")


def _checkable(scores):
    v = F.col("value")
    ok = ~F.isnan(v) & (v >= 0) & ((F.col("metric") != "accuracy") | (v <= 1))
    return scores.select("model", "n_train", "n_test", "metric", R("baseline", 6).alias("baseline"), ok.alias("in_range"),
                         (F.abs(v - F.col("recomputed")) < 1e-9).alias("score_of_predictions"), "unknown")


_OK = "true AS in_range, true AS score_of_predictions, 0::BIGINT AS unknown"


def _orders_sql(name: str) -> str:
    """Rows of both sides of the order split and the share of the commonest held-out status."""
    test = f"{split_bucket_sql('o_orderkey')} < 20"
    return f"""
SELECT '{name}' AS model, (SELECT count(*) FROM orders WHERE NOT {test}) AS n_train, sum(c)::BIGINT AS n_test,
       'accuracy' AS metric, {RS('max(c) / sum(c)', 6)} AS baseline, {_OK}
FROM (SELECT count(*) AS c FROM orders WHERE {test} GROUP BY o_orderstatus)"""


def _part_run(spark, d):
    """100 trees, depth 10 on part features → MAE on the test split beside the
    training mean's, and the importances of the features."""
    t = Tables(spark, d)
    p = ML.assemble(PART_FEATURES).transform(part_table(t))
    train, test = ML.training_frame(p.filter(F.col("split") == "train")), p.filter(F.col("split") == "test")
    model = ML.rf_regressor("p_retailprice").fit(train)
    mean, n_train = train.agg(F.avg("p_retailprice"), F.count("*")).first()
    path = scratch_path(spark, "predictions")
    model.transform(test).select("p_partkey", "p_retailprice", "prediction").write.parquet(path)
    train.unpersist()
    stored = spark.read.parquet(path)
    mae, base = stored.agg(F.avg(F.abs(F.col("p_retailprice") - F.col("prediction"))),
                           F.avg(F.abs(F.col("p_retailprice") - mean))).first()
    again = stored.select("p_partkey", "prediction").join(t.part.select("p_partkey", "p_retailprice"), "p_partkey")
    n, right, unknown = again.agg(F.count("*"), F.avg(F.abs(F.col("p_retailprice") - F.col("prediction"))),
                                  F.count_if(F.col("prediction").isNull() | F.isnan("prediction"))).first()
    score = spark.createDataFrame([("rf_regressor", n_train, n, "mae", mae, base, right, unknown)], _SCORE)
    imp = ML.feature_importance(model, PART_FEATURES).withColumn("n_train", F.lit(n_train))
    return score.select("*", F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("importance"),
                        F.lit(None).cast("int").alias("rank")).unionByName(imp, allowMissingColumns=True)


def _part_model(spark, d):
    return _once(spark, d, "part", "part-forest", lambda: _part_run(spark, d))


@register("train_rf_regressor_result")
def train_rf_regressor_result(spark, d):
    return _result(_part_model(spark, d).filter("feature IS NULL"))


@register("train_rf_regressor", sql=f"""
WITH s AS (SELECT p_retailprice AS p, {split_bucket_sql('p_partkey')} < 20 AS test FROM part),
m AS (SELECT avg(p) AS mean, count(*) AS n FROM s WHERE NOT test)
SELECT 'rf_regressor' AS model, max(n) AS n_train, count(*) AS n_test, 'mae' AS metric,
       {RS('avg(abs(p - mean))', 6)} AS baseline, {_OK} FROM s, m WHERE test""")
def train_rf_regressor(spark, d):
    return _checkable(_part_model(spark, d).filter("feature IS NULL"))


def _orders_split(spark, d):
    o = order_table(Tables(spark, d))
    return ML.training_frame(o.filter(F.col("split") == "train")), o.filter(F.col("split") == "test")


def _fitted(make, *args, **kw):
    """An estimator as a candidate: rows → (rows → rows with predictions)."""
    return lambda train: make("label", *args, **kw).fit(train).transform


def _boosted(train):
    model = BO.fit_boosting(train, "label", ORDER_FEATURES, 3, rounds=100)
    return lambda rows: model.transform(rows.select("o_orderkey", "label", *ORDER_FEATURES), ORDER_FEATURES)


ORDER_MODELS = {"logistic": _fitted(ML.logistic, 1000), "rf_classifier": _fitted(ML.cell_forest, 100),
                "gbt": _boosted}


def _order_model(spark, d, name):
    def run():
        train, test = _orders_split(spark, d)
        pred = ORDER_MODELS[name](train)(test)
        t = Tables(spark, d).orders
        labels = [r[0] for r in t.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]
        out = _accuracy_row(spark, name, train.count(), pred, "o_orderkey", labels,
                            t.select("o_orderkey", F.col("o_orderstatus").alias("actual")))
        train.unpersist()
        return out
    return _once(spark, d, "orders", f"orders-{name}", run)


@register("train_logistic_result")
def train_logistic_result(spark, d):
    return _result(_order_model(spark, d, "logistic"))


@register("train_logistic", sql=_orders_sql("logistic"))
def train_logistic(spark, d):
    return _checkable(_order_model(spark, d, "logistic"))


@register("train_rf_classifier_result")
def train_rf_classifier_result(spark, d):
    return _result(_order_model(spark, d, "rf_classifier"))


@register("train_rf_classifier", sql=_orders_sql("rf_classifier"))
def train_rf_classifier(spark, d):
    return _checkable(_order_model(spark, d, "rf_classifier"))


@register("train_gbt_classifier_result")
def train_gbt_classifier_result(spark, d):
    """100 rounds of three trees on one softmax."""
    return _result(_order_model(spark, d, "gbt"))


@register("train_gbt_classifier", sql=_orders_sql("gbt"))
def train_gbt_classifier(spark, d):
    return _checkable(_order_model(spark, d, "gbt"))


def _docs_split(spark, d):
    """Training and held-out rows of the text task, stored once, and the class names."""
    def run():
        docs, _ = doc_table(Tables(spark, d))
        return docs.select("doc_id", "lang", "label", "split", "idx", "val", "features")
    docs = _once(spark, d, "documents", "text-task", run)
    drop_shuffles(spark)
    labels = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    return docs.filter(F.col("split") == "train"), docs.filter(F.col("split") == "test"), labels


def _text_svm(train, n_classes):
    """Linear machines on TF-IDF features, class against rest, with sigmoids
    cross-fitted over five stratified folds."""
    dealt = ML.stratified_folds(train.select("doc_id", "label", "idx", "val"), "label", "doc_id", 5)
    return LI.calibrated_svm(dealt, "label", "fold", n_classes, TEXT_FEATURES)


def _text_models(n_classes, n_train):
    """None keeps the rows beside its own form of them."""
    logistic = _fitted(ML.logistic, 1000, c=5.0, n=n_train)
    return {"random_forest": lambda train: SF.sparse_forest(train, "label", n_classes, TEXT_FEATURES, 300, ML.MAX_DEPTH).transform,
            "logistic": lambda train: logistic(ML.spread(train.select("doc_id", "label", "features"), n_train)),
            "svm_calibrated": lambda train: _text_svm(train, n_classes).transform}


def _text_svm_score(spark, d):
    def run():
        train, test, labels = _docs_split(spark, d)
        pred = _text_svm(train, len(labels)).transform(test.select("doc_id", "label", "idx", "val"))
        return _accuracy_row(spark, "svm_calibrated", train.count(), pred, "doc_id", labels,
                             Tables(spark, d).documents.select("doc_id", F.col("lang").alias("actual")))
    return _once(spark, d, "documents", "text-svm", run)


@register("train_svm_calibrated_result")
def train_svm_calibrated_result(spark, d):
    return _result(_text_svm_score(spark, d))


_TEXT_SIDES = "(SELECT count(*) AS n, ceil(0.2 * count(*))::BIGINT AS t FROM documents GROUP BY lang)"


@register("train_svm_calibrated", sql=f"""
SELECT 'svm_calibrated' AS model, sum(n - t)::BIGINT AS n_train, sum(t)::BIGINT AS n_test, 'accuracy' AS metric,
       {RS('max(t) / sum(t)', 6)} AS baseline, {_OK} FROM {_TEXT_SIDES}""")
def train_svm_calibrated(spark, d):
    return _checkable(_text_svm_score(spark, d))


def _compared(rows, score):
    """``is_best`` against the stored scores, and whether they are shares."""
    every = Window.partitionBy(F.lit(0))  # a row a candidate
    first = F.row_number().over(every.orderBy(F.desc(score), "at")) == 1
    return rows.withColumn("winner_is_best", F.col("is_best") == first)


def _comparison(spark, d):
    def run():
        train, test = _orders_split(spark, d)
        out = ML.compare_models(train, test, "label", ORDER_MODELS)
        out = out.select("*", F.lit(train.count()).alias("n_train"), F.lit(test.count()).alias("n_valid"),
                         F.monotonically_increasing_id().alias("at"))
        train.unpersist()
        return out.coalesce(1)
    return _once(spark, d, "orders", "orders-compared", run)


@register("compare_models_result")
def compare_models_result(spark, d):
    """Three classifiers on the order table: train/validation accuracy,
    best by validation."""
    return _comparison(spark, d).select("model", "train_acc", "valid_acc", "is_best")


def _compared_sql(names, n_train, n_valid, source):
    return f"""
SELECT model, {n_train} AS n_train, {n_valid} AS n_valid, true AS in_range, true AS winner_is_best
FROM {source}, (VALUES {', '.join(f"('{n}')" for n in names)}) AS m(model) GROUP BY model"""


def _comparison_check(rows):
    return _compared(rows, "valid_acc").select(
        "model", "n_train", "n_valid", (F.col("train_acc").between(0, 1) & F.col("valid_acc").between(0, 1)).alias("in_range"),
        "winner_is_best")


_IN_TEST = f"{split_bucket_sql('o_orderkey')} < 20"


@register("compare_models", sql=_compared_sql(ORDER_MODELS, f"count(*) FILTER (WHERE NOT {_IN_TEST})",
                                              f"count(*) FILTER (WHERE {_IN_TEST})", "orders"))
def compare_models(spark, d):
    return _comparison_check(_comparison(spark, d))


_TEXT_FITTED: dict[tuple, dict] = {}  # the candidates of a table's last comparison


def _text_comparison(spark, d):
    """The comparison's rows and its fitted candidates."""
    key = spark.sparkContext.applicationId, d.rstrip("/")

    def run():
        train, test, labels = _docs_split(spark, d)
        n_train, fitted = train.count(), {}
        models = _text_models(len(labels), n_train)
        with arrow_batches(spark, "4m"):  # blocks of rows are long rows
            out = ML.compare_models(train, test, "label", models, len(models), fitted)
        _TEXT_FITTED[key] = fitted
        return out.select("*", F.lit(n_train).alias("n_train"), F.lit(test.count()).alias("n_valid"),
                          F.monotonically_increasing_id().alias("at")).coalesce(1)
    return _once(spark, d, "documents", "text-compared", run), _TEXT_FITTED[key]


@register("compare_text_models_result")
def compare_text_models_result(spark, d):
    """The source's three text classifiers: a forest of 300 trees, logistic regression
    with C = 5, the calibrated linear machine; best by held-out accuracy."""
    return _text_comparison(spark, d)[0].select("model", "train_acc", "valid_acc", "is_best")


@register("compare_text_models", sql=_compared_sql(("random_forest", "logistic", "svm_calibrated"), "sum(n - t)::BIGINT",
                                                   "sum(t)::BIGINT", _TEXT_SIDES))
def compare_text_models(spark, d):
    return _comparison_check(_text_comparison(spark, d)[0])


# The source's grid; the last depth stands for "unbounded".
GRID_TREES, GRID_DEPTHS = [100, 200], [10, 20, ML.MAX_DEPTH]


def _grid(spark, d):
    def run():
        train, _ = _orders_split(spark, d)
        res = ML.grid_search_cv(train, "label", "o_orderkey", GRID_TREES, GRID_DEPTHS, folds=3)
        out = res.select("*", F.lit(train.count()).alias("n_rows"), F.monotonically_increasing_id().alias("at")).coalesce(1)
        train.unpersist()
        return out
    return _once(spark, d, "orders", "orders-grid", run)


@register("grid_search_cv_result")
def grid_search_cv_result(spark, d):
    """Mean accuracy of every parameter combination of the source, and the winner."""
    return _grid(spark, d).select("params", "cv_accuracy", "is_best")


@register("grid_search_cv", sql=f"""
SELECT 'maxDepth=' || depth || ', numTrees=' || trees AS params, count(*) AS n_rows, true AS in_range, true AS winner_is_best
FROM orders, (SELECT unnest({GRID_DEPTHS}) AS depth), (SELECT unnest({GRID_TREES}) AS trees)
WHERE NOT {_IN_TEST} GROUP BY depth, trees""")
def grid_search_cv(spark, d):
    return _compared(_grid(spark, d), "cv_accuracy").select(
        "params", "n_rows", F.col("cv_accuracy").between(0, 1).alias("in_range"), "winner_is_best")


def _submission(spark, d):
    """Refit the grid's winner on all training rows, predict the held-out rows,
    write (id, key, prediction) as CSV with sequential ids, read back."""
    def run():
        best = _grid(spark, d).filter("is_best").first()
        train, test = _orders_split(spark, d)
        model = ML.cell_forest("label", best.num_trees, best.max_depth).fit(train)
        pred = model.transform(test).select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))
        path = FS.write_csv(sequential_id(pred, ["o_orderkey"]).select("id", "o_orderkey", "prediction"),
                            scratch_path(spark, "submission"))
        train.unpersist()
        return FS.read_csv(spark, path, "id bigint, o_orderkey bigint, prediction int").withColumn("params", F.lit(best.params))
    return _once(spark, d, "orders", "orders-submission", run)


@register("refit_and_predict_result")
def refit_and_predict_result(spark, d):
    return _submission(spark, d).select("id", "o_orderkey", "prediction", "params")


@register("refit_and_predict", sql=f"""
SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS id, o_orderkey, true AS known,
       (SELECT count(DISTINCT o_orderstatus) FROM orders) AS classes FROM orders WHERE {_IN_TEST}""")
def refit_and_predict(spark, d):
    """``known``: the prediction is the number of one of the table's classes."""
    classes = Tables(spark, d).orders.select("o_orderstatus").distinct().count()
    return _submission(spark, d).select("id", "o_orderkey", F.col("prediction").between(0, classes - 1).alias("known"),
                                        F.lit(classes).cast("bigint").alias("classes"))


@register("feature_importance_result")
def feature_importance_result(spark, d):
    return _part_model(spark, d).filter("feature IS NOT NULL").select("feature", "importance", "rank")


@register("feature_importance", sql=f"""
SELECT rank, 3::BIGINT AS n_features, count(*) AS n_train, 1.0::DOUBLE AS total, true AS descending
FROM part, (VALUES (1), (2), (3)) AS r(rank) WHERE {split_bucket_sql('p_partkey')} >= 20 GROUP BY rank""")
def feature_importance(spark, d):
    imp = _part_model(spark, d).filter("feature IS NOT NULL")
    every = Window.partitionBy(F.lit(0))  # one row a feature
    before = F.lag("importance").over(every.orderBy("rank"))
    return imp.select("rank", F.count("feature").over(every).alias("n_features"), "n_train",
                      R(F.sum("importance").over(every), 6).alias("total"),
                      (before.isNull() | (before >= F.col("importance"))).alias("descending"))


@register("predict_topk_enriched")
def predict_topk_enriched(spark, d):
    """Document text → features → class probabilities of the text comparison's
    winner, as fitted there → top 5 classes with probability >= 3 % → enriched with per-class
    info (description, the class's first four sources in order, band of its
    mean length in thousands of characters)."""
    t = Tables(spark, d)
    compared, fitted = _text_comparison(spark, d)
    _, test, labels = _docs_split(spark, d)
    pred = fitted[compared.filter("is_best").first().model](test)
    top = ML.topk_probabilities(pred, "doc_id", labels, 5, 0.03)
    info = t.documents.groupBy(F.col("lang").alias("label")).agg((F.avg("n_chars") / 1000.0).alias("score"))
    info = info.select("label", F.concat(F.lit("documents in "), F.col("label")).alias("description"),
                       R("score", 1).alias("score"), T.band_label("score").alias("b"))
    sources = t.documents.select(F.col("lang").alias("label"), "source").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("source"))
    info = J.enrich_with_list(info, sources.withColumn("n", place).filter("n <= 4"), "label", "source", "precautions")
    return (top.join(F.broadcast(info), "label", "left")  # one row per class
            .select("doc_id", "rank", "label", "confidence",
                    F.coalesce("description", F.lit("(not described)")).alias("description"),
                    F.coalesce("precautions", F.array().cast("array<string>")).alias("precautions"),
                    F.col("b.label").alias("severity"), F.col("b.colour").alias("colour"), "score"))


@register("sink_model_result")
def sink_model_result(spark, d):
    """Persist a fitted pipeline, reload it, and score with both."""
    train, test = _orders_split(spark, d)
    pipe = Pipeline(stages=[ML.cell_forest("label", 100)])
    model = pipe.fit(train)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(test).select("o_orderkey", F.col("prediction").alias("before"))
    b = again.transform(test).select("o_orderkey", F.col("prediction").alias("after"))
    return a.join(b, "o_orderkey").select("o_orderkey", "before", "after")


@register("sink_model", sql=f"""
SELECT o_orderkey, true AS equal FROM orders WHERE {split_bucket_sql('o_orderkey')} < 20""")
def sink_model(spark, d):
    """The predictions before and after must agree row by row."""
    return sink_model_result(spark, d).select("o_orderkey", (F.col("before") == F.col("after")).alias("equal"))
