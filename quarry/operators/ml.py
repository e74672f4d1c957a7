"""Feature engineering and model operators on Spark ML.

Everything trains and scores with Spark ML estimators (distributed);
Python only assembles pipelines and collects small metric rows.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.common import is_test, split_bucket
from quarry.operators.forest import CellForest, held_out_scores
from quarry.operators.profile import global_index


SALTS = 64

# ---------------------------------------------------------------- features

def label_encode(df: DataFrame, cols: list[str], suffix: str = "_code") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Code = 0-based rank of the value in sorted distinct order; null stays
    null. The mapping of each column is a table (value, code) made in Spark,
    reusable on other tables by the same left join."""
    out, maps = df, {}
    for c in cols:
        values = df.select(F.col(c).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
        maps[c] = global_index(values, ["_v"], name="_code").select("_v", F.col("_code").cast("int").alias("_code"))
        out = out.join(maps[c], F.col(c) == F.col("_v"), "left").withColumnRenamed("_code", c + suffix).drop("_v")
    return out, maps


def standardize(train: DataFrame, apply_to: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x − mean)/std with the *population* std, fitted on ``train`` only
    (one aggregate row), applied to ``apply_to``."""
    stats = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = apply_to
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        expr = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        out = out.withColumn(c + suffix, expr)
    return out


def split_random(df: DataFrame, key: str, test_pct: int = 20) -> DataFrame:
    """Reproducible 80/20 split from an arithmetic hash of the key."""
    return df.withColumn("split", F.when(is_test(key, test_pct), F.lit("test")).otherwise(F.lit("train")))


def split_stratified(df: DataFrame, label: str, key: str, test_frac: float = 0.2) -> DataFrame:
    """Per class, the ceil(frac·n) rows first in (hash bucket, key) order go
    to test; rows without a class are in neither side. Distributed: one global
    ordering on (class, bucket, key); a class begins at its least position in
    it. The class table is joined on the class and a salt of ``SALTS``, so that
    a class of any share of the rows is many keys, and classes may be many."""
    b = df.filter(F.col(label).isNotNull()).withColumn("_bucket", split_bucket(key))
    idx = global_index(b, [F.col(label), F.col("_bucket"), F.col(key)])
    per = idx.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"), F.min("_idx").alias("_start"))
    per = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.col("_idx"), F.lit(SALTS)).cast("int")
    j = idx.join(per, (F.col(label) == F.col("_label")) & (salt == F.col("_salt")))
    in_test = (F.col("_idx") - F.col("_start")) < F.ceil(F.col("_n") * test_frac)
    return j.withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_bucket", "_idx", "_n", "_start", "_label", "_salt")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 3, out: str = "fold") -> DataFrame:
    """Fold number by dealing each class out in (hash bucket, key) order: fold
    sizes per class differ by one at most, whatever the partitioning."""
    idx = global_index(df.withColumn("_bucket", split_bucket(key)), [F.col(label), F.col("_bucket"), F.col(key)])
    return idx.withColumn(out, F.pmod("_idx", F.lit(folds)).cast("int")).drop("_bucket", "_idx")


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


# ---------------------------------------------------------------- models

MAX_DEPTH = 30  # Spark's deepest tree: stands for "unbounded"


def rf_regressor(label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestRegressor:
    # min_samples_split has no Spark twin; minInstancesPerNode is the nearest knob (kept at 1).
    return RandomForestRegressor(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


def logistic(label: str, max_iter: int = 1000, c: float | None = None, n: int | None = None) -> LogisticRegression:
    """Multinomial logistic regression; C (inverse L2 strength) maps to
    regParam = 1/(C·n)."""
    reg = 0.0 if not c or not n else 1.0 / (c * n)
    return LogisticRegression(labelCol=label, featuresCol="features", maxIter=max_iter, regParam=reg,
                              family="multinomial")


def rf_classifier(label: str, trees: int = 100, depth: int = MAX_DEPTH, seed: int = 42) -> RandomForestClassifier:
    """Deep forests: node ids are kept with the rows instead of sending the
    whole forest to every task at every level."""
    return RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed,
                                  cacheNodeIds=True, maxMemoryInMB=1024)


def cell_forest(label: str, trees: int = 100, depth: int = MAX_DEPTH, seed: int = 42) -> CellForest:
    """The same forest for a few features of many rows: grown from the counts of
    the features' bins, so that its trees don't grow with the rows."""
    return CellForest(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)


TRAIN_PARTITIONS = 8


def training_frame(df: DataFrame) -> DataFrame:
    """Iterative learners scan their input many times: spread it by the first
    column over a fixed number of partitions (one per core on larger
    clusters) and keep it (memory, spilling to disk)."""
    from pyspark import StorageLevel
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(par, TRAIN_PARTITIONS), *df.columns[:1]).persist(StorageLevel.MEMORY_AND_DISK)


SPREAD_ROWS = 1 << 15


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``rows`` rows for a learner that keeps blocks of its own: not kept a second time, and
    in as many partitions as they need for each to be small beside an executor's memory."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(par, TRAIN_PARTITIONS, -(-rows // SPREAD_ROWS)), *df.columns[:1])


def accuracy_of(pred: DataFrame, label: str) -> float:
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    return float(ev.evaluate(pred))


def compare_models(train: DataFrame, valid: DataFrame, label: str, fits: dict, parallelism: int = 1,
                   fitted: dict | None = None) -> DataFrame:
    """Fit each candidate and score training and validation accuracy: (model,
    train_acc, valid_acc, is_best), the first of equal ones best. ``fits``:
    name → function of the training rows that gives a function from rows to
    rows with ``prediction``; ``parallelism`` candidates are fitted side by
    side. ``fitted`` gets the functions from rows to rows by name."""
    spark = train.sparkSession

    def scored(candidate):
        name, fit = candidate
        predict = fit(train)
        if fitted is not None:
            fitted[name] = predict
        return name, accuracy_of(predict(train), label), accuracy_of(predict(valid), label)

    with ThreadPool(parallelism) as pool:
        rows = pool.map(inheritable_thread_target(spark)(scored), fits.items(), chunksize=1)
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    return spark.createDataFrame([(n, a, b, i == best) for i, (n, a, b) in enumerate(rows)],
                                 "model string, train_acc double, valid_acc double, is_best boolean")


def forest_prefix(model: RandomForestClassificationModel, trees: int) -> RandomForestClassificationModel:
    """The forest of a model's first trees. Trees don't know of each other, so
    these are as good a forest of their number as one trained alone."""
    sc = SparkContext._active_spark_context
    java, jvm = model._java_obj, sc._jvm.org.apache.spark.ml.classification
    every = java.trees()
    some = sc._gateway.new_array(jvm.DecisionTreeClassificationModel, trees)
    for k in range(trees):
        some[k] = every[k]
    out = RandomForestClassificationModel(jvm.RandomForestClassificationModel(
        f"{java.uid()}-{trees}", some, java.numFeatures(), java.numClasses()))
    out._java_obj.setFeaturesCol(java.getFeaturesCol())
    return out


def grid_search_cv(df: DataFrame, label: str, key: str, trees: list[int], depths: list[int], folds: int = 3,
                   parallelism: int = 3, seed: int = 42) -> DataFrame:
    """Cross-validated accuracy of forests for every number of trees and depth,
    over stratified folds: (params, cv_accuracy, is_best), the first of equal
    ones best. A forest is trained once per depth and fold, with the most trees
    asked for; the smaller ones are its beginnings. Folds are trained side by side,
    each from the cells of its own training rows."""
    dealt = stratified_folds(df, label, key, folds).persist()

    def scores(fold: int) -> dict[int, list[float]]:
        return held_out_scores(dealt, label, "features", F.col("fold") == fold, trees, depths, seed)

    try:
        with ThreadPool(parallelism) as pool:
            done = pool.map(inheritable_thread_target(df.sparkSession)(scores), range(folds), chunksize=1)
    finally:
        dealt.unpersist()
    rows = []
    for depth in depths:
        of_folds = [s[depth] for s in done]
        rows += [(f"maxDepth={depth}, numTrees={n}", sum(s[k] for s in of_folds) / folds, depth, n) for k, n in enumerate(trees)]
    best = max(range(len(rows)), key=lambda i: (rows[i][1], -i))
    return df.sparkSession.createDataFrame([(p, m, i == best, d, n) for i, (p, m, d, n) in enumerate(rows)],
                                           "params string, cv_accuracy double, is_best boolean, max_depth int, num_trees int")


def feature_importance(model, names: list[str]) -> DataFrame:
    """(feature, importance, rank) sorted descending, ties by name."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    return spark.createDataFrame([(n, float(v), i + 1) for i, (n, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def topk_probabilities(pred: DataFrame, key: str, labels: list[str], k: int = 5,
                       floor: float = 0.03) -> DataFrame:
    """``pred`` has ``probs`` (array) or ``probability`` (ML vector). The k most probable classes per row, dropping those below ``floor``;
    confidence as a percentage with one decimal. The class list is the
    (bounded) label set of the fitted indexer."""
    from quarry.functions.text import round_half_up
    arr = F.col("probs") if "probs" in pred.columns else vector_to_array("probability")
    ex = pred.select(key, F.posexplode(arr).alias("cls", "p"))
    w = Window.partitionBy(key).orderBy(F.desc("p"), F.asc("cls"))
    top = ex.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("p") >= floor))
    names = F.array(*[F.lit(x) for x in labels])
    return top.select(key, "rank", F.element_at(names, F.col("cls") + 1).alias("label"),
                      round_half_up(F.col("p") * 100, 1).alias("confidence"))
