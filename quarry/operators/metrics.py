"""Evaluation metrics from (actual, predicted) tables, all as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path


def accuracy(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    return df.agg(F.count("*").alias("n"),
                  F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """actual × predicted counts over all classes seen on either side, zero
    filled. A null label is a class of its own, so the counts always add up
    to the rows. The grid is the class list against itself (the K² rows that
    the result has anyway)."""
    counts = df.groupBy(F.col(actual).alias("_a"), F.col(predicted).alias("_p")).agg(F.count("*").alias("n"))
    classes = counts.select(F.col("_a").alias("c")).union(counts.select(F.col("_p").alias("c"))).distinct()
    grid = classes.select(F.col("c").alias("actual")).crossJoin(classes.select(F.col("c").alias("predicted")))
    return (grid.join(counts, F.col("actual").eqNullSafe(F.col("_a")) & F.col("predicted").eqNullSafe(F.col("_p")), "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def classification_report(df: DataFrame, actual="actual", predicted="predicted") -> DataFrame:
    """Per class precision, recall, F1, support; then accuracy, macro and
    weighted averages as extra rows (``label`` = 'accuracy', 'macro avg',
    'weighted avg'); undefined ratios are 0."""
    # Counts by (actual, predicted) pair that occurs, not the grid of all pairs: K
    # classes give K rows. Rows without one of the labels can't be judged and are left out.
    path = scratch_path(df.sparkSession, "report")
    (df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
     .groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n")).write.parquet(path))
    counts = df.sparkSession.read.parquet(path)
    hit = F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)
    sides = counts.select(F.col("a").alias("c"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("npred")).unionByName(
        counts.select(F.col("p").alias("c"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("npred")))
    r = sides.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "support", "npred")])
    r = (r.withColumn("precision", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred")), F.lit(0.0)))
         .withColumn("recall", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0)))
         .withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                   F.col("precision") + F.col("recall")), F.lit(0.0))))
    classes = r.select(F.col("c").cast("string").alias("label"), "precision", "recall", "f1",
                       F.col("support").cast("bigint").alias("support"))
    tot = r.agg(F.sum("support").alias("n"), F.sum("tp").alias("tp"),
                F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("label"), (F.col("tp") / F.col("n")).alias("precision"),
                     (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("n")).alias("f1"),
                     F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                       F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)
