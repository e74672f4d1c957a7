"""Table profiling and aggregate operators.

All of them are single declarative plans: one-pass aggregates with
partial (map-side) aggregation, unpivot to long form, and a distributed
global ordering for exact quantiles and sequential ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id << 33 | row in partition


def global_index(df: DataFrame, order: list, n_parts: int | None = None,
                 name: str = "_idx") -> DataFrame:
    """0-based position of each row in the total order ``order``.

    Range-partition on the order (give it a unique tie-break last: bounds
    can split hot values only if the order is total), sort inside the
    partitions, take the place in the partition, and add the row counts of
    all earlier partitions. The sorted rows are written to the checkpoint
    folder with partition and place in them first: rows and counts must come
    from one and the same layout, and two evaluations of a range exchange
    need not sample the same bounds (they differ as soon as one of them is
    pruned to other columns). The count table has one row per partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id())
         .withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
         .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
         .drop("_mid").checkpoint())
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"))
    offs = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(name, F.col("_off") + F.col("_loc"))
            .drop("_pid", "_loc", "_off"))


def unpivot_columns(df: DataFrame, ids: list[str], cols: list[str], var="column",
                    val="value", cast: str | None = None) -> DataFrame:
    vals = [F.col(c).cast(cast) if cast else F.col(c) for c in cols]
    return df.select(*ids, *[v.alias(c) for v, c in zip(vals, cols)]).unpivot(ids, cols, var, val)


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/`quantile_cont`
    semantics) for several columns at once.

    Values are first reduced to (column, value, count) with map-side partial
    aggregation, so repeated values cost nothing; the distinct values are
    then put in one distributed order (range partitions) and each gets the
    number of values before it (per-partition running sums plus the totals
    of the earlier partitions). The 2·|cols|·|qs| interpolation positions
    are located with a range condition against that table, the positions
    being the small, broadcast side.
    """
    long = unpivot_columns(df, [], cols, cast="double").filter(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count("*").alias("c"))
    cum = _prefix_counts(vc, ["column", "value"])  # adds "before" (values of the column before this one)
    per_col = vc.groupBy("column").agg(F.sum("c").alias("n"))
    targets = (per_col.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
               .withColumn("pos", (F.col("n") - 1) * F.col("q"))
               .withColumn("lo", F.floor("pos")).withColumn("hi", F.ceil("pos"))
               .withColumn("frac", F.col("pos") - F.floor("pos")))
    ends = targets.select("column", "q", F.col("lo").alias("at"), F.lit("lo").alias("end")).unionByName(
        targets.select("column", "q", F.col("hi").alias("at"), F.lit("hi").alias("end")))
    ends = ends.withColumnRenamed("column", "_col")
    hit = cum.join(F.broadcast(ends),  # 2·|cols|·|qs| rows
                   (F.col("column") == F.col("_col")) & (F.col("before") <= F.col("at"))
                   & (F.col("at") < F.col("before") + F.col("c")))
    vals = hit.groupBy("column", "q").agg(
        F.max(F.when(F.col("end") == "lo", F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("end") == "hi", F.col("value"))).alias("v_hi"))
    return (vals.join(targets.select("column", "q", "frac"), ["column", "q"])
            .select("column", "q", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("value")))


def _prefix_counts(df: DataFrame, order: list[str], weight: str = "c") -> DataFrame:
    """Adds ``before`` = sum of ``weight`` over rows earlier in ``order``
    within the same first order column, computed globally: range partitions,
    a running sum inside each partition, and the totals of earlier
    partitions (one row per partition, broadcast)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # (checkpointed: see global_index)
    ensure_checkpoint_dir(spark)
    s = s.withColumn("_in", F.coalesce(F.sum(weight).over(w), F.lit(0))).checkpoint()
    tot = s.groupBy("_pid").agg(F.sum(weight).alias("_t"))
    offs = tot.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    g = s.join(F.broadcast(offs), "_pid").withColumn("_glob", F.col("_off") + F.col("_in"))
    # subtract everything belonging to earlier values of the first order column
    first = order[0]
    starts = g.groupBy(first).agg(F.min("_glob").alias("_start"))
    # (one row per value of the first order column: the caller's list of columns)
    return g.join(F.broadcast(starts), first).withColumn("before", F.col("_glob") - F.col("_start")).drop(
        "_pid", "_in", "_off", "_glob", "_start")


def null_counts(df: DataFrame, only_with_nulls: bool = False) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    out = row.unpivot([], df.columns, "column", "n_null")
    return out.filter(F.col("n_null") > 0) if only_with_nulls else out


def table_info(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return (row.unpivot([], df.columns, "column", "non_null")
            .withColumn("dtype", F.element_at(types, F.col("column"))))


def histogram_bins(df: DataFrame, col: str, n_bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin right-closed, nulls ignored;
    empty bins kept (joined from the bin range). A constant column gets the
    range of width one around its value; without values the edges are null."""
    spark = df.sparkSession
    v = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    lo_v, hi_v = v.agg(F.min("v"), F.max("v")).first()  # one row: the range
    if lo_v is not None and lo_v == hi_v:
        lo_v, hi_v = lo_v - 0.5, hi_v + 0.5
    lo, hi = F.lit(lo_v).cast("double"), F.lit(hi_v).cast("double")
    binned = (v.select(F.least(F.floor((F.col("v") - lo) / (hi - lo) * n_bins).cast("int"),
                               F.lit(n_bins - 1)).alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("n")))
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(binned, "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * (hi - lo) / n_bins).alias("edge_lo"),
                    (lo + (F.col("bin") + 1) * (hi - lo) / n_bins).alias("edge_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All-pairs Pearson in one aggregate pass (i <= j), mirrored; a constant
    column gives null (as pandas) instead of a division error."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = [F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}")
            for a, b in pairs]
    row = df.agg(*aggs)
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    long = long.select(F.split("pair", r"\|").alias("p"), "corr")
    one = long.select(F.col("p")[0].alias("col_a"), F.col("p")[1].alias("col_b"), "corr")
    other = long.filter(F.col("p")[0] != F.col("p")[1]).select(
        F.col("p")[1].alias("col_a"), F.col("p")[0].alias("col_b"), "corr")
    return one.unionByName(other)


def crosstab(df: DataFrame, feature: str, target: str, values: list) -> DataFrame:
    """Counts by (feature, class), classes as columns, zero filled. The class
    values are passed in (bounded), so pivot needs no extra distinct job."""
    return (df.groupBy(feature).pivot(target, values).count().na.fill(0, [str(v) for v in values]))
