"""Ordering operators that stay distributed: sequential ids, latest per key,
take-until-sentinel, top-k share per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import round_half_up
from quarry.operators.profile import global_index


def sequential_id(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """1..n in the given order, computed with the distributed two-pass
    method (range partitions + per-partition offsets), never a window over
    one partition."""
    return global_index(df, order, name="_gi").withColumn(name, (F.col("_gi") + 1).cast("bigint")).drop("_gi")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Newest row per key by ``order`` (last column breaks ties).

    ``max_by`` over a struct is an ordinary aggregate, so each map task
    keeps one candidate per key before the shuffle: a hot key costs one row
    per task, not all its rows in one task.
    """
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{f}").alias(f) for f in fields])


def take_until_sentinel(df: DataFrame, key: str, order: list[str], is_stop: Column) -> DataFrame:
    """Rows of each key strictly before its first stop row (all rows when
    there is none). The first stop per key is a partial/final aggregate;
    the join back is on the key (AQE splits skewed keys)."""
    stop = (df.filter(is_stop).groupBy(key)
            .agg(F.min(F.struct(*order)).alias("_stop")))
    j = df.join(stop, key, "left")
    return j.filter(F.col("_stop").isNull() | (F.struct(*order) < F.col("_stop"))).drop("_stop")


def topk_share(df: DataFrame, group: str, item: str, value: str, k: int = 5,
               floor: float = 0.03) -> DataFrame:
    """Per group: the k items with the largest share of the group total
    (ties by item), shares below ``floor`` dropped, percent to 1 decimal.

    Input is already aggregated to (group, item); the group total is a
    second small aggregate joined back, and the ranking window runs over
    the items of one group only.
    """
    tot = df.groupBy(group).agg(F.sum(value).alias("_tot"))
    s = df.join(tot, group).withColumn("_s", F.col(value).cast("double") / F.col("_tot").cast("double"))
    w = Window.partitionBy(group).orderBy(F.desc("_s"), F.asc(item))
    r = s.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return r.filter((F.col("rank") <= k) & (F.col("_s") >= floor)).select(
        group, "rank", item, round_half_up(F.col("_s") * 100, 1).alias("pct"))
