"""Typed access to the benchmark tables (one Parquet file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


# Tables whose rows carry CPU-heavy payloads (long texts, vectors): when a
# scan yields fewer splits than the cluster has cores (e.g. one small file
# with one row group), rows are spread round-robin first so the per-row
# work runs on every core. On big inputs the scan already has far more
# splits than cores and nothing is added.
CPU_HEAVY = {"documents", "pages", "conversations", "embeddings", "benchmark"}


def balance(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    par = sc.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table. Parquet carries the schema; Catalyst prunes columns
    and pushes filters into the scan, so callers just select/filter."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return balance(df) if name in CPU_HEAVY else df


class Tables:
    """``t = Tables(spark, sf_dir); t.lineitem`` – lazy DataFrame handles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        from quarry.session import ship_package

        ship_package(spark)
        self._spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self._spark, self._dir, name)
