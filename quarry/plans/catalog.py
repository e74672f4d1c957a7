"""Registry pairing each operator key with its Spark job and SQL oracle.

A job is ``fn(spark, sf_dir) -> DataFrame``; the oracle is a SQL string
over the same tables (registered as views) that a second engine can run.
Keys without an oracle are checked on rows only.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    job: Job
    sql: str | None


REGISTRY: dict[str, Entry] = {}

# Modules whose import registers jobs.
PLAN_MODULES = (
    "quarry.plans.text_jobs",
    "quarry.plans.profile_jobs",
    "quarry.plans.join_jobs",
    "quarry.plans.rank_jobs",
    "quarry.plans.semistructured_jobs",
    "quarry.plans.source_jobs",
    "quarry.plans.vector_jobs",
    "quarry.plans.raster_jobs",
    "quarry.plans.graph_jobs",
    "quarry.plans.ml_jobs",
    "quarry.plans.stream_jobs",
    "quarry.plans.udf_jobs",
)


def register(key: str, sql: str | None = None):
    def deco(fn: Job) -> Job:
        if key in REGISTRY:
            raise ValueError(f"duplicate key {key}")
        REGISTRY[key] = Entry(key, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    for m in PLAN_MODULES:
        importlib.import_module(m)
    return REGISTRY
