"""Streams with state per key, kept in the state store.

The state lives in the checkpoint folder of the query (RocksDB snapshots and
change logs), so a query that is started again goes on where it stopped, and a
batch writes the state of its own keys only.
"""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Start queries with keyed state inside: they need the RocksDB store, and
    read the setting when they start."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _UntilStop(StatefulProcessor):
    """State of a key: the place of its first stop so far, as the order's numbers."""

    def __init__(self, order: list[str], keep: list[str]):
        self.order, self.keep = order, keep

    def init(self, handle) -> None:
        self.stop = handle.getValueState("stop", ", ".join(f"{c} bigint" for c in self.order))

    def handleInputRows(self, key, rows, timerValues):
        known = tuple(self.stop.get()) if self.stop.exists() else None
        first, waiting = known, []
        for part in rows:
            part = part.set_axis([*self.keep, *self.order, "__stop"], axis=1)  # (rows arrive as tuples that rename)
            at = list(zip(*(part[c] for c in self.order)))
            stops = [a for a, s in zip(at, part["__stop"]) if s]
            if stops:
                first = min(stops) if first is None else min(first, min(stops))
            # what lies behind a known stop is gone; the rest waits for an earlier one
            waiting.append(part if first is None else part[[a < first for a in at]])
        if first != known:
            self.stop.update(tuple(int(x) for x in first))
        for part in waiting:
            if first is not None:
                part = part[[a < first for a in zip(*(part[c] for c in self.order))]]
            if len(part):
                yield part[self.keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def until_sentinel(stream: DataFrame, key: str, order: list[str], is_stop: Column) -> DataFrame:
    """Per key, the rows before its first stop row, over all arrivals.

    The place of a row is ``order`` (numbers or timestamps, compared in turn;
    nulls come first). A key's first stop is kept as state: rows of later
    arrivals behind it are dropped, rows that were passed on before an earlier
    stop became known are not taken back. Rows with a null key are a key of
    their own. The rows of one key in one arrival meet in one task and wait
    there until the arrival's stops are known, so the size of an arrival
    (``maxFilesPerTrigger``) bounds a task."""
    places = []
    for k, c in enumerate(order):
        timed = dict(stream.dtypes)[c].startswith("timestamp")
        n = F.unix_micros(F.col(c).cast("timestamp")) if timed else F.col(c).cast("bigint")
        places.append(F.coalesce(n, F.lit(-(1 << 63))).alias(f"__at{k}"))
    names = [f"__at{k}" for k in range(len(order))]
    rows = stream.select("*", *places, F.coalesce(is_stop, F.lit(False)).alias("__stop"))
    schema = StructType(stream.schema.fields)
    return rows.groupBy(key).transformWithStateInPandas(
        _UntilStop(names, stream.columns), outputStructType=schema, outputMode="Append", timeMode="None")
