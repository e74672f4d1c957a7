"""Structured Streaming jobs: file source → transformations → sinks.

Every query runs with ``trigger(availableNow=True)`` over the files that
are present, with its own checkpoint location in the shared checkpoint
folder, so a restarted query resumes where it stopped. Sinks are Parquet
folders (or foreachBatch writers for multi-output and upsert logic), never
driver memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.joins import keyword_classify
from quarry.session import scratch_path


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_to_parquet(df: DataFrame, out: str, mode: str = "append") -> None:
    q = (df.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(df: DataFrame, fn, ckpt: str, mode: str = "append") -> None:
    q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def threshold_alerts(events: DataFrame, key: str, ts: str, is_hit, threshold: int = 3,
                     window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Per key and tumbling window: hit count and alert flag. Event time is
    a session-zone timestamp (watermarks reject timestamp_ntz); rows whose
    window is already closed by the watermark are dropped as late."""
    e = events.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", delay)
    g = e.groupBy(F.window("_et", window).alias("w"), F.col(key)).agg(F.count_if(is_hit).alias("n_hits"))
    return g.select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n_hits",
                    (F.col("n_hits") >= threshold).alias("is_alert"))


def intent_writer(path: str, text, rules: DataFrame, default: str, columns: list[str]):
    """foreachBatch writer of per-message classification: a folder a batch,
    overwritten when the batch is replayed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        keyword_classify(batch, text, rules, default).select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


COMPACT_SHARE = 0.5  # deltas of this share of the base's rows are merged into a new base


def latest_state_upsert(spark: SparkSession, table_path: str, key: str, order: list[str], fields: list[str],
                        share: float = COMPACT_SHARE):
    """foreachBatch writer keeping the newest row per key, merged on read.

    A batch is reduced to one row per key (partial aggregation) and written as
    a delta of its own, so what a batch writes follows the batch, not the table.
    When the deltas since the last base have ``share`` of its rows, base and
    deltas become a new base: over time that costs each row a bounded number of
    rewrites. Both are named by batch id and written with overwrite, and a base
    counts once it is complete, so a replayed batch changes nothing."""
    def upsert(batch: DataFrame, batch_id: int) -> None:
        newest = _newest(batch, key, order, fields)
        newest.write.mode("overwrite").parquet(f"{table_path}/d={batch_id}")
        base, deltas = _pieces(spark, table_path, batch_id)
        rows = sum(spark.read.parquet(p).count() for p in deltas)  # (from the files' footers)
        if base is None or rows > share * spark.read.parquet(base).count():
            if base != f"{table_path}/v={batch_id}":
                _merged(spark, base, deltas, key, order, fields).write.mode("overwrite").parquet(f"{table_path}/v={batch_id}")
    return upsert


def _newest(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"s.{f}").alias(f) for f in fields])


def _merged(spark: SparkSession, base: str | None, deltas: list[str], key: str, order: list[str],
            fields: list[str]) -> DataFrame:
    return _newest(spark.read.parquet(*([base] if base else []), *deltas), key, order, fields)


def _pieces(spark: SparkSession, path: str, upto: int) -> tuple[str | None, list[str]]:
    """The newest complete base up to a batch, and the deltas after it up to the batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"v": [], "d": []}
    if fs.exists(p):
        for st in fs.listStatus(p):
            kind, _, n = st.getPath().getName().partition("=")
            done = spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
            if kind in found and int(n) <= upto and fs.exists(done):
                found[kind].append(int(n))
    at = max(found["v"], default=None)
    return (None if at is None else f"{path}/v={at}",
            [f"{path}/d={n}" for n in sorted(found["d"]) if at is None or n > at])


def read_latest(spark: SparkSession, path: str, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The newest row per key of base and deltas."""
    base, deltas = _pieces(spark, path, 1 << 62)
    return _merged(spark, base, deltas, key, order, fields)


def two_sink_writer(ok_path: str, bad_path: str, split_col: str = "status", ok_value: str = "accepted",
                    prepare=None):
    """foreachBatch writer sending accepted rows and rejects to two tables
    (per-batch folders, overwritten on replay). ``prepare`` is applied to the
    batch first: what needs joins or sums over the batch goes there."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = (prepare(batch) if prepare else batch).persist()
        batch.filter(F.col(split_col) == ok_value).write.mode("overwrite").parquet(f"{ok_path}/batch={batch_id}")
        batch.filter(F.col(split_col) != ok_value).write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        batch.unpersist()
    return write


def stage_files(df: DataFrame, name: str, parts: list | None = None) -> str:
    """Land a table as Parquet files for a stream to pick up; ``parts``:
    optional list of filters, each written as its own later file set."""
    spark = df.sparkSession
    root = scratch_path(spark, name)
    if not parts:
        df.write.mode("overwrite").parquet(f"{root}/part0")
    else:
        for i, cond in enumerate(parts):
            df.filter(cond).write.mode("overwrite").parquet(f"{root}/part{i}")
    return root
