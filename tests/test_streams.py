"""Streams whose state outlives a restart."""

from pyspark.sql import functions as F

from quarry.streaming import jobs as SJ
from quarry.streaming import keyed as KS

SCHEMA = "k long, _odd string, at long, event string"


def arrive(spark, root, out, i, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{root}/part{i}")
    stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", spark.createDataFrame([], SCHEMA).schema)
    with KS.state_store(spark):
        SJ.run_to_parquet(KS.until_sentinel(stream, "k", ["at"], F.col("event") == "stop"), out)


def test_stops_survive_restarts(spark, tmp_path):
    root, out = f"{tmp_path}/in", f"{tmp_path}/out"
    arrivals = [
        [(1, "a", 1, "x"), (1, "b", 2, "y"), (2, "c", 1, "x"), (None, "d", 1, "x")],
        [(1, "e", 4, "stop"), (1, "f", 3, "x"), (1, "g", 5, "x"), (2, "h", 2, None)],
        [(1, "i", 9, "x"), (2, "j", 3, "stop"), (2, "k", 3, "x"), (None, "l", 2, "stop")],
        [(1, "m", 2, "late, before the stop"), (1, "n", 4, "x"), (2, "o", 8, "x"), (None, "p", 3, "x"), (3, "q", None, "x")],
    ]
    for i, rows in enumerate(arrivals):  # every arrival is a restart of the query
        arrive(spark, root, out, i, rows)
    got = sorted(r["_odd"] for r in spark.read.parquet(out).collect())
    assert got == ["a", "b", "c", "d", "f", "h", "m", "q"]


def test_the_setting_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with KS.state_store(spark):
        assert spark.conf.get(name) == KS.ROCKSDB
    assert spark.conf.get(name, None) == before


def folder_bytes(path):
    import os
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-"))


def test_a_batch_writes_what_it_brings(spark, tmp_path):
    """Small batches on a large table leave the base alone until they add up; replays change nothing."""
    import os
    how = ("k", ["at"], ["at", "v"])
    table = str(tmp_path / "t")
    upsert = SJ.latest_state_upsert(spark, table, *how)
    first = spark.range(20_000).select(F.col("id").alias("k"), F.lit(0).alias("at"), F.md5(F.col("id").cast("string")).alias("v"))
    upsert(first, 0)
    base = folder_bytes(f"{table}/v=0")
    for b in range(1, 6):
        batch = spark.range(b * 100, b * 100 + 150).select(F.col("id").alias("k"), F.lit(b).alias("at"), F.lit(f"b{b}").alias("v"))
        upsert(batch, b)
        assert folder_bytes(f"{table}/d={b}") < base / 20 and not os.path.exists(f"{table}/v={b}")
    upsert(batch, 5)  # replayed
    got = {r.k: (r["at"], r.v) for r in SJ.read_latest(spark, table, *how).collect()}
    assert len(got) == 20_000 and got[0][0] == 0 and got[149] == (1, "b1") and got[210] == (2, "b2") and got[640] == (5, "b5")
    big = first.withColumn("at", F.lit(9)).withColumn("v", F.lit("new"))
    upsert(big, 6)
    assert os.path.exists(f"{table}/v=6/_SUCCESS")
    upsert(big, 6)
    assert {(r["at"], r.v) for r in SJ.read_latest(spark, table, *how).collect()} == {(9, "new")}
    os.remove(f"{table}/v=6/_SUCCESS")  # a base that was never finished doesn't count
    assert {(r["at"], r.v) for r in SJ.read_latest(spark, table, *how).collect()} == {(9, "new")}
