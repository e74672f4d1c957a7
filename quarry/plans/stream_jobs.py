"""Streaming jobs: the benchmark tables are landed as files,
streamed with availableNow, and the sink tables are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.text_features import lexicon_sentiment
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.plans.join_jobs import _INTENT_SQL
from quarry.plans.profile_jobs import validate_requests
from quarry.session import scratch_path
from quarry.sources.tables import Tables
from quarry.streaming import jobs as SJ
from quarry.streaming import keyed as KS

LATE_EVERY = 50  # of the event ids, one in so many arrives in a second file set


@register("stream_threshold_alert", sql=f"""
WITH wm AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events WHERE event_id % {LATE_EVERY} <> 0),
kept AS (SELECT events.* FROM events, wm
         WHERE event_id % {LATE_EVERY} <> 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > wm)
SELECT user_id, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       count(*) FILTER (WHERE event_type = 'error') AS n_hits,
       count(*) FILTER (WHERE event_type = 'error') >= 3 AS is_alert
FROM kept GROUP BY 1, 2, 3""")
def stream_threshold_alert(spark, d):
    """Three arrivals: nearly all events; a fiftieth of them behind the
    watermark, of which those of closed windows are dropped as late; and one
    marker event beyond the end, which closes every window still open (its
    own stays open). Append mode emits each window as it closes."""
    ev = Tables(spark, d).events
    root = scratch_path(spark, "events-stream")
    out = scratch_path(spark, "alerts")
    late = F.col("event_id") % LATE_EVERY == 0
    end = ev.agg(F.max("ts").alias("end"))
    marker = end.select(*[
        (F.col("end") + F.expr("INTERVAL 2 DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ev.schema.fields])
    # each arrival is picked up by a restart of the same query (same
    # checkpoint): the watermark of one run carries into the next
    for i, part in enumerate([ev.filter(~late), ev.filter(late), marker]):
        part.write.mode("overwrite").parquet(f"{root}/part{i}")
        stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", ev.schema)
        alerts = SJ.threshold_alerts(stream, "user_id", "ts", F.col("event_type") == "error", 3)
        SJ.run_to_parquet(alerts, out, "append")
    return spark.read.parquet(out)


@register("stream_intent_route", sql=_INTENT_SQL)
def stream_intent_route(spark, d):
    """Three arrivals, each picked up by a restart of the query."""
    conv = Tables(spark, d).conversations
    root, out = scratch_path(spark, "conv-stream"), scratch_path(spark, "routed")
    rules = FX.intent_rules_df(spark)
    for i in range(3):
        conv.filter(F.pmod("conv_id", F.lit(3)) == i).write.parquet(f"{root}/part{i}")
        stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", conv.schema).filter(F.col("role") == "user")
        SJ.run_foreach_batch(stream, SJ.intent_writer(out, T.trim_lower("text"), rules, FX.INTENT_DEFAULT,
                                                      ["conv_id", "turn", "intent"]), out + "-ckpt")
    return spark.read.parquet(out).select("conv_id", "turn", "intent")


def _syn_sql(e):
    for a, b in T.SYNONYMS:
        e = f"replace({e}, {S.q(a)}, {S.q(b)})"
    return e


_LEX_SQL = S.values(FX.LEXICON, ["word", "pol", "subj"])
_CLEAN = S.preprocess_tokens(_syn_sql("lower(" + S.strip_ws("text") + ")"))


@register("stream_validate_score", sql=f"""
WITH v AS (
  SELECT conv_id, turn, text,
    CASE WHEN text IS NULL OR {S.strip_ws('text')} = '' THEN 'empty'
         WHEN length({S.strip_ws('text')}) < 3 THEN 'too_short'
         WHEN len({_CLEAN}) = 0 THEN 'no_content' END AS error FROM conversations WHERE role = 'user'),
toks AS (SELECT conv_id, turn, unnest({_CLEAN}) AS w FROM v WHERE error IS NULL),
hits AS (SELECT conv_id, turn, count(*) AS n, sum(pol) AS ps FROM toks JOIN {_LEX_SQL} ON toks.w = t.word GROUP BY 1, 2)
SELECT conv_id, turn, 'accepted' AS sink, NULL::VARCHAR AS error,
       coalesce(ps / (n * 10.0), 0.0) AS polarity FROM v LEFT JOIN hits USING (conv_id, turn) WHERE error IS NULL
UNION ALL SELECT conv_id, turn, 'rejected', error, NULL::DOUBLE FROM v WHERE error IS NOT NULL""")
def stream_validate_score(spark, d):
    """validate → clean → sentiment per user message; accepted rows and
    rejects go to two sink tables from one foreachBatch writer."""
    conv = Tables(spark, d).conversations
    root = scratch_path(spark, "conv-validate")
    tokens = T.preprocess_tokens(T.synonym_rewrite(F.lower(T.strip_ws("text"))))

    def score(batch):
        s = lexicon_sentiment(batch, ["conv_id", "turn"], tokens, FX.LEXICON)
        s = s.withColumn("polarity", F.when(F.col("status") == "accepted", F.col("polarity")))
        return s.select("conv_id", "turn", "status", "error", "polarity")

    ok, bad = scratch_path(spark, "accepted"), scratch_path(spark, "rejected")
    for i in range(3):  # each arrival is picked up by a restart of the query
        conv.filter(F.pmod("conv_id", F.lit(3)) == i).write.parquet(f"{root}/part{i}")
        stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", conv.schema).filter(F.col("role") == "user")
        checked = validate_requests(stream.select("conv_id", "turn", "text"))
        SJ.run_foreach_batch(checked, SJ.two_sink_writer(ok, bad, prepare=score), ok + "-ckpt")
    a = spark.read.parquet(ok).select("conv_id", "turn", F.lit("accepted").alias("sink"), "error", "polarity")
    b = spark.read.parquet(bad).select("conv_id", "turn", F.lit("rejected").alias("sink"), "error", "polarity")
    return a.unionByName(b)


@register("stream_latest_state", sql="""
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_latest_state(spark, d):
    """Newest state per key, upserted batch by batch (three file batches) as
    deltas on a base, merged on read."""
    ev = Tables(spark, d).events
    root = SJ.stage_files(ev, "events-latest", [F.col("event_id") % 3 == i for i in range(3)])
    stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", ev.schema, max_files=1)
    table = scratch_path(spark, "latest")
    how = ("user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])
    SJ.run_foreach_batch(stream, SJ.latest_state_upsert(spark, table, *how), table + "-ckpt")
    return SJ.read_latest(spark, table, *how)


@register("stream_until_sentinel", sql="""
WITH stop AS (SELECT user_id, min((ts, event_id)) AS s FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e LEFT JOIN stop USING (user_id)
WHERE stop.s IS NULL OR (e.ts, e.event_id) < stop.s""")
def stream_until_sentinel(spark, d):
    """Per key, messages from the first stop on are ignored. Four arrivals in
    order of time, each picked up by a restart of the query: a key's stop is
    its state, kept in the state store across arrivals and restarts."""
    ev = Tables(spark, d).events.select("user_id", "event_id", "event_type", "ts")
    root, out = scratch_path(spark, "events-sentinel"), scratch_path(spark, "until")
    low, high = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                       F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    quarter = F.floor(4 * (F.unix_micros(F.col("ts").cast("timestamp")) - (low or 0)) / ((high or 0) - (low or 0) + 1))
    for i in range(4):
        ev.filter(F.coalesce(quarter, F.lit(0)) == i).write.parquet(f"{root}/part{i}")
        stream = SJ.event_stream(spark, f"{root}/part*/*.parquet", ev.schema)
        passed = KS.until_sentinel(stream, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
        with KS.state_store(spark):
            SJ.run_to_parquet(passed.select("user_id", "event_id", "event_type"), out)
    return spark.read.parquet(out)
