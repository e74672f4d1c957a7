"""Semi-structured jobs: JSON in and out, nested paths, maps keyed by date,
pipe-table markup (SURVEY §2.1 emit_*, §2.8 JSON / markup)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import semistructured as SS
from quarry.plans.catalog import register
from quarry.sources.tables import Tables


@register("ingest_json", sql="""
SELECT event_id, json_extract(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.absent') AS absent FROM events""")
def ingest_json(spark, d):
    """JSON text → typed struct with a declared DDL schema (no inference)."""
    e = Tables(spark, d).events
    return SS.parse_json(e, "props", "k int, absent string").select("event_id", "j.k", "j.absent")


@register("json_get_lenient", sql="""
SELECT event_id, coalesce(json_extract_string(props, '$.k')::INTEGER, -1) AS k,
       coalesce(json_extract_string(props, '$.absent'), 'n/a') AS absent FROM events""")
def json_get_lenient(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id",
                    F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(-1)).alias("k"),
                    F.coalesce(F.get_json_object("props", "$.absent"), F.lit("n/a")).alias("absent"))


@register("json_path_strict", sql="""
SELECT o_orderkey, fp AS first_part, CASE WHEN fp IS NULL THEN 'reject' ELSE 'ok' END AS status
FROM orders LEFT JOIN (
  SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_quantity)) AS fp FROM lineitem GROUP BY 1
) f ON f.l_orderkey = o_orderkey""")
def json_path_strict(spark, d):
    """Orders serialised with their lines as nested JSON, parsed back with a
    declared schema; path ``detail.lines[0].l_partkey``; a missing path is
    routed to status 'reject' instead of failing the job."""
    t = Tables(spark, d)
    docs = SS.orders_as_json(t.orders, t.lineitem)
    parsed = SS.parse_json(docs, "json", SS.ORDER_JSON_DDL)
    first = F.get(F.col("j.detail.lines"), 0)["l_partkey"]
    return parsed.select(F.col("j.key").alias("o_orderkey"), first.alias("first_part"),
                         F.when(first.isNull(), F.lit("reject")).otherwise(F.lit("ok")).alias("status"))


REQUESTED_DAY = "1996-11-01"


@register("map_key_explode", sql=f"""
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem),
hit AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE strftime(l_shipdate, '%Y-%m-%d') = '{REQUESTED_DAY}')
SELECT o.l_orderkey, hit.l_partkey AS part FROM o LEFT JOIN hit USING (l_orderkey)""")
def map_key_explode(spark, d):
    """Per order a map day → parts shipped that day; the requested day's
    entry is exploded (outer: orders without it keep one null row)."""
    li = Tables(spark, d).lineitem
    m = SS.map_by_day(li, "l_orderkey", "l_shipdate", "l_partkey")
    return m.select("l_orderkey", F.explode_outer(F.element_at("by_day", F.lit(REQUESTED_DAY))).alias("part"))


_EMIT_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@register("emit_json", sql=f"""
SELECT o_orderkey, to_json(struct_pack({', '.join(f'{c} := {c}' for c in _EMIT_FIELDS)}))::VARCHAR AS json FROM orders""")
def emit_json(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", F.to_json(F.struct(*_EMIT_FIELDS)).alias("json"))


@register("emit_base64", sql="SELECT item_id, to_base64(encode(text)) AS b64 FROM benchmark")
def emit_base64(spark, d):
    b = Tables(spark, d).benchmark
    return b.select("item_id", SS.base64_text("text").alias("b64"))


@register("markup_table_rows", sql="""
SELECT r_name AS region, 0::BIGINT AS row, c.col::BIGINT AS col, c.cell, true AS is_header
FROM region, (VALUES (0, 'n_nationkey'), (1, 'n_name')) AS c(col, cell)
UNION ALL
SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::BIGINT, 0::BIGINT,
       CAST(n_nationkey AS VARCHAR), false FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey)::BIGINT, 1::BIGINT,
       n_name, false FROM nation JOIN region ON n_regionkey = r_regionkey""")
def markup_table_rows(spark, d):
    """Pipe-table text (built per region from `nation`) parsed into
    (row, col, cell, is_header) with the separator row skipped."""
    t = Tables(spark, d)
    texts = SS.nation_pipe_tables(t.nation, t.region)
    return SS.parse_pipe_table(texts, "region", "md")
