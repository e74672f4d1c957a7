"""Lookup, enrichment and rule joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import joins as J
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.sources.tables import Tables

_ITEMS = ", ".join(f"Item_{k}" for k in range(1, FX.WIDE_SLOTS + 1))


@register("lookup_join_default", sql=f"""
SELECT l_orderkey, sheet, slot, name, coalesce(weight, 0) AS weight
FROM (UNPIVOT ({FX.WIDE_ITEMS_SQL}) ON {_ITEMS} INTO NAME slot VALUE name) u
LEFT JOIN ({FX.SIZE_LOOKUP_SQL}) lk USING (name)""")
def lookup_join_default(spark, d):
    t = Tables(spark, d)
    wide = FX.wide_items(t)
    long = wide.unpivot(["l_orderkey", "sheet"], [c for c in wide.columns if c.startswith("Item_")], "slot", "name")
    long = long.filter(F.col("name").isNotNull())
    return J.lookup_default(long, FX.size_lookup(t), "name", "weight", 0)


@register("build_lookup_last_wins", sql="""
SELECT user_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1""")
def build_lookup_last_wins(spark, d):
    e = Tables(spark, d).events
    return J.build_lookup_last_wins(e, "user_id", "value", "event_id").withColumnRenamed("value", "last_value")


@register("enrich_two_tables", sql="""
SELECT o_orderkey, coalesce(items, []) AS items FROM orders LEFT JOIN (
  SELECT l_orderkey, list_sort(list(trim(p_name))) AS items FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1) i ON i.l_orderkey = o_orderkey""")
def enrich_two_tables(spark, d):
    """Orders enriched with the (trimmed, sorted) part names of their lines;
    orders without lines get an empty list; lines of unknown orders are
    ignored. The per-order list is bounded by the lines of one order."""
    t = Tables(spark, d)
    lines = (t.lineitem.select("l_orderkey", "l_partkey")
             .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
             .select(F.col("l_orderkey").alias("o_orderkey"), T.strip_ws(F.trim("p_name")).alias("v")))
    return J.enrich_with_list(t.orders.select("o_orderkey"), lines, "o_orderkey", "v", "items")


@register("lookup_by_ordinal", sql="""
SELECT vec_id, label, lang, n_chars FROM embeddings JOIN documents ON doc_id = vec_id""")
def lookup_by_ordinal(spark, d):
    t = Tables(spark, d)
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "n_chars")
    return t.embeddings.select("vec_id", "label").join(docs, "vec_id")


def _intent_sql(e):
    whens = " ".join(
        f"WHEN {' OR '.join(f'contains({e}, {S.q(k)})' for k in ks)} THEN {S.q(i)}"
        for _, i, ks in sorted(FX.INTENT_RULES))
    return f"CASE {whens} ELSE {S.q(FX.INTENT_DEFAULT)} END"


_INTENT_SQL = f"""
SELECT conv_id, turn, {_intent_sql(S.trim_lower('text'))} AS intent FROM conversations WHERE role = 'user'"""


@register("intent_theta_join", sql=_INTENT_SQL)
def intent_theta_join(spark, d):
    c = Tables(spark, d).conversations.filter(F.col("role") == "user")
    out = J.keyword_classify(c, T.trim_lower("text"), FX.intent_rules_df(spark), FX.INTENT_DEFAULT)
    return out.select("conv_id", "turn", "intent")


@register("response_lookup", sql=f"""
WITH i AS ({_INTENT_SQL}),
r AS (SELECT * FROM {S.values([(k, list(v)) for k, v in FX.REPLIES], ['intent', 'texts'])})
SELECT conv_id, turn, intent, texts[1 + (conv_id * 7 + turn) % len(texts)] AS reply FROM i JOIN r USING (intent)""")
def response_lookup(spark, d):
    """intent → canned reply; several replies → deterministic pick by id."""
    c = Tables(spark, d).conversations.filter(F.col("role") == "user")
    intents = J.keyword_classify(c, T.trim_lower("text"), FX.intent_rules_df(spark), FX.INTENT_DEFAULT)
    rep = FX.replies_df(spark)
    j = intents.join(F.broadcast(rep), "intent")  # one row per intent: bounded
    pick = F.element_at("texts", (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.size("texts")) + 1).cast("int"))
    return j.select("conv_id", "turn", "intent", pick.alias("reply"))


_BOX_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@register("box_neighbour_filter", sql=f"""
WITH b AS (
  SELECT row_number() OVER (ORDER BY {', '.join(_BOX_ORDER)})::BIGINT AS id, l_orderkey // 4 AS img,
         l_partkey % 200 AS x, l_suppkey % 200 AS y, floor(l_quantity)::INTEGER AS w, floor(l_quantity)::INTEGER AS h
  FROM lineitem),
c AS (SELECT a.id, count(o.id) AS n_overlap FROM b a LEFT JOIN b o
      ON o.img = a.img AND o.id <> a.id AND o.x < a.x + a.w AND a.x < o.x + o.w AND o.y < a.y + a.h AND a.y < o.y + o.h
      GROUP BY a.id)
SELECT b.*, n_overlap FROM b JOIN c USING (id) WHERE w >= 30 AND h >= 30 AND n_overlap >= 3""")
def box_neighbour_filter(spark, d):
    """Candidate boxes from every lineitem row (image = order key div 4,
    x = part mod 200, y = supplier mod 200, side = quantity): keep boxes of
    at least 30×30 overlapping at least 3 other boxes of their image. The
    overlap counts come from prefix/dominance counts, never from box pairs."""
    from quarry.operators.boxes import neighbour_filter
    from quarry.operators.ranking import sequential_id
    li = Tables(spark, d).lineitem.select(*_BOX_ORDER)
    boxes = sequential_id(li, _BOX_ORDER).select(
        "id", F.floor(F.col("l_orderkey") / 4).cast("bigint").alias("img"),
        F.pmod("l_partkey", F.lit(200)).alias("x"), F.pmod("l_suppkey", F.lit(200)).alias("y"),
        F.floor("l_quantity").cast("int").alias("w"), F.floor("l_quantity").cast("int").alias("h"))
    return neighbour_filter(boxes, 3, 30, 30).select("id", "img", "x", "y", "w", "h", "n_overlap")
