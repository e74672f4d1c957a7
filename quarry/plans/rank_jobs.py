"""Window, ordering, top-k and set jobs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text as T
from quarry.operators import profile as P
from quarry.operators import ranking as RK
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.sources.tables import Tables

R = T.round_half_up
RS = S.round_half_up


@register("sequential_id", sql="""
SELECT row_number() OVER (ORDER BY o_orderkey)::BIGINT AS id, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders""")
def sequential_id(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return RK.sequential_id(o, ["o_orderkey"])


@register("latest_per_key", sql="""
SELECT user_id, event_id, ts, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def latest_per_key(spark, d):
    e = Tables(spark, d).events
    return RK.latest_per_key(e, ["user_id"], ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


@register("take_until_sentinel", sql="""
WITH stop AS (SELECT user_id, min((ts, event_id)) AS s FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.user_id, e.event_id, e.event_type FROM events e LEFT JOIN stop USING (user_id)
WHERE stop.s IS NULL OR (e.ts, e.event_id) < stop.s""")
def take_until_sentinel(spark, d):
    e = Tables(spark, d).events.select("user_id", "event_id", "ts", "event_type")
    out = RK.take_until_sentinel(e, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("user_id", "event_id", "event_type")


@register("head_n", sql="SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(10)


def _dec_avg(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)


@register("sort_desc", sql=f"""
SELECT p_brand, avg_price, row_number() OVER (ORDER BY avg_price DESC, p_brand)::BIGINT AS rank FROM (
  SELECT p_brand, {RS('CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(p_retailprice)', 6)} AS avg_price
  FROM part GROUP BY 1)""")
def sort_desc(spark, d):
    p = Tables(spark, d).part
    g = p.groupBy("p_brand").agg(R(_dec_avg("p_retailprice"), 6).alias("avg_price"))
    return RK.sequential_id(g, [F.desc("avg_price"), F.asc("p_brand")], name="rank")


@register("sorted_dictionary", sql="""
SELECT row_number() OVER (ORDER BY name, p_partkey)::BIGINT AS pos, p_partkey, name FROM (
  SELECT p_partkey, replace(trim(p_name, ' ' || chr(9) || chr(10) || chr(13)), '_', ' ') AS name FROM part)""")
def sorted_dictionary(spark, d):
    p = Tables(spark, d).part.select("p_partkey", F.translate(T.strip_ws("p_name"), "_", " ").alias("name"))
    # the key breaks ties, so that a frequent name can be split over partitions
    return RK.sequential_id(p, ["name", "p_partkey"], name="pos")


@register("array_head", sql="""
SELECT l_orderkey, rn::BIGINT AS pos, p_name AS item FROM (
  SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rn <= 5""")
def array_head(spark, d):
    """Per order: item array ordered by line, first five (fewer if short),
    exploded with positions. The per-order array is bounded by lines/order."""
    t = Tables(spark, d)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    j = li.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    arr = j.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("items"))
    head = arr.select("l_orderkey", F.slice("items", 1, 5).alias("items"))
    return head.select("l_orderkey", F.posexplode("items").alias("pos", "it")).select(
        "l_orderkey", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("it.p_name").alias("item"))


@register("topk_per_row_floor", sql=f"""
WITH rev AS (
  SELECT n_name, p_type, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS r
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
share AS (SELECT n_name, p_type, CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY n_name) AS DOUBLE) AS s FROM rev),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY s DESC, p_type) AS rn FROM share)
SELECT n_name, rn::BIGINT AS rank, p_type, {RS('s * 100', 1)} AS pct FROM ranked WHERE rn <= 5 AND s >= 0.03""")
def topk_per_row_floor(spark, d):
    """Five highest shares per nation, floor 3 %, percent with 1 decimal.
    Aggregate first (partial agg), then rank the few types of each nation."""
    t = Tables(spark, d)
    j = (t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
         .join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
         .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
         .join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey"))
    rev = j.groupBy("n_name", "p_type").agg(F.sum(
        F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("r"))
    return RK.topk_share(rev, "n_name", "p_type", "r", k=5, floor=0.03)


@register("union_all_sources", sql="""
SELECT c_name AS name, c_nationkey AS nationkey, 'customer' AS source FROM customer
UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier""")
def union_all_sources(spark, d):
    t = Tables(spark, d)
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                          F.lit("customer").alias("source"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
                          F.lit("supplier").alias("source"))
    return a.unionByName(b)
