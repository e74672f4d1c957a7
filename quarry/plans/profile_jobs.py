"""Projection, predicate, profiling, aggregate and metric jobs
(SURVEY §2.2, §2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.common import is_test, split_bucket_sql
from quarry.operators import metrics as M
from quarry.operators import profile as P
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.sources.tables import Tables

R = T.round_half_up
RS = S.round_half_up

# ---------------------------------------------------------------- §2.2

_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@register("table_shape", sql=f"SELECT count(*) AS n_rows, {len(_LI_COLS)} AS n_cols, "
                             f"'{','.join(_LI_COLS)}' AS columns FROM lineitem")
def table_shape(spark, d):
    li = Tables(spark, d).lineitem
    return li.agg(F.count("*").alias("n_rows")).select(
        "n_rows", F.lit(len(li.columns)).alias("n_cols"), F.lit(",".join(li.columns)).alias("columns"))


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("table_info", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, '{t}' AS dtype, count({c}) AS non_null FROM orders" for c, t in _ORDER_TYPES))
def table_info(spark, d):
    return P.table_info(Tables(spark, d).orders)


@register("select_except", sql="SELECT * EXCLUDE (p_retailprice) FROM part")
def select_except(spark, d):
    return Tables(spark, d).part.drop("p_retailprice")


FEATURES = ["p_size", "p_brand", "p_partkey"]


def select_features(df, cols):
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df.select(*cols)


@register("select_feature_list", sql=f"SELECT {', '.join(FEATURES)} FROM part")
def select_feature_list(spark, d):
    return select_features(Tables(spark, d).part, FEATURES)


_ITEMS = ", ".join(f"Item_{k}" for k in range(1, FX.WIDE_SLOTS + 1))


@register("select_by_prefix", sql=f"SELECT l_orderkey, sheet, {_ITEMS} FROM ({FX.WIDE_ITEMS_SQL}) w "
                                  "JOIN orders ON o_orderkey = l_orderkey")
def select_by_prefix(spark, d):
    t = Tables(spark, d)
    wide = FX.wide_items(t).join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    return wide.select("l_orderkey", "sheet", *[c for c in wide.columns if c.startswith("Item_")])


@register("drop_null_rows", sql=f"SELECT * FROM ({FX.NULL_PART_SQL}) WHERE p_brand IS NOT NULL AND p_size IS NOT NULL")
def drop_null_rows(spark, d):
    return FX.null_part(Tables(spark, d)).na.drop("any")


def _blanked_docs(t):
    c = F.col("doc_id") % 10
    return t.documents.select("doc_id", "n_chars", F.when(c == 0, F.lit(None))
                              .when(c == 1, F.lit(" \n \t")).otherwise(F.col("text")).alias("text"))


_BLANKED_SQL = ("SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 "
                "THEN ' \n \t' ELSE text END AS text FROM documents")


@register("filter_blank_text", sql=f"SELECT doc_id, n_chars FROM ({_BLANKED_SQL}) "
                                   f"WHERE text IS NOT NULL AND {S.strip_ws('text')} <> ''")
def filter_blank_text(spark, d):
    docs = _blanked_docs(Tables(spark, d))
    return docs.filter(F.col("text").isNotNull() & (T.strip_ws("text") != "")).select("doc_id", "n_chars")


def validate_requests(df, text_col="text"):
    """status/error per request: empty, too short (< 3 chars), nothing left
    after cleaning; accepted otherwise."""
    raw = T.strip_ws(text_col)
    cleaned = T.preprocess_tokens(T.synonym_rewrite(F.lower(raw)))
    err = (F.when(F.col(text_col).isNull() | (raw == ""), F.lit("empty"))
           .when(F.length(raw) < 3, F.lit("too_short"))
           .when(F.size(cleaned) == 0, F.lit("no_content")))
    return df.withColumn("error", err).withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")))


def _syn_sql(e):
    for a, b in T.SYNONYMS:
        e = f"replace({e}, {S.q(a)}, {S.q(b)})"
    return e


@register("validate_requests", sql=f"""
SELECT conv_id, turn, role,
  CASE WHEN text IS NULL OR {S.strip_ws('text')} = '' THEN 'empty'
       WHEN length({S.strip_ws('text')}) < 3 THEN 'too_short'
       WHEN len({S.preprocess_tokens(_syn_sql('lower(' + S.strip_ws('text') + ')'))}) = 0 THEN 'no_content'
  END AS error,
  CASE WHEN text IS NULL OR {S.strip_ws('text')} = '' OR length({S.strip_ws('text')}) < 3
         OR len({S.preprocess_tokens(_syn_sql('lower(' + S.strip_ws('text') + ')'))}) = 0
       THEN 'rejected' ELSE 'accepted' END AS status
FROM conversations""")
def q_validate_requests(spark, d):
    return validate_requests(Tables(spark, d).conversations.select("conv_id", "turn", "role", "text")).drop("text")


@register("coalesce_defaults", sql="""
SELECT o_orderkey, coalesce(c_name, 'unknown') AS c_name, coalesce(c_acctbal, 0.0) AS c_acctbal,
       coalesce(c_mktsegment, 'NONE') AS c_mktsegment
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey""")
def coalesce_defaults(spark, d):
    t = Tables(spark, d)
    cust = t.customer.filter(F.col("c_custkey") % 3 != 0)
    j = t.orders.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("c_name"),
                    F.coalesce("c_acctbal", F.lit(0.0)).alias("c_acctbal"),
                    F.coalesce("c_mktsegment", F.lit("NONE")).alias("c_mktsegment"))


def falsy_default(c, default):
    """JS ``parseFloat(x) || d``: null, NaN and 0 all take the default."""
    return F.coalesce(F.nullif(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(default))


@register("falsy_default", sql="""
SELECT l_orderkey, l_linenumber, l_discount,
       CASE WHEN l_discount IS NULL OR isnan(l_discount) OR l_discount = 0 THEN 0.05 ELSE l_discount END AS discount
FROM lineitem""")
def q_falsy_default(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_discount", falsy_default("l_discount", 0.05).alias("discount"))


def _band_sql(e):
    parts = " ".join(f"WHEN {e} >= {lo} THEN {S.q(n)}" for lo, n, _ in T.SEVERITY_BANDS)
    cols = " ".join(f"WHEN {e} >= {lo} THEN {S.q(c)}" for lo, _, c in T.SEVERITY_BANDS)
    return (f"CASE {parts} ELSE {S.q(T.SEVERITY_DEFAULT[0])} END AS band, "
            f"CASE {cols} ELSE {S.q(T.SEVERITY_DEFAULT[1])} END AS colour")


@register("band_label", sql=f"SELECT p_partkey, p_size, {_band_sql('p_size')} FROM part")
def band_label(spark, d):
    p = Tables(spark, d).part.select("p_partkey", "p_size", T.band_label("p_size").alias("b"))
    return p.select("p_partkey", "p_size", F.col("b.label").alias("band"), F.col("b.colour").alias("colour"))


@register("sign_label", sql="""
SELECT c_custkey, CASE WHEN c_acctbal - 1000 > 0 THEN 'Positive' WHEN c_acctbal - 1000 < 0 THEN 'Negative'
       ELSE 'Neutral' END AS label FROM customer""")
def sign_label(spark, d):
    c = Tables(spark, d).customer
    return c.select("c_custkey", T.sign_label(F.col("c_acctbal") - 1000).alias("label"))


# own precedence list for the substring classifier: (needle, class)
NAME_CLASSES = (("red", "colour"), ("blue", "colour"), ("hot", "temperature"),
                ("cold", "temperature"), ("large", "size"), ("small", "size"), ("o", "has_o"))


def substring_class(c, classes=NAME_CLASSES, default="other"):
    s = F.lower(F.col(c))
    expr = F.when(s.contains(classes[0][0]), F.lit(classes[0][1]))
    for needle, cls in classes[1:]:
        expr = expr.when(s.contains(needle), F.lit(cls))
    return expr.otherwise(F.lit(default))


@register("substring_class", sql="SELECT p_partkey, CASE " + " ".join(
    f"WHEN contains(lower(p_name), {S.q(n)}) THEN {S.q(c)}" for n, c in NAME_CLASSES) + " ELSE 'other' END AS class FROM part")
def q_substring_class(spark, d):
    return Tables(spark, d).part.select("p_partkey", substring_class("p_name").alias("class"))


@register("flag_badge", sql="""
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Clean' END AS badge,
       CASE WHEN toxic = 1 THEN '#c0392b' ELSE '#27ae60' END AS colour FROM labels""")
def flag_badge(spark, d):
    lab = Tables(spark, d).labels
    flag = F.col("toxic") == 1
    return lab.select("doc_id", F.when(flag, F.lit("Toxic")).otherwise(F.lit("Clean")).alias("badge"),
                      F.when(flag, F.lit("#c0392b")).otherwise(F.lit("#27ae60")).alias("colour"))


@register("media_dispatch", sql="""
SELECT event_id, CASE event_type
  WHEN 'click' THEN '<a data-v="' || CAST(value AS VARCHAR) || '">click</a>'
  WHEN 'view' THEN '<img alt="view ' || CAST(user_id AS VARCHAR) || '">'
  WHEN 'purchase' THEN '<b>' || CAST(value AS VARCHAR) || '</b>'
  ELSE '<span>' || event_type || '</span>' END AS rendered FROM events""")
def media_dispatch(spark, d):
    e = Tables(spark, d).events
    et, v = F.col("event_type"), F.col("value").cast("string")
    out = (F.when(et == "click", F.concat(F.lit('<a data-v="'), v, F.lit('">click</a>')))
           .when(et == "view", F.concat(F.lit('<img alt="view '), F.col("user_id").cast("string"), F.lit('">')))
           .when(et == "purchase", F.concat(F.lit("<b>"), v, F.lit("</b>")))
           .otherwise(F.concat(F.lit("<span>"), et, F.lit("</span>"))))
    return e.select("event_id", out.alias("rendered"))


@register("safe_cast", sql="""
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
       TRY_CAST(o_orderpriority AS INTEGER) AS prio_whole,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_num FROM orders""")
def safe_cast(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("prio"),
                    F.col("o_orderpriority").try_cast("int").alias("prio_whole"),
                    F.col("o_orderstatus").try_cast("double").alias("status_num"))


@register("record_project", sql="SELECT page_id AS id, url AS link, length(html)::INTEGER AS html_len FROM pages")
def record_project(spark, d):
    p = Tables(spark, d).pages
    return p.select(F.col("page_id").alias("id"), F.col("url").alias("link"), F.length("html").alias("html_len"))


# ---------------------------------------------------------------- §2.4

@register("null_counts", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM ({FX.NULL_PART_SQL})"
    for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def q_null_counts(spark, d):
    return P.null_counts(FX.null_part(Tables(spark, d)))


def _dec_avg(c):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double") / F.count(c)


def _dec_avg_sql(c):
    return f"(CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / count({c}))"


@register("target_summary", sql=f"SELECT {RS(_dec_avg_sql('o_totalprice'), 6)} AS mean, "
                                "min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def target_summary(spark, d):
    o = Tables(spark, d).orders
    return o.agg(R(_dec_avg("o_totalprice"), 6).alias("mean"), F.min("o_totalprice").alias("min"),
                 F.max("o_totalprice").alias("max"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QS = [0.25, 0.5, 0.75]


def describe_numeric(df, cols):
    # one wide pass for all columns, turned to long form afterwards
    row = df.agg(*[F.struct(
        F.count(c).alias("count"),
        R(F.sum(F.col(c).cast("double").cast("decimal(18,2)")).cast("double") / F.count(c), 6).alias("mean"),
        R(F.stddev_samp(F.col(c).cast("double")), 5).alias("std"),
        F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in cols])
    per = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}.{f}").alias(f) for f in ("count", "mean", "std", "min", "max")])
           for c in cols]
    stats = row.select(F.explode(F.array(*per)).alias("s")).select("s.*").filter(F.col("count") > 0)
    q = P.exact_quantiles(df, cols, QS).groupBy("column").pivot("q", QS).agg(F.first("value"))
    q = q.select("column", *[R(F.col(f"`{x}`"), 6).alias(f"p{int(x * 100)}") for x in QS])
    return stats.join(q, "column")


@register("describe_numeric", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, count({c}) AS count, {RS(_dec_avg_sql(c), 6)} AS mean, "
    f"{RS(f'stddev_samp({c})', 5)} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
    + ", ".join(f"{RS(f'quantile_cont({c}, {x})', 6)} AS p{int(x * 100)}" for x in QS)
    + " FROM lineitem" for c in NUMERIC))
def q_describe_numeric(spark, d):
    return describe_numeric(Tables(spark, d).lineitem, NUMERIC)


@register("value_counts", sql="SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus")


FLAGS = ["l_returnflag", "l_linestatus"]


@register("distinct_values", sql=" UNION ALL ".join(
    f"SELECT '{c}' AS column, list_sort(list(DISTINCT {c})) AS values FROM lineitem" for c in FLAGS))
def distinct_values(spark, d):
    """Sorted distinct values per (low-cardinality flag) column: distinct
    first (partial agg), then a per-column list of the few survivors."""
    li = Tables(spark, d).lineitem
    long = P.unpivot_columns(li, [], FLAGS, val="v").filter(F.col("v").isNotNull()).distinct()
    return long.groupBy("column").agg(F.array_sort(F.collect_list("v")).alias("values"))


@register("distinct_count", sql="SELECT count(DISTINCT p_brand) AS n_distinct FROM part")
def distinct_count(spark, d):
    return Tables(spark, d).part.agg(F.count_distinct("p_brand").alias("n_distinct"))


@register("crosstab_pivot", sql="""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS "F",
       count(*) FILTER (WHERE l_linestatus = 'O') AS "O" FROM lineitem GROUP BY 1""")
def crosstab_pivot(spark, d):
    return P.crosstab(Tables(spark, d).lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


def _hist_sql(table, col, n):
    return f"""SELECT '{col}' AS column, b AS bin, {RS(f'lo + b * (hi - lo) / {n}', 6)} AS edge_lo,
       {RS(f'lo + (b + 1) * (hi - lo) / {n}', 6)} AS edge_hi, coalesce(cnt, 0)::BIGINT AS n
FROM (SELECT range::INTEGER AS b FROM range({n})) bins
CROSS JOIN (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {table}) mm
LEFT JOIN (SELECT least(floor(({col} - lo) / (hi - lo) * {n})::INTEGER, {n - 1}) AS bb, count(*) AS cnt
           FROM {table}, (SELECT min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi FROM {table}) m2
           WHERE {col} IS NOT NULL GROUP BY 1) h ON h.bb = b"""


@register("histogram_bins", sql=_hist_sql("part", "p_retailprice", 50) + " UNION ALL "
          + _hist_sql("orders", "o_totalprice", 30))
def q_histogram_bins(spark, d):
    t = Tables(spark, d)
    a = P.histogram_bins(t.part, "p_retailprice", 50).withColumn("column", F.lit("p_retailprice"))
    b = P.histogram_bins(t.orders, "o_totalprice", 30).withColumn("column", F.lit("o_totalprice"))
    return a.unionByName(b).select("column", "bin", R("edge_lo", 6).alias("edge_lo"),
                                   R("edge_hi", 6).alias("edge_hi"), "n")


@register("correlation_matrix", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {RS(f'corr({a}, {b})', 6)} AS corr FROM lineitem"
    for a in NUMERIC for b in NUMERIC))
def q_correlation_matrix(spark, d):
    c = P.correlation_matrix(Tables(spark, d).lineitem, NUMERIC)
    return c.select("col_a", "col_b", R("corr", 6).alias("corr"))


def order_severity(t):
    """rowwise_lookup_sum: unpivot the Item_ slots, look up each name's
    weight (missing → 0) and sum per order – one join, not one per slot."""
    wide = FX.wide_items(t)
    slots = [c for c in wide.columns if c.startswith("Item_")]
    long = wide.unpivot(["l_orderkey", "sheet"], slots, "slot", "name")
    lk = FX.size_lookup(t)
    return (long.join(lk, "name", "left")
            .groupBy("l_orderkey")
            .agg(F.sum(F.coalesce("weight", F.lit(0))).cast("bigint").alias("severity")))


_SEV_SQL = f"""
SELECT l_orderkey, sum(coalesce(weight, 0))::BIGINT AS severity
FROM (UNPIVOT ({FX.WIDE_ITEMS_SQL}) ON {_ITEMS} INTO NAME slot VALUE name) u
LEFT JOIN ({FX.SIZE_LOOKUP_SQL}) lk USING (name) GROUP BY l_orderkey"""


@register("rowwise_lookup_sum", sql=_SEV_SQL)
def rowwise_lookup_sum(spark, d):
    return order_severity(Tables(spark, d))


@register("group_mean", sql=f"""
SELECT o_orderpriority, {RS('avg(severity)', 6)} AS mean_severity
FROM ({_SEV_SQL}) s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def group_mean(spark, d):
    t = Tables(spark, d)
    s = order_severity(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"),
                               "l_orderkey")
    return s.groupBy("o_orderpriority").agg(R(F.avg("severity"), 6).alias("mean_severity"))


ALERT_THRESHOLD = 3


@register("threshold_alert", sql=f"""
WITH k AS (SELECT user_id, d::DATE AS day FROM (SELECT DISTINCT user_id FROM events),
  (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events)),
c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS n FROM events GROUP BY ALL)
SELECT user_id, day, coalesce(n, 0) AS n_errors, coalesce(n, 0) >= {ALERT_THRESHOLD} AS is_alert, {ALERT_THRESHOLD} AS threshold,
       CASE WHEN n >= {ALERT_THRESHOLD} THEN 'ALERT: ' || CAST(n AS VARCHAR) || ' errors for user '
                 || CAST(user_id AS VARCHAR) || ' on ' || strftime(day, '%Y-%m-%d') ELSE 'ok' END AS message
FROM k LEFT JOIN c USING (user_id, day)""")
def threshold_alert(spark, d):
    """Count detections per key of a key table (every user on every day of the
    period): keys without any event get a count of zero."""
    e = Tables(spark, d).events
    first, last = e.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    days = F.sequence(F.lit(first), F.lit(last)) if first else F.array().cast("array<date>")
    keys = e.select("user_id").distinct().select("user_id", F.explode(days).alias("day"))
    counts = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "error").alias("n"))
    g = keys.join(counts, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n_errors"))
    alert = F.col("n_errors") >= ALERT_THRESHOLD
    return g.select("user_id", "day", "n_errors", alert.alias("is_alert"),
                    F.lit(ALERT_THRESHOLD).alias("threshold"),
                    F.when(alert, F.format_string("ALERT: %d errors for user %d on %s", "n_errors", "user_id",
                                                  F.date_format("day", "yyyy-MM-dd"))).otherwise(F.lit("ok")).alias("message"))


@register("flag_totals", sql="SELECT count(*) AS total, count(*) FILTER (WHERE toxic = 1) AS flagged, "
                             "count(*) FILTER (WHERE quality = 1) AS good FROM labels")
def flag_totals(spark, d):
    lab = Tables(spark, d).labels
    return lab.agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("flagged"),
                   F.count_if(F.col("quality") == 1).alias("good"))


@register("argmax_first", sql=f"""
SELECT c_mktsegment AS best_segment, score FROM (
  SELECT c_mktsegment, {RS(_dec_avg_sql('c_acctbal'), 6)} AS score FROM customer GROUP BY 1)
ORDER BY score DESC, c_mktsegment ASC LIMIT 1""")
def argmax_first(spark, d):
    """Best entry with first-wins ties: order by (score desc, ordinal asc)
    and take one — a TakeOrderedAndProject (per-partition top-1, then merge),
    never a full sort."""
    c = Tables(spark, d).customer
    seg = c.groupBy("c_mktsegment").agg(R(_dec_avg("c_acctbal"), 6).alias("score"))
    best = seg.orderBy(F.desc("score"), F.asc("c_mktsegment")).limit(1)
    return best.select(F.col("c_mktsegment").alias("best_segment"), "score")


@register("regression_error", sql=f"""
WITH train AS (SELECT * FROM part WHERE {split_bucket_sql('p_partkey')} >= 20),
     test AS (SELECT * FROM part WHERE {split_bucket_sql('p_partkey')} < 20),
     model AS (SELECT p_brand, {_dec_avg_sql('p_retailprice')} AS pred FROM train GROUP BY 1),
     gm AS (SELECT {_dec_avg_sql('p_retailprice')} AS g FROM train),
     scored AS (SELECT p_retailprice AS y, coalesce(pred, g) AS p FROM test LEFT JOIN model USING (p_brand), gm)
SELECT count(*) AS n, {RS('avg(abs(y - p))', 6)} AS mae, {RS(_dec_avg_sql('y'), 6)} AS mean_target,
       {RS('100.0 * avg(abs(y - p)) / avg(y)', 4)} AS mae_pct FROM scored""")
def regression_error(spark, d):
    """Group-mean predictor fitted on the train split, scored on the test
    split: MAE, target mean, MAE as % of the mean — one aggregate."""
    p = Tables(spark, d).part
    train, test = p.filter(~is_test("p_partkey")), p.filter(is_test("p_partkey"))
    model = train.groupBy("p_brand").agg(_dec_avg("p_retailprice").alias("pred"))
    g = train.agg(_dec_avg("p_retailprice")).first()[0]  # one number
    scored = (test.join(model, "p_brand", "left")
              .select(F.col("p_retailprice").alias("y"), F.coalesce("pred", F.lit(g)).alias("p")))
    err = F.abs(F.col("y") - F.col("p"))
    return scored.agg(F.count("*").alias("n"), R(F.avg(err), 6).alias("mae"),
                      R(_dec_avg("y"), 6).alias("mean_target"),
                      R(100.0 * F.avg(err) / F.avg("y"), 4).alias("mae_pct"))


@register("accuracy", sql=f"SELECT count(*) AS n, {RS('avg((actual = predicted)::DOUBLE)', 6)} AS accuracy "
                          f"FROM ({FX.PREDICTED_LABELS_SQL})")
def q_accuracy(spark, d):
    a = M.accuracy(FX.predicted_labels(Tables(spark, d)))
    return a.select("n", R("accuracy", 6).alias("accuracy"))


_CM_SQL = f"""
WITH pl AS ({FX.PREDICTED_LABELS_SQL}),
     cls AS (SELECT actual AS c FROM pl UNION SELECT predicted FROM pl)
SELECT a.c AS actual, p.c AS predicted, count(pl.doc_id) AS n
FROM cls a CROSS JOIN cls p LEFT JOIN pl ON pl.actual = a.c AND pl.predicted = p.c GROUP BY 1, 2"""


@register("confusion_matrix", sql=_CM_SQL)
def q_confusion_matrix(spark, d):
    return M.confusion_matrix(FX.predicted_labels(Tables(spark, d)))


@register("classification_report", sql=f"""
WITH cm AS ({_CM_SQL}),
per AS (SELECT actual AS c, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, sum(n) AS support
        FROM cm GROUP BY 1),
pt AS (SELECT predicted AS c, sum(n) AS npred FROM cm GROUP BY 1),
r0 AS (SELECT c, tp, support, coalesce(CASE WHEN npred = 0 THEN NULL ELSE tp::DOUBLE / npred END, 0.0) AS precision,
              coalesce(CASE WHEN support = 0 THEN NULL ELSE tp::DOUBLE / support END, 0.0) AS recall
       FROM per JOIN pt USING (c)),
r AS (SELECT *, coalesce(CASE WHEN precision + recall = 0 THEN NULL ELSE 2 * precision * recall / (precision + recall) END, 0.0) AS f1 FROM r0),
tot AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
               sum(f1 * support) / sum(support) AS wf FROM r),
u AS (
  SELECT CAST(c AS VARCHAR) AS label, precision, recall, f1, support::BIGINT AS support FROM r
  UNION ALL SELECT 'accuracy', tp / n, tp / n, tp / n, n::BIGINT FROM tot
  UNION ALL SELECT 'macro avg', mp, mr, mf, n::BIGINT FROM tot
  UNION ALL SELECT 'weighted avg', wp, wr, wf, n::BIGINT FROM tot)
SELECT label, {RS('precision', 6)} AS precision, {RS('recall', 6)} AS recall, {RS('f1', 6)} AS f1, support FROM u""")
def q_classification_report(spark, d):
    r = M.classification_report(FX.predicted_labels(Tables(spark, d)))
    return r.select("label", R("precision", 6).alias("precision"), R("recall", 6).alias("recall"),
                    R("f1", 6).alias("f1"), "support")
