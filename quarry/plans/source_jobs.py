"""Scans and sinks: every job writes the benchmark table it
reads to a fresh folder under the session's checkpoint folder and reads
it back through the source under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.session import scratch_path
from quarry.sources import files as FS
from quarry.sources.tables import Tables

CUSTOMER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"

@register("scan_csv", sql="SELECT * FROM customer")
def scan_csv(spark, d):
    path = FS.write_csv(Tables(spark, d).customer, scratch_path(spark, "customer-csv"))
    return FS.read_csv(spark, path, CUSTOMER_DDL)


@register("scan_csv_positional", sql="SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def scan_csv_positional(spark, d):
    path = FS.write_csv(Tables(spark, d).nation, scratch_path(spark, "nation-csv"))
    return FS.read_csv_positional(spark, path, "key int, name string, region int")


ORDERS_NOSTATUS_DDL = ("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz, "
                       "o_orderpriority string")


@register("scan_recursive_union", sql="""
SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus AS status FROM orders""")
def scan_recursive_union(spark, d):
    """orders land as CSV in nested per-status folders plus one junk file;
    the recursive scan stacks them all, sets the junk rows apart, and
    recovers the status from each file's path."""
    root = scratch_path(spark, "orders-tree")
    FS.write_csv(Tables(spark, d).orders, root, partition_by=["o_orderstatus"])
    junk = spark.createDataFrame([("not-a-key", "x", "y", "z", "w")], "a string, b string, c string, d string, e string")
    junk.coalesce(1).write.mode("append").option("header", True).csv(f"{root}/o_orderstatus=JUNK/deeper")
    df, _rejects = FS.read_csv_tree(spark, root, ORDERS_NOSTATUS_DDL)
    return df.select("o_orderkey", "o_totalprice", "o_orderdate",
                     F.regexp_extract("_path", r"o_orderstatus=([^/]+)/", 1).alias("status"))


@register("scan_probe", sql="""
SELECT doc_id, lang, n_chars, (SELECT arg_min(source, doc_id) FROM documents WHERE source IS NOT NULL) AS first_source
FROM documents ORDER BY doc_id LIMIT 3""")
def scan_probe(spark, d):
    """First rows plus the first non-null sample of a column (by key)."""
    docs = Tables(spark, d).documents
    sample = docs.filter(F.col("source").isNotNull()).agg(F.min_by("source", "doc_id")).first()[0]
    return docs.orderBy("doc_id").limit(3).select("doc_id", "lang", "n_chars", F.lit(sample).alias("first_source"))


@register("materialize_or_reuse", sql=f"SELECT doc_id, {S.clean_text('text')} AS text FROM documents")
def materialize_or_reuse(spark, d):
    """First call builds and stores the cleaned table, second call finds a
    valid stored copy and reuses it."""
    path = scratch_path(spark, "clean-docs")
    build = lambda: Tables(spark, d).documents.select("doc_id", T.clean_text("text").alias("text"))
    check = lambda df: FS.default_sample_valid(df, "text")
    FS.materialize_or_reuse(spark, path, build, check)
    return FS.materialize_or_reuse(spark, path, build, check)


DOCS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@register("sink_csv", sql="""
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' || text || chr(9) WHEN 1 THEN '"' || text || '",' WHEN 2 THEN ''
       WHEN 3 THEN NULL ELSE text END AS text, lang, source, n_chars FROM documents""")
def sink_csv(spark, d):
    """Whole texts with blanks at the ends, quotes, line ends, empty and null
    cells come back unchanged."""
    k = F.col("doc_id") % 5
    text = (F.when(k == 0, F.concat(F.lit("  "), "text", F.lit("\t"))).when(k == 1, F.concat(F.lit('"'), "text", F.lit('",')))
            .when(k == 2, F.lit("")).when(k == 3, F.lit(None)).otherwise(F.col("text")))
    path = FS.write_csv(Tables(spark, d).documents.withColumn("text", text), scratch_path(spark, "documents-csv"))
    return FS.read_csv(spark, path, DOCS_DDL)


@register("sink_vectors", sql="SELECT vec_id, embedding FROM embeddings")
def sink_vectors(spark, d):
    path = FS.write_vectors(Tables(spark, d).embeddings.select("vec_id", "embedding"),
                            scratch_path(spark, "vectors"))
    return spark.read.parquet(path)
