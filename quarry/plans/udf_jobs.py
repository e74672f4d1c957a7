"""UDF / UDAF / UDTF twins, each with the oracle of its
native counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import udfs as U
from quarry.operators import raster as RA
from quarry.operators import semistructured as SS
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import REGISTRY, register
from quarry.plans.raster_jobs import W, _OTSU_SQL, gray
from quarry.sources.tables import Tables


@register("udf_scalar_pandas", sql=f"SELECT doc_id, {S.clean_text('text')} AS text FROM documents")
def udf_scalar_pandas(spark, d):
    docs = Tables(spark, d).documents
    return docs.select("doc_id", U.clean_text_pandas("text").alias("text"))


@register("udaf_grouped", sql=W(f", {_OTSU_SQL} SELECT img, t FROM th"))
def udaf_grouped(spark, d):
    """Otsu threshold per image through a grouped-aggregate pandas UDF over
    the per-image histogram (partial-aggregated first, so a group is at most
    256 rows whatever the image size)."""
    h = RA.histogram(gray(Tables(spark, d)))
    return h.groupBy("img").agg(U.otsu_from_histogram("v", "n").alias("t"))


@register("udtf_table_rows", sql=REGISTRY["markup_table_rows"].sql)
def udtf_table_rows(spark, d):
    t = Tables(spark, d)
    texts = SS.nation_pipe_tables(t.nation, t.region)
    name = f"pipe_tables_{uuid.uuid4().hex[:8]}"
    texts.createOrReplaceTempView(name)
    spark.udtf.register("pipe_table_rows", U.pipe_table_rows_udtf())
    return spark.sql(f"SELECT p.region, r.row, r.col, r.cell, r.is_header FROM {name} p, "
                     "LATERAL pipe_table_rows(p.md) r")
