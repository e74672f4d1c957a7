"""JSON, map and markup operators, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER_JSON_DDL = ("key bigint, detail struct<status: string, "
                  "lines: array<struct<l_linenumber: int, l_partkey: bigint, l_quantity: double>>>")

# A pipe-table separator row: only pipes, dashes, colons and spaces.
PIPE_SEPARATOR = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"


def parse_json(df: DataFrame, col: str, ddl: str, out: str = "j") -> DataFrame:
    """JSON text → struct with a declared schema; malformed text → nulls
    (PERMISSIVE), so one bad record never fails the job."""
    return df.withColumn(out, F.from_json(F.col(col), ddl, {"mode": "PERMISSIVE"}))


def orders_as_json(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One JSON document per order with its lines nested (lines per order
    are bounded), orders without lines carry a null list."""
    lines = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    j = orders.select("o_orderkey", "o_orderstatus").join(
        lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")
    doc = F.struct(F.col("o_orderkey").alias("key"),
                   F.struct(F.col("o_orderstatus").alias("status"), F.col("lines")).alias("detail"))
    return j.select(F.to_json(doc).alias("json"))


def map_by_day(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Per key a map 'yyyy-MM-dd' → sorted values of that day."""
    per_day = df.groupBy(key, F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.array_sort(F.collect_list(value)).alias("vals"))
    return per_day.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("day", "vals"))).alias("by_day"))


def base64_text(c) -> Column:
    """UTF-8 text → base64 on one line (Spark wraps lines at 76 chars)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.base64(col.cast("binary")), "[\r\n]", "")


def nation_pipe_tables(nation: DataFrame, region: DataFrame) -> DataFrame:
    rows = (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy(F.col("r_name").alias("region"))
            .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r")))
    body = F.transform("r", lambda x: F.format_string("| %d | %s |", x["n_nationkey"], x["n_name"]))
    head = F.array(F.lit("| n_nationkey | n_name |"), F.lit("|---|---|"))
    return rows.select("region", F.array_join(F.concat(head, body), "\n").alias("md"))


def parse_pipe_table(df: DataFrame, key: str, col: str) -> DataFrame:
    """Pipe table text → (row, col, cell, is_header); separator rows skipped,
    outer pipes stripped, cells trimmed. Row 0 is the header."""
    lines = F.filter(F.split(F.col(col), "\n"), lambda l: ~l.rlike(PIPE_SEPARATOR) & (F.trim(l) != ""))
    rows = df.select(key, F.posexplode(lines).alias("row", "line"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = rows.select(key, "row", F.posexplode(F.split(inner, r"\|")).alias("col", "cell"))
    return cells.select(key, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                        F.trim("cell").alias("cell"), (F.col("row") == 0).alias("is_header"))
