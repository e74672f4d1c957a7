"""Graph reachability job on the supplier–part graph of
`lineitem` (every line, both directions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.graph import reachability
from quarry.plans.catalog import register
from quarry.sources.tables import Tables

SEEDS = (0, 1, 2)  # supplier keys the search starts from
ORACLE_DEPTH = 64  # recursion bound of the SQL oracle only (far above the graph depth)


def supplier_part_edges(t):
    """Node ids: supplier s → 2·s, part p → 2·p + 1; both directions of every line (the search drops repeats)."""
    pairs = t.lineitem.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")))


@register("graph_reachability", sql=f"""
WITH RECURSIVE
pairs AS (SELECT DISTINCT l_suppkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem),
edges AS (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs),
bfs(node, hop) AS (
  SELECT (s * 2)::BIGINT, 0 FROM (VALUES {', '.join(f'({s})' for s in SEEDS)}) AS seeds(s)
  UNION
  SELECT e.dst, bfs.hop + 1 FROM bfs JOIN edges e ON e.src = bfs.node WHERE bfs.hop < {ORACLE_DEPTH})
SELECT node, min(hop)::INTEGER AS hop FROM bfs GROUP BY node""")
def graph_reachability(spark, d):
    t = Tables(spark, d)
    seeds = spark.createDataFrame([(s * 2,) for s in SEEDS], "node bigint")
    return reachability(supplier_part_edges(t), seeds).select("node", F.col("hop").cast("int").alias("hop"))
