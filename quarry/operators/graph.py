"""Breadth-first reachability over an edge table.

Each round joins the frontier to the edges on the source key, removes
already-visited nodes with an anti-join, and writes the new frontier to the
session's (shared) checkpoint folder, so the lineage stays one round deep and a
lost executor only replays one round. Edges and visited nodes lie bucketed by
node, so neither is exchanged again. The loop ends when the frontier is empty
(or the goal is reached).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, scratch_path


EDGES = 1 << 20  # at most, on average, in a bucket: what a task holds doesn't grow with the table
COMPACT_EVERY = 16  # rounds after which the visited pieces are merged into one checkpoint


def reachability(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst",
                 node: str = "node", goal=None, max_rounds: int | None = None) -> DataFrame:
    """All nodes reachable from ``seeds`` with the minimum number of hops:
    (node, hop). ``goal``: optional node value; the search stops after the
    round that reaches it. ``max_rounds`` is an optional safety bound for
    callers that want one (none by default: run to exhaustion).

    The visited set is kept as the list of frontiers (each written once),
    merged into a single table every few rounds, so no round rewrites
    everything found so far."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # Edges (by source) and found nodes are written bucketed by node: a round
    # exchanges its frontier only, and the files stay with the checkpoints.
    tables: list[str] = []
    edges = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES))

    def bucketed(df: DataFrame, by: str) -> tuple[DataFrame, str]:
        name = f"nodes_{uuid.uuid4().hex[:12]}"
        tables.append(name)
        path = scratch_path(spark, name)
        df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
        return spark.table(name), path

    try:
        e, _ = bucketed(edges.repartition(buckets, "_s", "_d").distinct(), "_s")
        frontier, path = bucketed(seeds.select(F.col(node).alias(node)).distinct().withColumn("hop", F.lit(0)), node)
        pieces, paths, hop = [frontier], [path], 0
        while max_rounds is None or hop < max_rounds:
            if goal is not None and not frontier.filter(F.col(node) == F.lit(goal)).isEmpty():
                break
            hop += 1
            nxt = frontier.join(e, frontier[node] == e["_s"]).select(F.col("_d").alias(node)).distinct()
            for seen in pieces:
                nxt = nxt.join(seen.select(node), node, "left_anti")
            frontier, path = bucketed(nxt.withColumn("hop", F.lit(hop)), node)
            if frontier.isEmpty():
                break
            pieces.append(frontier)
            paths.append(path)
            if len(pieces) >= COMPACT_EVERY:
                whole, path = bucketed(reduce(lambda a, b: a.unionByName(b), pieces), node)
                pieces, paths = [whole], [path]
        return spark.read.schema(frontier.schema).parquet(*paths)
    finally:
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, component) of every node in ``edges`` (a, b), the component being
    the least node reachable, and the rounds it took.

    Alternating stars: the larger neighbours of a node, then the smaller ones,
    are hung below its least neighbour, until nothing moves; a chain of n nodes
    takes about log n rounds. Each round is written to the checkpoint folder; a
    node of many neighbours is only ever joined with one row."""
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    e = kept(edges.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen, rounds = None, 0
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()), rounds
        seen, rounds = mark, rounds + 1
        ways = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = ways.filter(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("m").alias("a"), F.col("v").alias("b")).distinct().filter(F.col("a") != F.col("b"))
        least = up.groupBy("b").agg(F.min("a").alias("m"))
        down = up.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        e = kept(down.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
