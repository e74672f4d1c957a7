"""Exact nearest-neighbour search over a metric index.

Base vectors are put into cells by their nearest pivot; a cell is cut into
blocks by distance from the pivot, and a block keeps the least and greatest of
these distances. The triangle inequality then bounds the distance between a
query and everything in a block from below by two numbers, so a query first
searches the blocks around its own place, which gives an upper bound of its
k-th distance, and then only those other blocks that may hold something
nearer. Blocks that lie near each other travel in bundles: a query goes to a
bundle once, with the list of the blocks it visits there, and brings back k
candidates, so that what is exchanged grows with the bundles and not with the
blocks. A cogroup task has a bounded number of queries and one bundle, scored
with numpy; candidates are ranked with a window limited to k rows. What is broadcast (pivots and block bounds) has at
most ``MAX_PIVOTS`` and ``MAX_BLOCKS`` rows, whatever the size of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import round_half_up
from quarry.session import scratch_path

QUERY_BLOCK_ROWS = 2048  # queries of a bundle's task: from this
QUERY_BLOCK_MOST = 1 << 14  # to this many, as the tasks suffice for the cores
BASE_BLOCK_ROWS = 4096
MAX_PIVOTS = 512
MAX_BLOCKS = 1 << 15
BUNDLE_BLOCKS = 8  # full blocks of a bundle
CELLS_PER_BLOCK = 8  # cells that a full block's rows would make

TIE_SCALE = 1e9
SLACK = 1e-6  # distances are computed in doubles and compared at 1e-9
CANDIDATE_SCHEMA = "qid bigint, id bigint, dist double"


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b (by the product, so good to about 1e-12 of the norms)."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Blocks:
    """What is known of each block, in the order of their numbers."""

    pivots: np.ndarray
    cell: np.ndarray  # the pivot of each block
    size: np.ndarray
    low: np.ndarray  # distances from the pivot
    high: np.ndarray
    bundle: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and block, the least and the greatest distance possible."""
        d = np.sqrt(_squared(q, self.pivots))[:, self.cell]
        return np.maximum(0, np.maximum(d - self.high, self.low - d)), d + self.high


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # id, vec, block, bundle
    blocks: Blocks


def _chain(pivots: np.ndarray) -> np.ndarray:
    """Each pivot's place in a chain from neighbour to neighbour."""
    far, at = _squared(pivots, pivots), 0
    place = np.full(len(pivots), -1)
    for k in range(len(pivots)):
        place[at] = k
        at = int(np.where(place < 0, far[at], np.inf).argmin())
    return place


def build_index(base: DataFrame, block_rows: int = BASE_BLOCK_ROWS) -> Index:
    """An index of ``base`` (id, vec). Pivots are the rows with the least hashes of their ids, so
    a bounded sample; every row is indexed. Cells of more than a block are cut at quantiles of
    the distance from the pivot, what is still too large (equal distances) by a hash of the id."""
    import pyarrow as pa

    spark = base.sparkSession
    n = base.count()
    n_pivots = min(MAX_PIVOTS, max(1, n * CELLS_PER_BLOCK // block_rows))
    picked = base.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    wide = len(picked[0].vec) if picked else 1
    pivots = np.unique(np.array([r.vec for r in picked], dtype=np.float64).reshape(len(picked), wide), axis=0)

    def place(batches):
        for b in batches:
            ids, vecs = (b.column(b.schema.get_field_index(c)) for c in ("id", "vec"))
            x = _matrix(vecs)
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for at in range(0, len(x), 1024):
                part = x[at: at + 1024]
                cell[at: at + 1024] = c = _squared(part, pivots).argmin(1)
                far[at: at + 1024] = np.sqrt(((part - pivots[c]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([ids, vecs, pa.array(cell), pa.array(far)], names=["id", "vec", "cell", "far"])

    vec_type = base.schema["vec"].dataType.simpleString()
    path = scratch_path(spark, "cells")
    base.select("id", "vec").mapInArrow(place, f"id bigint, vec {vec_type}, cell int, far double").write.parquet(path)
    placed = spark.read.parquet(path)
    rows = max(block_rows, -(-2 * n // (MAX_BLOCKS - MAX_PIVOTS)))  # blocks of a cell: its share, rounded up
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx(
        "far", [k / 16 for k in range(1, 16)], 1000).alias("cuts"))
    # a large cell has rings at (some of) its sixteenths, and as many salts as its rings are still too large
    rings = F.least(F.lit(16), F.greatest(F.lit(1), F.ceil(F.col("n") / rows))).cast("int")
    cells = cells.select("cell", "cuts", rings.alias("rings"),
                         F.greatest(F.lit(1), F.ceil(F.col("n") / (rings * rows))).cast("int").alias("salts"))
    sixteenth = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    ring = F.floor(sixteenth * F.col("rings") / 16)
    salt = F.pmod(F.xxhash64("id"), F.col("salts"))
    blocked = placed.join(F.broadcast(cells), "cell").select(  # MAX_PIVOTS rows
        "id", "vec", "cell", "far", ring.alias("ring"), salt.alias("salt"))
    stats = blocked.groupBy("cell", "ring", "salt").agg(
        F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    place = _chain(pivots)
    known = sorted(stats.collect(), key=lambda r: (place[r.cell], r.ring, r.salt))  # MAX_BLOCKS rows at most
    ends = np.cumsum([r.n for r in known])
    bundle = np.unique((ends - 1) // (BUNDLE_BLOCKS * rows), return_inverse=True)[1]
    numbers = spark.createDataFrame([(r.cell, r.ring, r.salt, k, int(bundle[k])) for k, r in enumerate(known)],
                                    "cell int, ring bigint, salt bigint, block int, bundle int")
    out = scratch_path(spark, "blocks")
    blocked.join(F.broadcast(numbers), ["cell", "ring", "salt"]).select("id", "vec", "block", "bundle").write.parquet(out)
    return Index(spark.read.parquet(out), Blocks(
        pivots, np.array([r.cell for r in known], int), np.array([r.n for r in known]),
        np.array([r.low for r in known]), np.array([r.high for r in known]), bundle))


def _best(q: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, visited: np.ndarray | None = None):
    """Per query: the places in ``b`` and the distances of the k nearest, by distance at 1e-9
    and id; only among those ``visited`` (queries x rows) where that is given."""
    near = _squared(q, b)
    if visited is not None:
        near[~visited] = np.inf
    k = min(k, len(b))
    for i in range(len(q)):
        cut = np.partition(near[i], k - 1)[k - 1]
        some = np.flatnonzero((near[i] <= cut + SLACK * (1 + cut)) & (near[i] < np.inf))
        diff = b[some] - q[i]
        d = np.floor(np.einsum("ij,ij->i", diff, diff) * TIE_SCALE + 0.5) / TIE_SCALE
        order = np.lexsort((ids[some], d))[:k]
        yield some[order], d[order]


def _visit(k: int):
    """Score the queries that visit a bundle against the rows of its blocks, some
    queries at a time against all blocks that one of these visits."""
    def score(key, qdf: pd.DataFrame, bdf: pd.DataFrame) -> pd.DataFrame:
        if len(qdf) == 0 or len(bdf) == 0:
            return pd.DataFrame({"qid": [], "id": [], "dist": []})
        rows = np.stack(bdf["vec"].to_numpy()).astype(np.float64)
        ids, block = bdf["id"].to_numpy(dtype=np.int64), bdf["block"].to_numpy()
        every, out = len(np.unique(block)), []
        # queries that visit the same blocks stand together
        qdf = qdf.iloc[np.argsort([b.tobytes() for b in qdf["blocks"]], kind="stable")]
        for at in range(0, len(qdf), 256):
            part = qdf.iloc[at: at + 256]
            lists = part["blocks"].to_numpy()
            blocks = np.unique(np.concatenate(lists))
            some = slice(None) if len(blocks) == every else np.flatnonzero(np.isin(block, blocks))
            b, of, visited = rows[some], ids[some], None
            if any(len(x) < len(blocks) for x in lists):
                visited = np.stack([np.isin(blocks, x) for x in lists])[:, np.searchsorted(blocks, block[some])]
            q = np.stack(part["vec"].to_numpy()).astype(np.float64)
            out += [(np.full(len(d), qid), of[near], d) for qid, (near, d) in zip(part["qid"], _best(q, b, of, k, visited))]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(("qid", "id", "dist"), zip(*out))})
    return score


def _visits(queries: DataFrame, blocks: Blocks, k: int, first: bool) -> DataFrame:
    """(qid, vec, bundle, blocks): the blocks around each query that hold k rows, or (with
    ``bound``, the squared k-th distance there) the others that may hold something as near."""
    import pyarrow as pa

    vec_type = queries.schema["vec"].dataType.simpleString()

    def run(batches):
        for b in batches:
            qid, vec = (b.column(b.schema.get_field_index(c)) for c in ("qid", "vec"))
            x = _matrix(vec)
            bound = None if first else b.column(b.schema.get_field_index("bound")).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 256):
                low, high = blocks.bounds(x[at: at + 256])
                order = np.argsort(high, axis=1, kind="stable")
                held = np.cumsum(blocks.size[order], axis=1)
                home = np.zeros(low.shape, bool)
                np.put_along_axis(home, order, np.concatenate([np.zeros((len(low), 1)), held[:, :-1]], axis=1) < k, axis=1)
                if first:
                    pick = home
                else:
                    reach = np.sqrt(bound[at: at + 256, None])
                    pick = ~home & (low <= reach + SLACK * (1 + reach))
                row, block = np.nonzero(pick)
                bundle = blocks.bundle[block]  # ascends with the block
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])
                first_of = np.flatnonzero(new)
                take = pa.array(row[first_of] + at)
                lists = pa.ListArray.from_arrays(np.append(first_of, len(row)).astype(np.int32), block.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [qid.take(take), vec.take(take), pa.array(bundle[first_of].astype(np.int32)), lists],
                    names=["qid", "vec", "bundle", "blocks"])

    return queries.mapInArrow(run, f"qid bigint, vec {vec_type}, bundle int, blocks array<int>")


def _scored(visits: DataFrame, index: Index, k: int, query_rows: int) -> DataFrame:
    """Candidates of all visits. The visitors of a bundle are dealt over as many
    groups as they are times ``query_rows``; the bundle goes to each of these."""
    counts = visits.groupBy("bundle").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("groups"))
    counts = F.broadcast(counts)  # fewer than MAX_BLOCKS rows
    q = visits.join(counts, "bundle").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).drop("groups")
    b = index.rows.join(counts, "bundle").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    return q.groupBy("bundle", "part").cogroup(b.groupBy("bundle", "part")).applyInPandas(_visit(k), CANDIDATE_SCHEMA)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return candidates.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def knn_search(queries: DataFrame, base: DataFrame, k: int = 5, query_block_rows: int = QUERY_BLOCK_ROWS,
               base_block_rows: int = BASE_BLOCK_ROWS, report: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """``knn_topk``, and (with ``report``) how many of the pairs of a query and a block it visited."""
    spark = queries.sparkSession
    path = scratch_path(spark, "queries")
    queries.filter(F.col("vec").isNotNull()).select("qid", "vec").write.parquet(path)
    queries = spark.read.parquet(path)
    index = build_index(base.filter(F.col("vec").isNotNull()).select(F.col("id").cast("bigint"), "vec"), base_block_rows)
    if not len(index.blocks.size):
        return spark.createDataFrame([], CANDIDATE_SCHEMA + ", rank bigint"), {"pairs": 0, "visited": 0}
    n_q, par = queries.count(), max(spark.sparkContext.defaultParallelism, 8)
    share = n_q * (int(index.blocks.bundle.max()) + 1) // (4 * par)
    query_block_rows = max(query_block_rows, min(QUERY_BLOCK_MOST, share))
    at = scratch_path(spark, "near")
    _ranked(_scored(_visits(queries, index.blocks, k, True), index, k, query_block_rows), k).write.parquet(at)
    near = spark.read.parquet(at)
    # (fewer than k rows in all: every block is around the query, and nothing is left to visit)
    bound = near.groupBy("qid").agg(F.max("dist").alias("bound"))
    more = _visits(queries.join(bound, "qid"), index.blocks, k, False)
    out = scratch_path(spark, "visits")
    more.write.parquet(out)
    more = spark.read.schema(more.schema).parquet(out)
    found = _ranked(near.drop("rank").unionByName(_scored(more, index, k, query_block_rows)), k)
    if not report:
        return found, {}
    homes = _visits(queries, index.blocks, k, True)
    visited = homes.unionByName(more).agg(F.coalesce(F.sum(F.size("blocks")), F.lit(0))).first()[0]
    return found, {"pairs": n_q * len(index.blocks.size), "visited": visited}


def knn_topk(queries: DataFrame, base: DataFrame, k: int = 5, query_block_rows: int = QUERY_BLOCK_ROWS,
             base_block_rows: int = BASE_BLOCK_ROWS) -> DataFrame:
    """k nearest base rows per query → (qid, rank, id, dist), by squared
    Euclidean distance, exact; ties (at 1e-9) go to the smaller id.

    ``queries``: (qid, vec); ``base``: (id, vec), all vectors of one length.
    Rows without a vector are left out. ``qid`` names a query."""
    return knn_search(queries, base, k, query_block_rows, base_block_rows, report=False)[0]


def round_dist(df: DataFrame, digits: int = 4, col: str = "dist", out: str = "distance") -> DataFrame:
    return df.withColumn(out, round_half_up(col, digits)).drop(col) if out != col else \
        df.withColumn(out, round_half_up(col, digits))
