"""Overlap counts between axis-aligned boxes of the same image, by a plane
sweep in slabs and without forming box pairs.

With ``S(k)`` the boxes whose left end lies before the right end of box A
(k = 0), or whose right end lies at or before the left end of A (k = 1), the
boxes that overlap A on both axes are

    [low ends of S(0) below A's top] − [top ends of S(0) at or below A's low end]
    − the same for S(1) − A itself

so a sweep over x answers every box by how many points it has passed whose
other coordinate lies below a bound. Points (ends of boxes) and queries are put
in one distributed order by image, kind and x; runs of ``SLAB`` of them are the
slabs. Inside a slab the counts come from a rank structure over the order
(bit planes of the points' ranks, all queries of the slab at once). What an
image has in earlier slabs is added from dyadic blocks of slabs, where x is
settled and the count is a running sum in the order of the other coordinate.
An image of any size takes the same way; one that lies within a slab has no
blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import ensure_checkpoint_dir

SLAB = 1 << 16  # ends and queries that are swept together

_PLACE = (1 << 33) - 1


def _below(ranks: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of ``ranks[lo:hi]`` are below ``bound``, for many ranges at once."""
    n = len(ranks)
    total = np.zeros(len(bound), np.int64)
    lo, hi, row = lo.copy(), hi.copy(), ranks
    for b in range(n.bit_length() - 1, -1, -1):
        one = (row >> b) & 1
        ones = np.concatenate([[0], np.cumsum(one)])
        zeros = n - ones[-1]
        lo1, hi1 = ones[lo], ones[hi]
        up = ((bound >> b) & 1).astype(bool)
        total += np.where(up, (hi - lo) - (hi1 - lo1), 0)  # the bound has a one here: all with a zero are below
        lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        row = np.concatenate([row[one == 0], row[one == 1]])
    return total


def _counts(group: np.ndarray, point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query of a slab, in order: the points of its group before it
    with ``low`` below its ``high``, less those with ``high`` at or below its
    ``low`` (points carry their ends, queries those of their box)."""
    before = np.concatenate([[0], np.cumsum(point)])
    query = ~point
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if len(group) else np.zeros(0, int)
    first = starts[np.searchsorted(starts, np.arange(len(group)), "right") - 1]
    lo, hi = before[first[query]], before[:-1][query]
    out = np.zeros(int(query.sum()), np.int64)
    for values, bounds, side, sign in ((low[point], high[query], "left", 1), (high[point], low[query], "right", -1)):
        order = np.argsort(values, kind="stable")
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        out += sign * _below(ranks, lo, hi, np.searchsorted(values[order], bounds, side))
    return out


def _changes(columns) -> np.ndarray:
    """A number per row that grows where any of the (sorted) columns changes."""
    import pyarrow.compute as pc

    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _swept(events: DataFrame, grp: str) -> DataFrame:
    """(id, kind, n) of the queries of ``events``, counted within their slabs.
    The rows come as they lie: in order, a slab's rows together."""
    import pyarrow as pa

    def run(batches):
        waiting, slab = [], None

        def done():
            t = pa.Table.from_batches(waiting).combine_chunks()
            point = t["point"].to_numpy()
            n = _counts(_changes([t["kind"].combine_chunks(), t[grp].combine_chunks()]), point,
                        t["low"].to_numpy(), t["high"].to_numpy())
            query = pa.array(~point)
            return pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks().filter(query), t["kind"].combine_chunks().filter(query), pa.array(n)],
                names=["id", "kind", "n"])

        for b in batches:
            slabs = b.column(b.schema.get_field_index("slab")).to_numpy()
            cuts = np.flatnonzero(np.diff(slabs)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(slabs)]):
                if a == z:
                    continue
                if slab is not None and slabs[a] != slab:
                    yield done()
                    waiting = []
                slab = slabs[a]
                waiting.append(b.slice(a, z - a))
        if waiting:
            yield done()

    kind_of = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.mapInArrow(run, f"id {kind_of['id']}, kind int, n bigint")


def _laid(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in one distributed order, stored with range (``__part``) and place in it (``__at``)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("__mid", F.monotonically_increasing_id())
            .withColumn("__part", F.shiftrightunsigned("__mid", 33))
            .withColumn("__at", F.col("__mid").bitwiseAND(F.lit(_PLACE))).drop("__mid").checkpoint())


def _earlier_slabs(events: DataFrame, grp: str) -> DataFrame:
    """(id, kind, n) of the queries whose group goes back beyond their slab,
    counted in the earlier slabs."""
    import pyarrow as pa

    sizes = events.groupBy(grp, "kind", "slab").agg(F.count("*").alias("size"))
    whole = Window.partitionBy(grp, "kind")  # a row a slab
    slabs = sizes.select(grp, "kind", "slab", (F.row_number().over(whole.orderBy("slab")) - 1).alias("k"),
                         F.count("*").over(whole).alias("slabs")).filter(F.col("slabs") > 1)
    rows = events.join(slabs, [grp, "kind", "slab"])  # dealt by slab, so a large image is many keys
    level = F.explode(F.sequence(F.lit(0), F.length(F.bin("slabs")))).alias("level")
    points = rows.filter("point").select(grp, "kind", "id", "low", "high", "k", level).select(
        grp, "kind", "id", "low", "high", "level", F.expr("shiftright(k, level)").alias("block"), F.lit(True).alias("point"))
    queries = rows.filter("not point").select(grp, "kind", "id", "low", "high", "k", level).filter(
        F.expr("shiftright(k, level)").bitwiseAND(F.lit(1)) == 1).select(
        grp, "kind", "id", "low", "high", "level", (F.expr("shiftright(k, level)") - 1).alias("block"),
        F.lit(False).alias("point"))
    # term 0: low ends below the query's top (strictly: the query comes first); term 1: top ends at or below its low end
    at = F.when(F.col("point") == (F.col("term") == 0), F.col("low")).otherwise(F.col("high"))
    turn = F.when(F.col("point") == (F.col("term") == 0), F.lit(1)).otherwise(F.lit(0))
    block = [grp, "kind", "level", "block", "term"]
    lined = points.unionByName(queries).withColumn("term", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        *block, at.alias("v"), turn.alias("turn"), "id", "point")
    laid = _laid(lined, [*block, "v", "turn", "id"])
    runs = laid.groupBy("__part", *block).agg(F.count_if("point").alias("size"))
    before = Window.partitionBy(*block).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    shift = runs.select("__part", *block, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))

    def running(batches):
        carry, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(b.schema.get_field_index(c)) for c in block]
            key = tuple(c[0].as_py() for c in columns)
            group = _changes(columns)
            point = b.column(b.schema.get_field_index("point")).to_numpy(zero_copy_only=False)
            sums = np.cumsum(point)
            start = np.flatnonzero(np.diff(group, prepend=-1))
            base = np.concatenate([[0], sums])[start][group]
            n = sums - base + np.where(group == 0, carry if key == last else 0, 0)
            carry, last = int(n[-1]), tuple(c[len(c) - 1].as_py() for c in columns)
            keep = pa.array(~point)
            names = ["id", *block, "__part"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)).filter(keep) for c in names], pa.array(n[~point].astype(np.int64))],
                names=[*names, "n"])

    kept = ", ".join(f"`{c}` {laid.schema[c].dataType.simpleString()}" for c in ["id", *block, "__part"])
    counted = laid.mapInArrow(running, f"{kept}, n bigint").join(shift, ["__part", *block])
    sign = F.when(F.col("term") == 0, F.lit(1)).otherwise(F.lit(-1))
    return counted.select("id", "kind", (sign * (F.col("n") + F.col("shift"))).alias("n"))


def overlap_counts(boxes: DataFrame, grp: str = "img", slab: int = SLAB) -> DataFrame:
    """(id, grp, x, y, w, h) → (id, grp, n_overlap): boxes of the same group
    that share a positive area with each box, itself excluded. A box without
    an area (w or h not above 0), without a place or without a group overlaps
    nothing. ``id`` names a box. Coordinates may be negative or real (they are
    compared as doubles)."""
    ensure_checkpoint_dir(boxes.sparkSession)
    solid = boxes.filter((F.col("w") > 0) & (F.col("h") > 0) & F.col("x").isNotNull() & F.col("y").isNotNull()
                         & F.col(grp).isNotNull())

    def number(c):
        return c.cast("double") + F.lit(0.0)  # one zero

    ends = solid.select("id", grp, number(F.col("x")).alias("x"), number(F.col("x") + F.col("w")).alias("x2"),
                        number(F.col("y")).alias("low"), number(F.col("y") + F.col("h")).alias("high"))
    # kind 0: left ends strictly before a right end, so the query comes first; kind 1: right ends up to a left end
    marks = [(0, "x2", False, 0), (0, "x", True, 1), (1, "x2", True, 0), (1, "x", False, 1)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("v"), F.lit(p).alias("point"),
                                        F.lit(t).alias("turn")) for k, c, p, t in marks])).alias("e")
    events = ends.select("id", grp, "low", "high", each).select("id", grp, "low", "high", "e.*")
    laid = _laid(events, [grp, "kind", "v", "turn", "id"])
    place = F.shiftleft("__part", 33).bitwiseOR(F.floor(F.col("__at") / slab))
    events = laid.select("id", grp, "kind", "low", "high", "point", place.alias("slab"))
    parts = _swept(events, grp).unionByName(_earlier_slabs(events, grp))
    sign = F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))
    found = parts.groupBy("id").agg((F.sum(sign) - 1).alias("_c"))
    return boxes.select("id", grp).join(found, "id", "left").select(
        "id", grp, F.coalesce("_c", F.lit(0)).cast("bigint").alias("n_overlap"))


def neighbour_filter(boxes: DataFrame, min_neighbors: int = 3, min_w: int = 30, min_h: int = 30,
                     grp: str = "img") -> DataFrame:
    """Boxes at least min_w × min_h that overlap at least ``min_neighbors``
    other boxes of the same image."""
    c = overlap_counts(boxes, grp)
    return (boxes.join(c.select("id", "n_overlap"), "id")
            .filter((F.col("w") >= min_w) & (F.col("h") >= min_h) & (F.col("n_overlap") >= min_neighbors)))
