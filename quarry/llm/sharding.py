"""Operator 8, sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``BITS`` bits each (numbers at
quantiles, categories by hash), a document's cell is turned into its index on
the Hilbert curve through these dimensions, documents are sorted by that index
and the sorted run is cut into shards whose row counts differ by one at most
(law ``rows``). Neighbours on the curve share most dimensions, so each shard
and, in written files, each row group spans a small box and readers can skip
it by its minima and maxima.

The total order is (curve index, checksum of the text, length, id): equal texts of
equal metadata are neighbours. Sorting is a range exchange over narrow rows;
positions come from counts per range, never from a window over all rows.

Defined results: a null text has size 1 (no bytes plus 1) and the checksum of
the empty text; null categories share one cell, null numbers the lowest one.
Null ids come before all others among rows of equal curve index, checksum and
length. Texts are only measured, whole, whatever their length. Fully equal rows take any order among themselves, which leaves the result
as a set unchanged. An empty table gives an empty result. ``assign`` keeps all
columns, and its own (``shard``, ``slot``) replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read, stored

BITS = 5
SHARDS = 16


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def curve_tables(n: int) -> tuple[list[int], list[int], list[int]]:
    """For n dimensions: rank of a corner along the curve (inverse Gray code),
    the entry corner and the direction of each sub-cube, by rank."""
    rank = [0] * (1 << n)
    for i in range(1 << n):
        rank[_gray(i)] = i

    def ones(i: int) -> int:
        return ((i ^ (i + 1)) >> 1).bit_length()

    entry = [0 if w == 0 else _gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else (ones(w - 1) if w % 2 == 0 else ones(w)) % n for w in range(1 << n)]
    return rank, entry, turn


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index of a cell on the Hilbert curve, as one fold over the bit levels.

    The state is the orientation of the current cube: its entry corner and the
    axis along which it is left."""
    n = len(cells)
    mask = (1 << n) - 1
    rank, entry, turn = (F.array(*map(F.lit, t)) for t in curve_tables(n))

    def rotate_right(x: Column, by: Column) -> Column:
        right, left = F.call_function("shiftright", x, by), F.call_function("shiftleft", x, F.lit(n) - by)
        return right.bitwiseOR(left).bitwiseAND(F.lit(mask))

    def rotate_left(x: Column, by: Column) -> Column:
        return rotate_right(x, F.lit(n) - by)

    # One value per level, highest bits first: the corner of the sub-cube.
    corners = []
    for b in range(bits - 1, -1, -1):
        c = F.lit(0)
        for k, q in enumerate(cells):
            c = c.bitwiseOR(F.shiftleft(F.shiftright(q, b).bitwiseAND(F.lit(1)), k))
        corners.append(c)

    def step(s: Column, corner: Column) -> Column:
        by = (s["d"] + 1) % n
        w = F.get(rank, rotate_right(corner.bitwiseXOR(s["e"]), by))
        return F.struct(
            (s["h"] * (1 << n) + w).alias("h"),
            s["e"].bitwiseXOR(rotate_left(F.get(entry, w), by)).alias("e"),
            ((s["d"] + F.get(turn, w) + 1) % n).alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*corners), start, step, lambda s: s["h"])


def quantised(df: DataFrame, numbers: list[str], categories: list[str], bits: int = BITS) -> list[Column]:
    """One cell column per dimension. Numbers are cut at quantiles found in one
    pass (2**bits - 1 bounds each); equal values always share a cell."""
    cells = 1 << bits
    shares = [i / cells for i in range(1, cells)]
    out = []
    if numbers:
        got = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{k}") for k, c in enumerate(numbers)]).first()
        for c, bounds in zip(numbers, got):
            over = F.lit(0)
            for b in sorted(set(bounds or [])):
                over = over + F.when(F.col(c) > F.lit(b), 1).otherwise(0)
            out.append(F.coalesce(over, F.lit(0)).cast("int"))
    for c in categories:
        out.append(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(cells)).cast("int"))
    return out


def positions(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``__rank``, its place (from 0) in the total order, and the
    number of rows. The sorted rows are stored with their range and place in
    it, so that rows and counts come from one and the same layout."""
    laid = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftrightunsigned("__id", 33).cast("int"))
        .withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"), "ranges")
    sizes = laid.groupBy("__part").count()
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("__before"))
    total = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # (one row a range: as many as tasks sorted)
    ranked = laid.join(F.broadcast(before), "__part").withColumn("__rank", F.col("__before") + F.col("__at"))
    return ranked.drop("__part", "__at", "__before"), total


def assign(df: DataFrame, numbers: list[str], categories: list[str], ties: list[str],
           shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: rows sorted by curve index, then by
    ``ties``, and cut into ``shards`` runs. Shard s holds the places from
    ceil(s * n / shards) up to the next shard's first."""
    keep = [c for c in df.columns if c not in ("shard", "slot")]
    curve = hilbert_index(quantised(df, numbers, categories, bits), bits)
    ranked, n = positions(df.select(*[F.col(f"`{c}`") for c in keep], curve.alias("__curve")),
                          ["__curve", *[f"`{t}`" for t in ties]])
    whole = ranked.withColumn("__n", F.lit(max(n, 1)).cast("long"))
    placed = whole.withColumn("shard", F.expr(f"CAST((__rank * {shards}) DIV __n AS int)"))
    return placed.select(*[F.col(f"`{c}`") for c in keep], "shard", F.expr(
        f"__rank - (CAST(shard AS long) * __n + {shards - 1}) DIV {shards}").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order, so that file minima and maxima
    of the quantised dimensions are tight."""
    (assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot along the curve over size, source and language."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    # (the bytes are read once: quantiles and the sort both start from the narrow rows)
    d = assign(stored(docs, "sizes"), ["size"], ["source", "lang"], ["text_crc32", "size", "doc_id"])
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source", "lang")
