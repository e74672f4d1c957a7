"""Operator 3, document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch is the ``K`` smallest distinct hashes of its shingles of
``WIDTH`` words (fewer words: the whole sequence is one shingle). The sketch
of a union of parts is the bottom k of their sketches joined (``merge``), and
two sketches estimate resemblance (share of the union's bottom k that lies in
both), containment and, from the k-th smallest hash, the number of distinct
shingles. While a text has at most K distinct shingles all three are exact.

The next document in id order comes from blocks of ids: a block's bounds are
quantiles of the ids, the first row of each block is also sent to the block
before it (the very first to the last one), and a window runs within a block.
Texts are exchanged once; no window spans all rows.

Defined results: null or blank texts have an empty sketch (fingerprint ``""``);
two empty sketches resemble by 1, an empty and another one by 0. Rows of equal
id, or without one (these come first), follow each other by text, and lie in
one block however many they are. Texts of any length are sketched whole: a
row's words and hashes are in memory while it is. The only row is its own
successor. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import read, words

K = 128
WIDTH = 5
BLOCKS_PER_PARTITION = 4

_LONGS = "array<bigint>"


def add_sketch(df: DataFrame, text: str, sketch: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the column ``sketch``: the k smallest distinct shingle hashes, ascending."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != sketch]
    d = df.select(*keep, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__w"))
    n = F.size("__w")
    shingle = F.transform(F.sequence(F.lit(0), n - width),
                          lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(width)]))
    hashes = (F.when(n >= width, shingle).when(n > 0, F.array(F.xxhash64("__w")))
              .otherwise(F.array().cast(_LONGS)))
    return d.select(*keep, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k).alias(sketch))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def merge_groups(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key. Each task first cuts its part to k hashes a key, so
    no group ever meets as a whole."""
    w = Window.partitionBy(key).orderBy("__h")
    top = (df.select(key, F.explode(sketch).alias("__h")).distinct()
           .withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k))
    return top.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    j, n = resemblance(a, b, k), distinct_count(a, k)
    shared = j / (1 + j) * (n + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / n))


def as_text(sketch: Column) -> Column:
    """Sixteen hex digits a hash, ascending."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def id_blocks(df: DataFrame, key: str, blocks: int) -> Column:
    """Block number of an id: its place among quantiles of all ids, by halving.

    The bounds are as many as there are blocks (set by the number of shuffle
    partitions, not by the rows)."""
    shares = [i / blocks for i in range(1, blocks)]
    got = df.agg(F.percentile_approx(key, shares, 10 * max(blocks, 1000))).first()[0] if shares else None
    bounds = sorted(set(got or []))
    if not bounds:
        return F.lit(0)
    arr = F.array(*map(F.lit, bounds))

    def halve(s: Column, _step: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(arr, mid) < F.col(key))
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1))
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def with_successor_block(df: DataFrame, key: str) -> DataFrame:
    """``df`` with __block, __wrap and __own: each block also holds the first
    row of the next one (__own false), the last block that of the first."""
    spark = df.sparkSession
    blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = id_blocks(df, key, blocks)
    ids = df.select(key, block.alias("__block"))
    firsts = ids.groupBy("__block").agg(F.min(key).alias("__first"))
    # (at most one row a block)
    w = Window.orderBy("__block")
    last = F.max("__block").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = firsts.select("__first", F.coalesce(F.lag("__block").over(w), last).alias("__to"),
                           F.lag("__block").over(w).isNull().alias("__wrapped"))
    d = df.withColumn("__block", block).join(F.broadcast(before), F.col(key) == F.col("__first"), "left")
    own = F.struct(F.col("__block").alias("b"), F.lit(0).alias("w"), F.lit(True).alias("o"))
    copy = F.struct(F.col("__to").alias("b"), F.col("__wrapped").cast("int").alias("w"), F.lit(False).alias("o"))
    places = F.when(F.col("__first").isNull(), F.array(own)).otherwise(F.array(own, copy))
    keep = [c for c in df.columns]
    return d.select(*keep, F.explode(places).alias("__p")).select(
        *keep, F.col("__p.b").alias("__block"), F.col("__p.w").alias("__wrap"), F.col("__p.o").alias("__own"))


def op3_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to it and to the next text's."""
    docs = read(spark, sf_dir, "documents").select(
        F.coalesce("doc_id", F.lit(-(2 ** 63))).alias("__key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("__block").orderBy("__wrap", "__key", "text")
    d = with_successor_block(docs, "__key").withColumn("__next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("__next", F.lit(1), half))).drop("__next")
    d = add_sketch(add_sketch(d, "text", "sketch"), "edited", "edited_sketch")
    d = d.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    d = d.withColumn("__next_sketch", F.lead("sketch").over(order)).filter("__own")
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("__next_sketch")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b).alias("near_edited"), resemblance(a, c).alias("near_next"),
        distinct_count(a).alias("n_shingles_estimate"), containment(a, c).alias("in_next"))
