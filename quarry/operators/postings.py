"""Exact top-k search over sparse vectors of unit length, by an inverted index.

Weights are not negative, so what a query's document is known to score over
some of the query's terms only grows with the others, and by no more than the
terms' impacts (the query's weight times the greatest weight among the term's
postings). Three rounds use this:

1. the terms of most impact, a few per query, are scored against their
   postings; the k-th best of these partial scores is a threshold that the
   k-th best full score reaches at least;
2. terms are essential until the impacts of the rest, together, stay below the
   threshold: a document without an essential term is out. The essential terms
   are scored, and documents that cannot reach the threshold even with all the
   rest are dropped;
3. the rest of the terms is added for the documents that are left.

Everything is joins and sums on terms and documents: no vector is ever made
dense, and a term that most documents have is dealt over many keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import scratch_path

FIRST_TERMS = 3
POSTINGS = 1 << 16  # of a term, in one key
SLACK = 1e-8
TIE_SCALE = 1e9


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scores(terms: DataFrame, postings: DataFrame, name: str) -> DataFrame:
    """(qid, id, name): the sums over the given query terms."""
    hits = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(postings, ["term", "salt"])
    return hits.groupBy("qid", "id").agg(F.sum(F.col("q") * F.col("w")).alias(name))


def topk_unit(queries: DataFrame, base: DataFrame, query_ids: DataFrame, base_ids: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest base rows of each query → (qid, rank, id, dist), with dist =
    2 − 2·(sum of products), the squared distance of unit vectors; ties (at
    1e-9) go to the smaller id.

    ``queries`` (qid, term, q) and ``base`` (id, term, w) are long, weights above
    0 and each term once a row; ``query_ids`` (qid) and ``base_ids`` (id) list
    all rows, also those without terms, which are at distance 2 from all."""
    base, queries = _kept(base, "weights"), _kept(queries, "query-weights")
    sizes = base.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("most"))
    sizes = _kept(sizes.select("term", "most", F.ceil(F.col("df") / POSTINGS).cast("int").alias("salts")), "terms")
    postings = _kept(base.join(sizes.select("term", "salts"), "term").select(
        "term", "id", "w", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")), "postings")
    impact = F.col("q") * F.col("most")
    by_impact = Window.partitionBy("qid").orderBy(F.desc("impact"), "term")
    below = Window.partitionBy("qid").orderBy("impact", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    terms = _kept(queries.join(sizes, "term").withColumn("impact", impact)
                  .withColumn("nth", F.row_number().over(by_impact))
                  .withColumn("rest", F.sum("impact").over(below)), "query-terms")  # this term and all of less impact
    partial = _scores(terms.filter(F.col("nth") <= FIRST_TERMS), postings, "s")
    kth = partial.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s")))).filter(
        F.col("nth") == k).select("qid", F.col("s").alias("least"))
    terms = _kept(terms.join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
                  .withColumn("essential", F.col("rest") >= F.col("least") - SLACK), "query-terms")
    others = terms.groupBy("qid").agg(F.first("least").alias("least"),
                                      F.sum(F.when(~F.col("essential"), F.col("impact")).otherwise(0.0)).alias("others"))
    some = _scores(terms.filter("essential"), postings, "s").join(others, "qid")
    some = _kept(some.filter(F.col("s") + F.col("others") >= F.col("least") - SLACK).select("qid", "id", "s"), "candidates")
    left = terms.filter(~F.col("essential")).select("qid", "term", "q")
    added = (some.select("qid", "id").join(left, "qid")
             .join(postings.select("id", "term", "w"), ["id", "term"])
             .groupBy("qid", "id").agg(F.sum(F.col("q") * F.col("w")).alias("more")))
    scored = some.join(added, ["qid", "id"], "left").select(
        "qid", "id", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("dot"))
    scored = scored.select("qid", "id", (F.floor((2.0 - 2.0 * F.col("dot")) * TIE_SCALE + 0.5) / TIE_SCALE).alias("dist"))
    w = Window.partitionBy("qid").orderBy("dist", "id")
    best = _kept(scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "hits")
    # Queries that share terms with fewer than k rows are filled up with the least ids among the others,
    # which are within the k least ids of all and those that the query has.
    short = query_ids.join(best.groupBy("qid").count(), "qid", "left").filter(
        F.coalesce("count", F.lit(0)) < k).select("qid")
    least = base_ids.select("id").orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("ids"))
    ids = least.first()[0]  # 2k numbers
    fill = short.withColumn("id", F.explode(F.array(*[F.lit(i) for i in ids]).cast("array<bigint>"))).join(
        best.select("qid", "id"), ["qid", "id"], "left_anti").withColumn("dist", F.lit(2.0))
    return (best.drop("rank").unionByName(fill).withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k))
