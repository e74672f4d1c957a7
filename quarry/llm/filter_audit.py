"""Operator 13, an audit of how corpus filters interact.

Every document gets a set of bits, one per filter it fails. Four bits come
from its own text in one projection. The fifth, E, is found by an existential
self-join: a left-semi join of the documents against the first of each text,
on the text's hash, the exact text and a smaller id. The ids that it marks are
united with the other failing ids and their bits are put together; documents
with equal bits, part and labels are counted, and only these few combinations
are laid out over all orders of the filters.

Scale: texts are read twice and exchanged once, by their hash, to find those
whose hash occurs more than once (always so: a broadcast of such hashes while
they are few would only hide what the join costs); what is left goes on. Copies of one text are dealt over as many salts as they are
thousands, and the one row of the first copy is repeated for each of them, so
no text, however common, is one task. Everything else that is exchanged is
ids, hashes and counts.

Defined results: a null text is the empty text (so all of them are copies of
one another); a null ``lang`` and an empty one are the same part. A null id is
smaller or greater than no other: such rows neither fail E nor make others
fail it. Rows that repeat an id are documents of their own and are counted
each, but do not make each other fail E (equal is not smaller). A document is
good or toxic if any row of ``labels`` with its id says 1. Texts without words
fail A and pass B. An empty table gives no rows; columns that aren't named
here are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, stored, words

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
COPIES = 1000  # rows of one text in a task of the self-join

BIT = {f: 1 << i for i, f in enumerate(FILTERS)}


def own_bits(text: Column, w: Column) -> Column:
    """The bits of filters A to D for a text and the array of its words."""
    fails = {
        "A": F.size(w) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.length(text),
        "D": F.regexp_like(text, F.lit(SYMBOLS)),
    }
    out = F.lit(0)
    for f, c in fails.items():
        out = out + F.when(c, F.lit(BIT[f])).otherwise(0)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash, bits of every row of ``docs`` (doc_id, lang, text)."""
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "part", "text", F.sha2("text", 256).alias("hash"), words(F.col("text")).alias("w"))
    # Out of a generator, so that the words are computed once.
    return d.select("doc_id", "part", "hash",
                    F.explode_outer(F.array(own_bits(F.col("text"), F.col("w")))).alias("bits"))


def later_copies(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a smaller id has too."""
    shared = stored(facts.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("__least"),
                                              F.max("doc_id").alias("__most"))
                    .filter(F.col("__least") < F.col("__most"))
                    .select("hash", F.ceil(F.col("n") / COPIES).cast("int").alias("salts")), "audit-shared")
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"),
                        F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("hash", F.sha2("text", 256)).join(shared.hint("merge"), "hash")
    texts = stored(texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")), "audit-texts")
    firsts = (texts.groupBy("hash", "text", "salts").agg(F.min("doc_id").alias("first_id"))
              .select("hash", "text", "first_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")))
    rows, first = texts.alias("r"), firsts.alias("f")
    same = ((F.col("r.hash") == F.col("f.hash")) & (F.col("r.salt") == F.col("f.salt"))
            & (F.col("r.text") == F.col("f.text")) & (F.col("f.first_id") < F.col("r.doc_id")))
    return rows.join(first, same, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, good, toxic, n): how many documents fail just these filters."""
    facts = stored(measured(docs), "audit-facts")
    failing = facts.withColumn("n", F.lit(1)).unionByName(
        later_copies(docs, facts).withColumn("bits", F.lit(BIT["E"])).withColumn("n", F.lit(0)))
    each = failing.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                                         F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = each.join(marks, "doc_id", "left")
    return each.groupBy("part", "bits", F.coalesce("good", F.lit(0)).alias("good"),
                        F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(combos: DataFrame) -> DataFrame:
    """All orders and steps of the filters over the combinations: 600 rows a part."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    d = combos.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.array(*[F.lit(k) for k in range(1, len(FILTERS) + 1)])))
    letters = F.create_map(*[F.lit(x) for f, b in BIT.items() for x in (f, b)])
    own = letters[F.substring("filter_order", F.col("step"), F.lit(1))]
    before = F.lit(0)
    for f, b in BIT.items():
        before = before + F.when(F.instr("filter_order", f) < F.col("step"), F.lit(b)).otherwise(0)
    # Instead of a switch per figure: 0 or 1 for each condition, times the count.
    d = d.withColumn("own", F.col("bits").bitwiseAND(own) != 0).withColumn("early", F.col("bits").bitwiseAND(before) != 0)
    removed = F.col("own") & ~F.col("early")
    # Of the orders of all filters, a document's k failing ones share the removal evenly.
    share = F.lit(len(list(permutations(FILTERS)))) / F.bit_count("bits")

    def total(cond: Column, value: Column = F.col("n")) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")

    return d.groupBy("part", "filter_order", "step").agg(
        total(~F.col("own") & ~F.col("early")).alias("kept"),
        total(removed).alias("removed"),
        total(F.col("own") & F.col("early")).alias("redundant"),
        total(F.col("own") & (F.bit_count("bits") == 1)).alias("unique_fails"),
        total(removed & (F.col("good") == 1)).alias("good_lost"),
        total(removed & (F.col("toxic") == 1)).alias("toxic_lost"),
        total(F.col("own"), F.col("n") * share.cast("long")).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order of the five filters and step: what the step's filter keeps and removes."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audit(combinations(docs, labels))


def _sql() -> str:
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    {{'A': len(w) < {MIN_WORDS}, 'B': 100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w),
      'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITALS_PERCENT} * length(t),
      'D': regexp_matches(t, '{SYMBOLS}'),
      'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)}} AS b
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (
  SELECT part, good, toxic, list_concat(CASE WHEN b.A THEN ['A'] ELSE [] END, CASE WHEN b.B THEN ['B'] ELSE [] END,
    CASE WHEN b.C THEN ['C'] ELSE [] END, CASE WHEN b.D THEN ['D'] ELSE [] END,
    CASE WHEN b.E THEN ['E'] ELSE [] END) AS fails, count(*) AS n FROM f GROUP BY ALL),
o AS (SELECT unnest([{orders}]) AS filter_order),
s AS (
  SELECT part, filter_order, step, list_contains(fails, filter_order[step]) AS own, len(fails) AS k, good, toxic, n,
    len(list_filter(fails, lambda x: instr(filter_order, x) < step)) > 0 AS early
  FROM g, o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step::INT AS step,
    coalesce(sum(n) FILTER (NOT own AND NOT early), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (own AND NOT early), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND early), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (own AND k = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (own AND NOT early AND good = 1), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (own AND NOT early AND toxic = 1), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM r"""


SQL = _sql()
