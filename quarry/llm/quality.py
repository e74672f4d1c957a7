"""Operator 6, quality rules: a threshold table compiled into one projection.

``measures`` derives the counts of a text with array functions only,
``compile_rules`` turns the rows of ``RULES`` into one boolean column. All
comparisons are between integers (a ratio ``a/b > p/100`` is written as
``100*a > p*b``), so no rounding decides a document.

Defined results: a null or blank text has no words, every count is 0 and it
fails the base rule (fewer than 50 words). A line made of white space is not
a line with a word. Texts of any length are counted whole; a null id is passed
on like any other. Repeated rows give repeated results. Columns other than
the id and the text are ignored by the query and kept by ``filter_documents``,
whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, words

# Very frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht", "ein",
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "es", "al", "lo",
)

# (rule, numerator, comparison, percent, denominator): a document fails a rule
# when 100 * numerator <comparison> percent * denominator holds.
RULES = (
    ("words_too_short", "word_chars", "<", 200, "n_words"),
    ("words_too_long", "word_chars", ">", 1200, "n_words"),
    ("too_many_symbols", "n_symbols", ">", 10, "n_words"),
    ("too_few_stop_words", "n_stop_words", "<", 2, "n_words"),
    ("too_many_repeated_lines", "n_dup_lines", ">", 50, "n_lines"),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the count columns (each named ``prefix + name``) to ``df``.

    The words in repeated 3-word windows are counted per row: windows are
    hashed, the hashes sorted, equal neighbours mark the positions of
    repeated windows, and the union of [p, p+2] over these is measured.
    Only rows with an equal pair of hashes pay for the sort of positions.
    """
    keep = [F.col(f"`{c}`") for c in df.columns]
    w, h, s, ln, t = (f"__q_{x}" for x in ("w", "h", "s", "l", "t"))
    size = F.size(w)
    d = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    d = d.select(*keep, t, words(F.col(t)).alias(w),
                 F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias(ln))
    window = F.transform(F.sequence(F.lit(0), size - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    d = d.select(*keep, t, w, ln, F.when(size >= 3, window).otherwise(F.array().cast("array<bigint>")).alias(h))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    d = d.select(*keep, t, w, ln, F.when(F.size(F.array_distinct(h)) < F.size(h), placed).otherwise(none).alias(s))
    equal = F.filter(
        s, lambda x, i: F.get(s, i - 1)["x"].eqNullSafe(x["x"]) | F.get(s, i + 1)["x"].eqNullSafe(x["x"]))
    positions = F.sort_array(F.transform(equal, lambda x: x["i"]))
    covered = F.aggregate(
        positions, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["total"] + (p + 3 - F.greatest(p, a["end"]))).alias("total")),
        lambda a: a["total"])
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))
    stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))
    out = {"n_words": size, "word_chars": F.length(F.array_join(w, "")), "n_symbols": symbols,
           "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)), "n_repeat_words": covered,
           "n_stop_words": stops, "n_lines": F.size(ln)}
    # The counts come out of a generator: a later filter on them would otherwise be
    # pushed below these projections, with all that they compute copied into it.
    counts = F.struct(*[c.cast("long").alias(k) for k, c in out.items()])
    d = d.select(*keep, F.explode_outer(F.array(counts)).alias("__q_c"))
    return d.select(*keep, *[F.col(f"__q_c.{k}").alias(prefix + k) for k in out])


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def compile_rules(rules=RULES, prefix: str = "") -> Column:
    """True when no rule of the table is broken."""
    broken = F.lit(False)
    for _name, num, op, percent, den in rules:
        a, b = 100 * F.col(prefix + num), percent * F.col(prefix + den)
        broken = broken | ((a > b) if op == ">" else (a < b))
    return ~broken


def filter_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df``, with its columns, that pass the base rule and the table."""
    p = "__m_"
    keep = [F.col(f"`{c}`") for c in df.columns]
    return measures(df, text, prefix=p).filter(~base_failed(p) & compile_rules(prefix=p)).select(*keep)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    d = measures(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *COUNTS, base_failed().alias("base_failed"),
                    (~base_failed() & compile_rules()).alias("kept"))


def _sql() -> str:
    ws = r"'[\x20\x09-\x0D]+'"
    fails = " OR ".join(f"100 * {n} {op} {p} * {d}" for _, n, op, p, d in RULES)
    stops = ", ".join(f"'{s}'" for s in STOP_WORDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, {ws}), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(l) AS n_lines
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_stop_words::BIGINT AS n_stop_words, n_lines::BIGINT AS n_lines,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR {fails}) AS kept
FROM m"""


SQL = _sql()
