"""Small literal tables of our own and fixtures derived from the benchmark
tables. Literal tables are lookups (bounded, broadcast); every job's work
still comes from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Own sentiment lexicon, drawn from frequent tokens of `documents` after
# preprocessing: (word, polarity in tenths, subjectivity in tenths).
LEXICON = (
    ("eau", 5, 6), ("elle", 3, 4), ("ment", -2, 5), ("tre", 4, 7),
    ("orre", -6, 8), ("rewh", -3, 2), ("thatin", 2, 3), ("ononst", -4, 6),
    ("inoran", 6, 9), ("hehely", -8, 7), ("oran", 1, 1), ("sch", -5, 5),
    ("ble", 7, 8), ("ver", 3, 2), ("thon", -1, 3), ("ung", -7, 6),
    ("nci", 2, 5), ("ther", 4, 4), ("est", 1, 2), ("sich", -2, 1),
)

# Own intent rules for `conversations` (priority, intent, keywords), first
# match by priority wins; substring semantics as in the routed chat.
INTENT_RULES = (
    (1, "greeting", ("hello", "bonjour", "hola", "hallo")),
    (2, "thanks", ("thanks", "merci", "gracias", "danke")),
    (3, "question_that", ("that",)),
    (4, "french", ("que", "les", "eau")),
    (5, "german", ("der", "die", "und")),
    (6, "spanish", ("los", "del", "nci")),
    (7, "english", ("the", "and", "with")),
)
INTENT_DEFAULT = "other"

# Own canned replies per intent (several texts → deterministic pick).
REPLIES = (
    ("greeting", ("Hello there.", "Welcome back.")),
    ("thanks", ("You are welcome.",)),
    ("question_that", ("Let me check that.", "Good question.", "One moment.")),
    ("french", ("Réponse en français.",)),
    ("german", ("Antwort auf Deutsch.", "Gern geschehen.")),
    ("spanish", ("Respuesta en español.",)),
    ("english", ("Answer in English.", "Here is what I found.")),
    ("other", ("Sorry, I did not catch that.", "Could you rephrase?")),
)

# Own phrase rewrites for the synonym operator on `documents`.
DOC_SYNONYMS = (
    ("the", "teh"), ("teh and", "and-the"), ("que", "QUE"), ("der", "DER"),
    ("eau", "water"), ("water", "H2O"), ("tion", "sion"),
)


def lexicon_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), "word string, pol int, subj int")


def intent_rules_df(spark: SparkSession) -> DataFrame:
    rows = [(p, i, k) for p, i, ks in INTENT_RULES for k in ks]
    return spark.createDataFrame(rows, "priority int, intent string, keyword string")


def replies_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, list(t)) for i, t in REPLIES],
                                 "intent string, texts array<string>")


# ---------------------------------------------------------------------------
# Derived fixtures: same definition in Spark and in SQL (CTE bodies).
# ---------------------------------------------------------------------------

WIDE_SLOTS = 7


def wide_items(t) -> DataFrame:
    """Wide rows of WIDE_SLOTS items: an order's lines in the order of
    (l_linenumber, l_partkey), WIDE_SLOTS to a row; ``sheet`` numbers an order's
    rows from 0, so no line is left out however many an order has."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    li = t.lineitem.select("l_orderkey", "l_partkey", (F.row_number().over(w) - 1).alias("n"))
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return (li.join(p, "l_partkey")
            .groupBy("l_orderkey", F.expr(f"CAST(n DIV {WIDE_SLOTS} AS int)").alias("sheet"))
            .agg(*[F.max(F.when(F.col("n") % WIDE_SLOTS == k - 1, F.col("p_name"))).alias(f"Item_{k}")
                   for k in range(1, WIDE_SLOTS + 1)]))


WIDE_ITEMS_SQL = (
    f"SELECT l_orderkey, (n // {WIDE_SLOTS})::INTEGER AS sheet, "
    + ", ".join(f"max(p_name) FILTER (WHERE n % {WIDE_SLOTS} = {k - 1}) AS Item_{k}" for k in range(1, WIDE_SLOTS + 1))
    + " FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1"
    " AS n FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
)


def null_part(t) -> DataFrame:
    p = t.part
    return p.select(
        "p_partkey", "p_name",
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("p_brand"),
        "p_type",
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
        "p_retailprice")


NULL_PART_SQL = ("SELECT p_partkey, p_name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand, "
                 "p_type, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice FROM part")


def size_lookup(t) -> DataFrame:
    """name → weight lookup with duplicate names (last row by p_partkey wins),
    built from the parts of size <= 25 not named red..., so some names
    miss (→ default)."""
    return (t.part.filter((F.col("p_size") <= 25) & ~F.col("p_name").startswith("red"))
            .groupBy(F.col("p_name").alias("name"))
            .agg(F.max_by("p_size", "p_partkey").alias("weight")))


SIZE_LOOKUP_SQL = "SELECT p_name AS name, arg_max(p_size, p_partkey) AS weight FROM part WHERE p_size <= 25 AND NOT starts_with(p_name, 'red') GROUP BY p_name"


def predicted_labels(t) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    return (t.labels.join(d, "doc_id")
            .select("doc_id", F.col("quality").alias("actual"),
                    (F.col("n_chars") >= 1000).cast("int").alias("predicted")))


PREDICTED_LABELS_SQL = ("SELECT doc_id, quality AS actual, (n_chars >= 1000)::INTEGER AS predicted "
                        "FROM labels JOIN documents USING (doc_id)")
