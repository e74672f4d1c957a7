"""A training corpus from raw documents, in five stages.

Every stage takes the table that the one before wrote (its columns are those
of ``documents``) and keeps or drops whole documents; the last turns the
texts that are left into token ids. ``run`` writes each stage's result below
the shared checkpoint folder and reads it back, so a lost executor costs the
running stage only.

Defined results, for all stages: texts count whole, however long; an empty
table gives an empty result with the stage's columns; further columns pass
through the first four stages untouched whatever their names, and the last
keeps its own six. Rows that repeat an id are documents of their own in the
first two stages; near-dedup keeps or drops them together, the mix takes them
together. Stage by stage:

* quality rules: a null, empty or blank text has no words and is dropped.
* language id: a null text, or one without a letter, is ``und`` and dropped;
  ``lang`` only teaches (null: it doesn't) and is never changed. Ties between
  languages go to the one that sorts first.
* near dedup: rows without an id stay; of a component the least id stays, with
  all its rows; texts without words are linked with nothing.
* mixing: a null language or source is the leaf ``und``; texts without words
  cost nothing; rows without an id share a place in the order.
* bpe: a null or blank text has no ids (``n_tokens`` 0) and decodes to the
  empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, language, mixing, neardup, quality
from quarry.llm.common import prepare, read, stored

# Each document is seen once: what a leaf lacks goes to its siblings.
MIX = mixing.Mix(epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table (operator 6)."""
    prepare(spark)
    return quality.filter_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network, trained on them, is sure of (operator 5)."""
    prepare(spark)
    return language.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component (operator 7)."""
    prepare(spark)
    return neardup.filter_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the weighted mix (operator 1)."""
    prepare(spark)
    return mixing.select_mix(docs, MIX).drop("epoch")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the chosen documents, and the digest of the text they decode to (operator 2)."""
    prepare(spark)
    out = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), bpe.tokenizer_path(), decoded=True)
    return out.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("text", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near dedup", near_dedup),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

# The language and encoding stages cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
