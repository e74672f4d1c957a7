"""Vector and text-feature jobs: exact kNN, n-grams, TF-IDF, hashing
embeddings, text search (SURVEY §2.3 vector_knn_join, §2.5 rank_hits,
§2.6 knn_topk, §2.8 token_ngrams … text_search)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import postings as PO
from quarry.operators import text_features as TF
from quarry.operators import vectors as V
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.sources import files as FS
from quarry.sources.tables import Tables

K = 5
R = T.round_half_up
RS = S.round_half_up

_DIST_SQL = ("list_sum(list_transform(range(1, len(q.embedding) + 1), "
             "lambda i: (q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))")

_KNN_SQL = f"""
WITH d AS (SELECT q.vec_id AS query_id, b.vec_id, {_DIST_SQL} AS dist FROM embeddings q, embeddings b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(dist * 1e9 + 0.5) / 1e9, vec_id) AS rn FROM d)"""


def embedding_knn(spark, d):
    """Every embedding as a query against all embeddings (exact squared L2):
    one stored result that the three queries on it share."""
    def search():
        t = Tables(spark, d).embeddings
        return V.knn_topk(t.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")),
                          t.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), k=K)

    return FS.once_per_input(spark, f"{d.rstrip('/')}/embeddings.parquet", f"knn-{K}", search)


@register("knn_topk", sql=_KNN_SQL + f"""
SELECT query_id, rn::BIGINT AS rank, vec_id, {RS('dist', 4)} AS distance FROM r WHERE rn <= {K}""")
def knn_topk(spark, d):
    r = embedding_knn(spark, d)
    return r.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("vec_id"),
                    R("dist", 4).alias("distance"))


@register("vector_knn_join", sql=_KNN_SQL + f"""
SELECT query_id, r.vec_id, {RS('dist', 4)} AS distance, eq.label AS query_label, eb.label AS hit_label
FROM r JOIN embeddings eq ON eq.vec_id = query_id JOIN embeddings eb ON eb.vec_id = r.vec_id WHERE rn <= {K}""")
def vector_knn_join(spark, d):
    """kNN join carrying fields of both sides (labels joined back by key)."""
    e = Tables(spark, d).embeddings.select("vec_id", "label")
    r = embedding_knn(spark, d)
    return (r.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("query_label")), "qid")
            .join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("hit_label")), "id")
            .select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"),
                    R("dist", 4).alias("distance"), "query_label", "hit_label"))


@register("rank_hits", sql=_KNN_SQL + f"""
SELECT query_id, rn::BIGINT AS rank, (eq.label = eb.label) AS same_label
FROM r JOIN embeddings eq ON eq.vec_id = query_id JOIN embeddings eb ON eb.vec_id = r.vec_id WHERE rn <= {K}""")
def rank_hits(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "label")
    r = embedding_knn(spark, d)
    j = (r.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), "qid")
         .join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("hl")), "id"))
    return j.select(F.col("qid").alias("query_id"), "rank", (F.col("ql") == F.col("hl")).alias("same_label"))


# ------------------------------------------------------------- text features

def _ngrams_sql(t: str) -> str:
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


@register("token_ngrams", sql=f"""
SELECT doc_id, {_ngrams_sql('t')} AS grams FROM (SELECT doc_id, {S.preprocess_tokens('text')} AS t FROM documents)""")
def token_ngrams(spark, d):
    docs = Tables(spark, d).documents
    return TF.with_ngrams(docs.select("doc_id", "text"), T.preprocess_tokens("text"), "grams").select("doc_id", "grams")


MIN_DF, MAX_FEATURES = 2, 2000


def doc_tfidf(spark, d):
    docs = TF.with_ngrams(Tables(spark, d).documents.select("doc_id", "text"), T.preprocess_tokens("text"))
    return TF.tfidf_long(docs.select("doc_id", "terms"), "doc_id", F.col("terms"), MIN_DF, MAX_FEATURES)


_TFIDF_CTE = f"""
docs AS (SELECT doc_id, {_ngrams_sql('t')} AS terms FROM (SELECT doc_id, {S.preprocess_tokens('text')} AS t FROM documents)),
nd AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1),
vocab AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (
          SELECT term, df FROM st WHERE df >= {MIN_DF} ORDER BY cf DESC, term LIMIT {MAX_FEATURES}), nd),
w0 AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN vocab USING (term)),
w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


@register("tfidf_features", sql=f"WITH {_TFIDF_CTE} SELECT doc_id, term, {RS('weight', 6)} AS weight FROM w")
def tfidf_features(spark, d):
    long, _ = doc_tfidf(spark, d)
    return long.select("doc_id", "term", R("weight", 6).alias("weight"))


@register("text_hash_embedding", sql=f"""
WITH t AS (SELECT doc_id, unnest({S.preprocess_tokens(S.clean_text('text'))}) AS t FROM documents),
c AS (SELECT doc_id, (('0x' || substring(md5(t), 1, 7))::BIGINT % 256)::INTEGER AS slot, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, slot, {RS('n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)::DOUBLE)', 6)} AS weight FROM c""")
def text_hash_embedding(spark, d):
    """Substitute sentence encoder: hashed, L2-normalised token vector per document."""
    docs = Tables(spark, d).documents.select("doc_id", T.preprocess_tokens(T.clean_text("text")).alias("toks"))
    return TF.hash_embedding(docs, "doc_id", "toks").withColumn("weight", R("weight", 6))


_QUERY_TERMS = f"{_ngrams_sql('t')}"


@register("text_search", sql=f"""
WITH {_TFIDF_CTE},
qd AS (SELECT item_id, {_ngrams_sql('t')} AS terms FROM (
       SELECT item_id, {S.preprocess_tokens(S.clean_text('text'))} AS t FROM benchmark)),
qtf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(terms) AS term FROM qd) GROUP BY 1, 2),
qw0 AS (SELECT item_id, term, (1 + ln(tf)) * idf AS raw FROM qtf JOIN vocab USING (term)),
qw AS (SELECT item_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS weight FROM qw0),
dots AS (SELECT item_id, doc_id, sum(qw.weight * w.weight) AS dot FROM qw JOIN w USING (term) GROUP BY 1, 2),
alld AS (SELECT b.item_id, d.doc_id, d.lang, 2.0 - 2.0 * coalesce(dots.dot, 0.0) AS dist
         FROM benchmark b CROSS JOIN documents d LEFT JOIN dots ON dots.item_id = b.item_id AND dots.doc_id = d.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY floor(dist * 1e9 + 0.5) / 1e9, doc_id) AS rn FROM alld)
SELECT item_id AS query_id, rn::BIGINT AS rank, doc_id, lang, {RS('dist', 4)} AS distance FROM r WHERE rn <= {K}""")
def text_search(spark, d):
    """Query texts → same cleaning and TF-IDF (document vocabulary and idf)
    → exact top-k by squared distance of unit vectors over the inverted index
    → source fields joined back."""
    t = Tables(spark, d)
    long, vocab = doc_tfidf(spark, d)
    base = long.select(F.col("doc_id").alias("id"), "term", F.col("weight").alias("w"))
    qtok = TF.with_ngrams(t.benchmark.select(F.col("item_id").alias("qid"), "text"),
                          T.preprocess_tokens(T.clean_text("text"))).select("qid", "terms")
    queries = TF.tfidf_apply(qtok, "qid", F.col("terms"), vocab).select("qid", "term", F.col("weight").alias("q"))
    hits = PO.topk_unit(queries, base, t.benchmark.select(F.col("item_id").alias("qid")),
                        t.documents.select(F.col("doc_id").alias("id")), K)
    docs = t.documents.select(F.col("doc_id").alias("id"), "lang")
    return hits.join(docs, "id").select(F.col("qid").alias("query_id"), "rank", F.col("id").alias("doc_id"),
                                        "lang", R("dist", 4).alias("distance"))
