"""Text jobs over `documents`, `conversations`, `pages`,
`benchmark`, `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.text_features import lexicon_sentiment
from quarry.plans import fixtures as FX
from quarry.plans import sqlfrag as S
from quarry.plans.catalog import register
from quarry.sources.tables import Tables

_LEX_SQL = S.values(FX.LEXICON, ["word", "pol", "subj"])

_DOC_SENTIMENT_SQL = f"""
WITH toks AS (
  SELECT doc_id, lang, unnest({S.preprocess_tokens('text')}) AS w FROM documents
), hits AS (
  SELECT doc_id, count(*) AS n_hits, sum(pol) AS ps, sum(subj) AS ss
  FROM toks JOIN {_LEX_SQL} ON toks.w = t.word GROUP BY doc_id
), per_doc AS (
  SELECT d.doc_id, d.lang,
         coalesce(h.n_hits, 0)::BIGINT AS n_hits,
         coalesce(h.ps / (h.n_hits * 10.0), 0.0) AS polarity,
         coalesce(h.ss / (h.n_hits * 10.0), 0.0) AS subjectivity
  FROM documents d LEFT JOIN hits h USING (doc_id)
)
"""


def doc_sentiment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    docs = t.documents.select("doc_id", "lang", "text")
    out = lexicon_sentiment(docs, "doc_id", T.preprocess_tokens("text"), FX.LEXICON)
    return out.drop("text")


@register("lexicon_sentiment", sql=_DOC_SENTIMENT_SQL + """
SELECT doc_id, lang, n_hits, polarity, subjectivity,
       CASE WHEN polarity > 0 THEN 'Positive' WHEN polarity < 0 THEN 'Negative' ELSE 'Neutral' END AS label
FROM per_doc""")
def q_lexicon_sentiment(spark, sf_dir):
    return doc_sentiment(spark, sf_dir)


@register("sentiment_by_lang", sql=_DOC_SENTIMENT_SQL + f"""
SELECT lang, count(*) AS n_docs,
       count(*) FILTER (WHERE polarity > 0) AS n_positive,
       count(*) FILTER (WHERE polarity < 0) AS n_negative,
       count(*) FILTER (WHERE polarity = 0) AS n_neutral,
       {S.round_half_up('avg(polarity)', 6)} AS avg_polarity,
       {S.round_half_up('avg(subjectivity)', 6)} AS avg_subjectivity
FROM per_doc GROUP BY lang""")
def q_sentiment_by_lang(spark, sf_dir):
    """Flagship: tokens → stop words → lemmas → lexicon sentiment → label,
    summarised per language. One narrow stage per document plus a
    partial/final aggregate on `lang`."""
    d = doc_sentiment(spark, sf_dir)
    return d.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("label") == "Positive").alias("n_positive"),
        F.count_if(F.col("label") == "Negative").alias("n_negative"),
        F.count_if(F.col("label") == "Neutral").alias("n_neutral"),
        T.round_half_up(F.avg("polarity"), 6).alias("avg_polarity"),
        T.round_half_up(F.avg("subjectivity"), 6).alias("avg_subjectivity"),
    )


# ------------------------------------------------------------ scalar text

def _docs(spark, d):
    return Tables(spark, d).documents


@register("trim_lower", sql=f"SELECT doc_id, {S.trim_lower('text')} AS text FROM documents")
def q_trim_lower(spark, d):
    return _docs(spark, d).select("doc_id", T.trim_lower("text").alias("text"))


@register("clean_text", sql=f"SELECT doc_id, {S.clean_text('text')} AS text FROM documents")
def q_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", T.clean_text("text").alias("text"))


@register("normalize_tokens", sql=f"SELECT doc_id, {S.normalize_tokens('text')} AS tokens FROM documents")
def q_normalize_tokens(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_tokens("text").alias("tokens"))


@register("stopword_filter", sql=f"SELECT doc_id, {S.stopword_filter(S.normalize_tokens('text'))} AS tokens FROM documents")
def q_stopword_filter(spark, d):
    return _docs(spark, d).select("doc_id", T.stopword_filter(T.normalize_tokens("text")).alias("tokens"))


@register("suffix_lemmatize", sql=f"SELECT doc_id, {S.preprocess_tokens('text')} AS tokens FROM documents")
def q_suffix_lemmatize(spark, d):
    return _docs(spark, d).select("doc_id", T.preprocess_tokens("text").alias("tokens"))


def _seq_replace_sql(e, rules):
    for a, b in rules:
        e = f"replace({e}, {S.q(a)}, {S.q(b)})"
    return e


@register("synonym_rewrite", sql=f"SELECT doc_id, {_seq_replace_sql('text', FX.DOC_SYNONYMS)} AS text FROM documents")
def q_synonym_rewrite(spark, d):
    return _docs(spark, d).select("doc_id", T.synonym_rewrite("text", FX.DOC_SYNONYMS).alias("text"))


_ITEM_COLS = [f"Item_{k}" for k in range(1, FX.WIDE_SLOTS + 1)]


@register("concat_nonblank", sql=f"""
SELECT l_orderkey, sheet, array_to_string(list_filter(list_transform([{', '.join(_ITEM_COLS)}], lambda x: {S.strip_ws('x')}),
       lambda x: x IS NOT NULL AND x <> ''), ' ') AS text FROM ({FX.WIDE_ITEMS_SQL})""")
def concat_nonblank(spark, d):
    """Trimmed non-blank values of the Item_ columns, space-joined — one
    array expression per row, no per-row Python."""
    wide = FX.wide_items(Tables(spark, d))
    arr = F.array(*[F.col(c) for c in wide.columns if c.startswith("Item_")])
    vals = F.filter(F.transform(arr, lambda x: T.strip_ws(x)), lambda x: x.isNotNull() & (x != ""))
    return wide.select("l_orderkey", "sheet", F.array_join(vals, " ").alias("text"))


@register("append_with_separator", sql="""
SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def append_with_separator(spark, d):
    """Running 'a, b, c' append per conversation, ordered by turn."""
    c = Tables(spark, d).conversations
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), ", ").alias("roles"))


@register("capitalise_first", sql="SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS name FROM part")
def capitalise_first(spark, d):
    return Tables(spark, d).part.select("p_partkey", T.capitalise_first("p_name").alias("name"))


@register("number_format", sql="""
SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS total,
       format('{:,.1f}', floor(o_totalprice / 1000.0 * 10 + 0.5) / 10) || 'k' AS total_k,
       format('{:.1f}', floor(o_totalprice / 5000.0 * 100 * 10.0 + 0.5) / 10.0) || '%' AS pct
FROM orders""")
def number_format(spark, d):
    """Fixed decimals with thousands separators and a percent form. Values
    are rounded half-up first, so formatting never has to break a tie."""
    o = Tables(spark, d).orders
    x = F.col("o_totalprice")
    return o.select(
        "o_orderkey", F.format_number(x, 2).alias("total"),
        F.concat(F.format_number(T.round_half_up(x / 1000.0, 1), 1), F.lit("k")).alias("total_k"),
        F.concat(F.format_string("%.1f", T.round_half_up(x / 5000.0 * 100, 1)), F.lit("%")).alias("pct"))


@register("html_escape", sql="SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def q_html_escape(spark, d):
    return Tables(spark, d).pages.select("page_id", T.html_escape("html").alias("html"))


@register("markup_rewrite", sql="""
SELECT doc_id, regexp_replace(regexp_replace(replace(text, ',', '**'), '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g'),
       '\n', '<br>', 'g') AS html FROM documents""")
def q_markup_rewrite(spark, d):
    """Markdown-ish bold and line breaks; the bold markers are built from the
    document commas."""
    docs = _docs(spark, d)
    return docs.select("doc_id", T.markup_rewrite(F.replace("text", F.lit(","), F.lit("**"))).alias("html"))


@register("pattern_rewrite", sql="""
SELECT page_id, regexp_replace(url, '^(https?)://([^/]+)/([a-z]+)/', 'site:\\2|lang:\\3|', 'g') AS url FROM pages""")
def pattern_rewrite(spark, d):
    p = Tables(spark, d).pages
    return p.select("page_id", F.regexp_replace("url", "^(https?)://([^/]+)/([a-z]+)/", "site:$2|lang:$3|").alias("url"))


@register("message_template", sql="""
SELECT event_id, 'User ' || CAST(user_id AS VARCHAR) || ' did ' || event_type || ' at ' || strftime(ts, '%H:%M:%S')
       || ' (' || CAST(value AS VARCHAR) || ')' AS message FROM events""")
def message_template(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", F.format_string("User %d did %s at %s (%s)", "user_id", "event_type",
                                                F.date_format("ts", "HH:mm:ss"), F.col("value").cast("string")).alias("message"))


@register("time_format", sql="SELECT event_id, strftime(ts, '%H:%M:%S') AS clock FROM events")
def time_format(spark, d):
    return Tables(spark, d).events.select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))


@register("date_param_filter", sql="""
SELECT event_id, user_id, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def date_param_filter(spark, d, day: str | None = None):
    """Rows of one day; default is the latest day present (deterministic
    stand-in for 'today'). The day is a literal in the filter, so it is
    pushed to the scan as a range on ts."""
    e = Tables(spark, d).events
    if day is None:
        day = e.agg(F.max(F.to_date("ts"))).first()[0]  # one value
    lo = F.lit(day).cast("timestamp_ntz")
    hi = F.date_add(F.lit(day), 1).cast("timestamp_ntz")
    return e.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", "user_id", "event_type")
