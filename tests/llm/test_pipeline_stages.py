"""Single stages of the pipeline."""

import hashlib

import corpus_pipeline
from quarry.llm import bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_bpe_stage_decodes_too(spark, write):
    texts = ["Two words, and Ünïcode…", "", None, "tabs\tand\nlines  <3 日本"]
    sf = write("documents", [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.bpe_encode(spark, docs, sf)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"]
    path = bpe.tokenizer_path()
    want = {r.doc_id: r.decoded for r in bpe.decode_documents(out, path).collect()}
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.decoded_sha256 for k, r in got.items()} == {
        k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}
    assert want[0] and want[1] == want[2] == "" and got[0].n_tokens > 0


def table(spark, write, rows):
    schema = DOCS + ", ids string, epoch string, n_tokens string, key string, kept boolean, __pred string"
    return spark.read.parquet(write("documents", [(*r, "i", "e", "t", "k", None, "p") for r in rows], schema) + "/documents.parquet")


def good(seed, n=120):
    import random
    r = random.Random(seed)
    words = ["the", "of", "and", "to", "water", "house", "green", "stone", "river", "window", "paper", "bread", "cloud", "garden"]
    return " ".join(r.choice(words) + ("s" if r.random() < .3 else "") for _ in range(n))


def test_stages_on_nulls_repeats_long_texts_and_clashing_columns(spark, write):
    """Each of the first four stages keeps the columns, and rows as its docstring says."""
    long = " ".join(f"the river{k} of stone{k} and" for k in range(12_000))
    rows = [(k, good(k), "en", f"s{k % 3}", 1) for k in range(12)]
    rows += [(3, good(3), "en", "s0", 1), (None, good(50), None, None, None), (None, good(50), None, None, None), (20, None, "en", "s1", 0),
             (21, "", "en", "s1", 0), (22, " \n", None, None, None), (23, long, "en", "s2", 9), (24, good(4), "en", "s0", 1),
             (25, "123 456 " * 60, "en", "s0", 1)]
    docs = table(spark, write, rows)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    kept = {}
    for name in names[:4]:
        out = stages[name](spark, docs, "")
        assert out.columns == docs.columns or (name == "mixing" and sorted(out.columns) == sorted(c for c in docs.columns if c != "epoch")), name
        kept[name] = out.collect()
    ids = {n: sorted((r.doc_id for r in rs), key=repr) for n, rs in kept.items()}
    texts = {n: [r.text for r in rs] for n, rs in kept.items()}
    assert ids["quality rules"].count(3) == 2 and ids["quality rules"].count(None) == 2
    assert not {20, 21, 22} & set(ids["quality rules"]) and 23 in ids["quality rules"]
    assert not {20, 21, 22, 25} & set(ids["language id"]) and {0, 23} <= set(ids["language id"])
    assert ids["near dedup"].count(None) == 2 and ids["near dedup"].count(3) == 2 and 24 not in ids["near dedup"] and 4 in ids["near dedup"]
    assert {20, 21, 22} <= set(ids["near dedup"])  # without words: linked with nothing
    total = sum(len((r[1] or "").split()) for r in rows)
    assert sum(len((t or "").split()) for t in texts["mixing"]) <= total * corpus_pipeline.MIX.share_percent // 100
    last = stages[names[4]](spark, docs, "").collect()
    assert len(last) == len(rows) and all((r.n_tokens == 0) == (not (dict((x[0], x[1]) for x in rows)[r.doc_id] or "").strip()) for r in last)


def test_stages_on_empty_tables(spark, write):
    docs = table(spark, write, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name
