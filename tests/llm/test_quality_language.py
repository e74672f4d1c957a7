"""Operators 5 and 6 on odd rows, and held-out accuracy."""

import re
import zlib

import numpy as np

from quarry.llm import language, quality

DOCS = "doc_id long, text string, lang string, source string, n_words string, lang_pred string, score int"


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    cover = {j for i, x in enumerate(tri) if tri.count(x) > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))


TEXTS = [None, "", " \n\t ", "one", "a b c a b c a b c", "x\ny\nx\n x\nx", "é ü | # ***\n漢字 & ok",
         "w " * 60, " ".join(f"the{i} and" for i in range(300)), "\n".join(["same line of the text"] * 30),
         "a b c d " * 3 + " ".join(f"q{i}" for i in range(4000)) + " a b c", "word\u00a0with\u2003odd spaces"]


def test_op6_counts_against_brute_force(spark, write):
    rows = [(i, t, None, None, "clash", "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "one", None, None, None, None, None)]
    got = sorted(quality.op6_quality_rules(spark, write("documents", rows, DOCS)).collect(), key=lambda r: r.doc_id)
    for r in got:
        want = counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, TEXTS[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    assert len(got) == len(rows)


def test_op6_filter_keeps_columns_and_clean_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS n_words", "text AS kept")
    got = quality.filter_documents(docs)
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    want = {r.doc_id for r in quality.op6_quality_rules(spark, sf).filter("kept").collect()}
    assert ids == want and len(ids) > 100


def test_op6_empty_table(spark, write):
    assert quality.op6_quality_rules(spark, write("documents", [], DOCS)).count() == 0


def test_gradients_against_differences():
    net = language.ByteGRU.fresh(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    segments, labels = [b"abc", b"xy", b"q"], np.array([0, 1, 1])
    m, sizes = language.pad(segments)

    def loss():
        probs, inside, *_ = net.position_probabilities(m, sizes)
        picked = probs[:, np.arange(3), labels]
        return -(np.log(picked) * inside).sum() / inside.sum()

    # One step of training by hand: the same gradient that fit() uses.
    grads = {}
    tapes = ([], [])
    probs, inside, f, b, turn, cols = net.position_probabilities(m, sizes, tapes)
    g = probs.copy()
    g[:, np.arange(3), labels] -= 1
    g *= inside[:, :, None] / inside.sum()
    gb = np.zeros_like(b)
    np.add.at(gb, (turn, np.broadcast_to(cols, turn.shape)), (g @ net.p["vb"].T) * inside[:, :, None])
    net._unscan(m, tapes[0], g @ net.p["vf"].T, "f", grads)
    net._unscan(language.mirrored(m, sizes), tapes[1], gb, "b", grads)
    for name, at in (("uf", (1, 2)), ("ub", (0, 7)), ("xf", (ord("b"), 4)), ("xb", (ord("x"), 1)), ("xf", (ord("q"), 8))):
        eps = 1e-3
        net.p[name][at] += eps
        up = loss()
        net.p[name][at] -= 2 * eps
        down = loss()
        net.p[name][at] += eps
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 2e-3, name


def test_op5_held_out_accuracy_and_split(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = language.op5_byte_gru_language(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_op5_odd_rows(spark, write):
    en, de = "the and of that with this from " * 20, "der und nicht die auch von eine " * 20
    rows = [(i, en if i % 2 else de, "en" if i % 2 else "de", "s", None, "x", 1) for i in range(40)]
    rows += [(100, None, "en", None, None, None, None), (101, "12 34 !!", None, None, None, None, None),
             (102, "", "de", None, None, None, None), (None, en, None, None, None, None, None),
             (103, "q" * 5000 + " " + en, None, None, None, None, None)]
    got = {r.doc_id: r for r in language.op5_byte_gru_language(spark, write("documents", rows, DOCS)).collect()}
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[101].score == 0
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and got[None].lang_pred == "en"
    df = spark.read.parquet(write("documents", rows, DOCS) + "/documents.parquet")
    kept = language.filter_documents(df)
    assert kept.columns == df.columns and not {100, 101, 102} & {r.doc_id for r in kept.collect()}


def test_op5_without_labels_or_rows(spark, write):
    got = language.op5_byte_gru_language(spark, write("documents", [(1, "some text", None, None, None, None, None)], DOCS))
    assert [(r.lang_pred, r.score) for r in got.collect()] == [("und", 0.0)]
    assert language.op5_byte_gru_language(spark, write("documents", [], DOCS)).count() == 0


def test_pooling_is_the_same_word_by_word():
    net = language.ByteGRU.fresh(["a", "b", "c"])
    ts = ["some words here", "other words", "here some " + "z" * 200]
    together = language.Pooler(net).predict(ts)
    for t, want in zip(ts, together):
        p = language.Pooler(net).predict([t])[0]
        assert p[0] == want[0] and abs(p[1] - want[1]) < 1e-5
