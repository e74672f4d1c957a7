"""Operators 11 to 13 against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import attention_quality as aq
from quarry.llm import filter_audit, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, part string, n int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    s = None if v is None else str(v)
    return "-" if s is None else f"{len(s.encode())}:{s}"


def tree(nodes):
    """All levels, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i: i + 2])) for i in range(0, len(last), 2)])
    return levels


def way(levels, at):
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append(("l" if at & 1 else "r", level[other]) if other < len(level) else ("-", ""))
        at >>= 1
    return out


def merkle_rows(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    def leaf(d, t, lang, src, n):
        return sha("".join(map(field, (d, src, lang, n, t))))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for g, k in enumerate(keys):
        for at, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = way(trees[k], at) + way(top, g)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r[0], r[1], r[2], r[3], None if r[4] is None else r[4] + 1) if tampered else own
            for side, sib in path:
                node = sha(sib + node if side == "l" else node + sib)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], sha("".join(s for _, s in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def odd_rows(n, seed):
    r = random.Random(seed)
    langs = [None, "", "en", "én", "zh", "en"]
    rows = [(r.choice([None, k, k % 9, -k]), r.choice([None, "", "a b", "é漢 " * 30, "x" * 5000]), r.choice(langs),
             r.choice([None, "", "s:1"]), r.choice([None, k])) for k in range(n)]
    return rows + rows[:5]


@pytest.mark.parametrize("bits, n", [(6, 300), (1, 60), (2, 5), (6, 1), (3, 64)])
def test_op11_against_brute_force(spark, write, monkeypatch, bits, n):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = odd_rows(n, bits)
    sf = write("documents", [(d, t, lang, s, c, "k", "n", "p", 1) for d, t, lang, s, c in rows], DOCS)
    got = merkle.op11_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = merkle_rows(rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    if n == 300:
        assert {w[-1] for w in want} == {True, False}


def test_op11_one_hot_group_and_an_id_of_many_rows(spark, write):
    rows = [(7 if k % 3 else k, f"t{k}", "en", "s", k) for k in range(500)]
    sf = write("documents", [(*r, None, None, None, None) for r in rows], DOCS)
    assert sorted((tuple(r) for r in merkle.op11_merkle_manifest(spark, sf).collect()), key=repr) == merkle_rows(rows)


def test_op11_empty_table(spark, write):
    assert merkle.op11_merkle_manifest(spark, write("documents", [], DOCS)).count() == 0


def audit_rows(docs, labels):
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    facts = []
    for d, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        mine = [x for x in labels if x[0] == d and d is not None]
        facts.append((lang or "", {f for f, b in bad.items() if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {f[0] for f in facts}:
        here = [f for f in facts if f[0] == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = here
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = [x for x in here if f in x[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone),
                            sum(x[1] == {f} for x in here), sum(x[2] for x in gone), sum(x[3] for x in gone)])
        for row in out:
            if row[0] == part:
                row[9:] = [removed[row[1][row[2] - 1]]]
    return sorted(map(tuple, out))


@pytest.mark.parametrize("copies", [1000, 2])
def test_op13_against_brute_force(spark, write, monkeypatch, copies):
    monkeypatch.setattr(filter_audit, "COPIES", copies)
    r = random.Random(4)
    good = " ".join(f"w{k}" for k in range(220))
    texts = [None, "", " \n", good, good + " W#", good.upper(), "a " * 300, "x", "é漢 " * 250, "Long" + " y" * 30_000, good + "|"]
    docs = [(r.choice([None, k, k % 11, -k]), r.choice(texts), r.choice([None, "", "en", "de"])) for k in range(150)]
    docs += docs[:6]
    labels = [(r.randrange(-20, 60), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(80)] + [(None, 1, 1)]
    sf = write("documents", [(d, t, lang, "s", 1, "k", "n", "p", 5) for d, t, lang in docs], DOCS)
    write("labels", labels, "doc_id long, quality int, toxic int")
    got = filter_audit.op13_filter_audit(spark, sf)
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == cols and dict(got.dtypes)["step"] == "int"
    assert sorted(tuple(x) for x in got.collect()) == audit_rows(docs, labels)


def test_op13_empty_tables(spark, write):
    sf = write("documents", [], DOCS)
    write("labels", [], "doc_id long, quality int, toxic int")
    assert filter_audit.op13_filter_audit(spark, sf).count() == 0


def test_op12_gradients():
    r = np.random.default_rng(1)
    x = r.normal(size=(17, 9))
    begins, y = np.array([0, 1, 6, 17]), np.array([1.0, 0.0, 1.0])
    net = aq.Network.fresh(x, seed=3)
    _, grads = net.loss_and_gradients(x, begins, y)
    for k, w in net.weights.items():
        for at in [tuple(int(r.integers(0, n)) for n in w.shape) for _ in range(5)]:
            before, step = w[at], 1e-6
            w[at] = before + step
            up, _ = net.loss_and_gradients(x, begins, y)
            w[at] = before - step
            down, _ = net.loss_and_gradients(x, begins, y)
            w[at] = before
            assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-5 * max(1, abs(grads[k][at]))


def test_op12_measures_of_a_passage():
    x = aq.passages("The the THE, !! 12 é\nx x")
    share = dict(zip(range(9), x[0, :9]))
    size = len("The the THE, !! 12 é\nx x".encode())
    assert len(x) == 1
    assert np.isclose(share[4], 4 / size) and np.isclose(share[5], 2 / size) and np.isclose(share[8], 2 / size)
    assert np.isclose(x[0, 9], np.log1p(8)) and np.isclose(x[0, 14], 7 / 8) and np.isclose(x[0, 15], 1 / 8)
    assert np.isclose(x[0, 12], 1 / 8)  # THE, is all capitals
    assert len(aq.passages("w " * 129)) == 3 and not aq.passages(None).any() and aq.passages(" \n").shape == aq.passages("").shape
    long = aq.passages("w " * 5000, most=10)
    assert len(long) == 10


def test_op12_long_texts_by_pieces(monkeypatch):
    """What a text scores doesn't depend on how many pieces carry the sums."""
    r = random.Random(2)
    docs = [" ".join(r.choice(["a", "B!", "ccc", "#"]) for _ in range(n)) for n in (10, 700, 64 * 40)]
    net = aq.Network.fresh(np.concatenate([aq.passages(t) for t in docs]))
    whole = net.score(docs)
    raw = docs[2].encode()
    top, n, s = net.pooled(*aq._measured([raw]))
    assert np.isclose(net._scores(n, s)[0], whole[2])
    monkeypatch.setattr(aq, "PIECE", 300)
    cut = [aq._measured([p])[0] for p in aq._pieces(raw)]
    x = np.concatenate(cut)
    top, n, s = net.pooled(x, np.array([0, len(x)]))
    assert np.isclose(net.score_long(raw), net._scores(n, s)[0])
    assert b"".join(aq._pieces(raw)) == raw


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op12_learns_and_leaves_the_held_out_rows_alone(spark, write):
    r = random.Random(6)
    docs, labels = [], []
    for d in range(400):
        bad = d % 3 == 0
        w = [r.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(r.randint(80, 400))]
        if bad:  # only some passages show it
            at = r.randrange(len(w) - 60)
            w[at: at + 60] = [x.upper() + "!!" for x in w[at: at + 60]]
        docs.append((d, " ".join(w), "en", "s", 1, "k", "n", "p", 1))
        labels.append((d, (0 if bad else 1) if not held(d) else r.randint(0, 1), 0))
    docs += [(900, None, None, None, None, None, None, None, None), (901, "", "", "", 0, "", "", "", 0),
             (902, " \t", "", "", 0, "", "", "", 0), (None, "x " * 40_000, None, None, None, None, None, None, None), docs[3]]
    labels += [(None, 1, 0), (5000, 0, 0), (3, None, 0)]
    sf = write("documents", docs, DOCS)
    write("labels", labels, "doc_id long, quality int, toxic int")
    got = aq.op12_attention_quality(spark, sf).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    by = {x.doc_id: x for x in got}
    assert by[900].score == by[901].score == by[902].score
    assert all(x.held_out == (x.doc_id is not None and held(x.doc_id)) for x in got)
    test = [d for d in range(400) if held(d)]
    assert np.mean([by[d].predicted == int(d % 3 != 0) for d in test]) > 0.97
    # the labels of held-out rows have no say
    flipped = [(d, 1 - q if d is not None and q is not None and held(d) else q, t) for d, q, t in labels]
    write("labels", flipped, "doc_id long, quality int, toxic int")
    again = {x.doc_id: x.score for x in aq.op12_attention_quality(spark, sf).collect()}
    assert all(abs(again[d] - by[d].score) < 1e-9 for d in again)


def test_op12_without_labels_or_rows(spark, write):
    sf = write("documents", [(1, "a b", None, None, None, None, None, None, None)], DOCS)
    write("labels", [], "doc_id long, quality int, toxic int")
    assert [(x.score, x.predicted) for x in aq.op12_attention_quality(spark, sf).collect()] == [(0.5, 1)]
    write("labels", [(2, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    want = 0.5 if held(1) else 1 / 3
    assert [x.score for x in aq.op12_attention_quality(spark, sf).collect()] == [want]
    assert aq.op12_attention_quality(spark, write("documents", [], DOCS)).count() == 0


def test_op12_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text").union(
        spark.range(500).selectExpr("0L AS doc_id", "concat('again', id) AS text"))
    labels = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    got = aq.training_texts(docs, labels, 50).collect()
    known = [d for d in range(3000) if not held(d)]
    want = {hashlib.md5(str(d).encode()).hexdigest() for q in (0, 1)
            for d in sorted((d for d in known if d % 2 == q), key=lambda d: hashlib.md5(str(d).encode()).hexdigest())[:50]}
    assert {x.key for x in got} == want and len(got) == 100


def test_op12_held_out_accuracy(spark, sf):
    rows = {x.doc_id: x for x in aq.op12_attention_quality(spark, "/root/testdata/sf0.01").collect()}
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    test = [(rows[m.doc_id].predicted, m.quality) for m in marks if rows[m.doc_id].held_out]
    assert len(test) > 100 and np.mean([a == b for a, b in test]) > 0.96
