"""Operators 3 and 7 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import fingerprints, neardup, shingles

DOCS = "doc_id long, text string, key string, kept string, n string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t, k, lower):
    t = t or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = WORDS.findall(t)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows):
    sets = [(d, shingle_set(t, 4, True)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, (a, s) in enumerate(sets):
        for b, u in sets[:i]:
            if s and u and 100 * len(s & u) >= 80 * len(s | u):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 90))) for _ in range(12)]
    out = [None, "", " \n ", "One", "one", "one two three", "ONE two Three", "ÀB c", "àb c"]
    for _ in range(n):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((" " if r.random() < .5 else "\n").join(w))
    return list(enumerate(out, 5))


@pytest.mark.parametrize("small_nodes", [False, True])
def test_op7_components_against_brute_force(spark, write, monkeypatch, small_nodes):
    if small_nodes:  # branches, blocks of nodes and blocks of clusters on a small table
        monkeypatch.setattr(neardup, "NODE", 6)
        monkeypatch.setattr(neardup, "DEPTH", 2)
        monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 150)
        monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 3)
    rows = corpus()
    sf = write("documents", [(d, t, "a", "b", None) for d, t in rows] + [(None, "one two", None, None, None)], DOCS)
    got = {r.doc_id: r for r in neardup.op7_chosen_path_dedup(spark, sf).collect()}
    want = components(rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept = neardup.filter_documents(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if c == d} | {None}


def test_a_large_cluster_ships_each_set_a_few_times(spark, write, monkeypatch):
    """Thousands of distinct near copies of one text, some of which only chains hold together."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(2500):
        w = base[:]
        for _ in range(r.randint(1, 9)):
            w[r.randrange(300)] = f"x{r.randrange(10 ** 6)}"
        rows.append((d, " ".join(w)))
    sent = []
    ordered = neardup.grouped_edges
    monkeypatch.setattr(neardup, "grouped_edges",
                        lambda df, columns, like: (sent.append(df.count()) if columns == ["full"] else None, ordered(df, columns, like))[1])
    pivots = neardup.pivot_links
    monkeypatch.setattr(neardup, "pivot_links", lambda p, rest: (
        sent.append(rest.count() + p.selectExpr("sum(k)").first()[0]), pivots(p, rest))[1])
    sf = write("documents", [(d, t, None, None, None) for d, t in rows], DOCS)
    got = {x.doc_id: x.component_id for x in neardup.op7_chosen_path_dedup(spark, sf).collect()}
    # brute force by counting the shingles that pairs share (vectorised)
    codes, sets = {}, []
    for _, t in rows:
        sets.append(np.array(sorted({codes.setdefault(x, len(codes)) for x in shingle_set(t, 4, True)})))
    has = np.zeros((len(rows), len(codes)), np.float32)
    for k, x in enumerate(sets):
        has[k, x] = 1
    both = has @ has.T
    size = has.sum(1)
    near = 100 * both >= 80 * (size[:, None] + size - both)
    want, left = {}, set(range(len(rows)))
    while left:
        seed = min(left)
        part, queue = {seed}, [seed]
        while queue:
            new = set(np.flatnonzero(near[queue.pop()]).tolist()) - part
            part |= new
            queue += new
        want |= {d: seed for d in part}
        left -= part
    assert got == want
    assert sum(sent) < 6 * len(rows)  # blocks against blocks would send 20 times as many


def test_op7_repeated_rows_and_empty_table(spark, write):
    rows = [(1, "a b c d e", None, None, None)] * 2 + [(2, "a b c d e", None, None, None)]
    got = sorted(tuple(r) for r in neardup.op7_chosen_path_dedup(spark, write("documents", rows, DOCS)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert neardup.op7_chosen_path_dedup(spark, write("documents", [], DOCS)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 60
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(500, 501), (7, 7)], "a long, b long")
    got = {r.cid: r.root for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {500: 500, 501: 500}


def test_word_hashes_follow_the_words(monkeypatch):
    r = random.Random(4)
    ts = [None, "", "  ", "é\x0bA a", "x" * 3000] + [
        " ".join("".join(r.choice("abé漢") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 50))) for _ in range(40)]
    whole, first = shingles.word_hashes(ts)
    monkeypatch.setattr(shingles, "PIECE", 64)
    again, _ = shingles.word_hashes(ts)
    assert np.array_equal(whole, again)
    words = [w for t in ts for w in WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    assert len(words) == len(whole) and len(set(words)) == len(set(whole.tolist()))
    assert len({(w, h) for w, h in zip(words, whole.tolist())}) == len(set(words))
    assert first.tolist()[-1] == len(words)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op3_against_brute_force(spark, write):
    rows = [(d * 3, t) for d, t in corpus(3, 40)] + [(-9, "first text " * 30)]
    sf = write("documents", [(d, t, None, None, None) for d, t in rows], DOCS)
    got = {r.doc_id: r for r in fingerprints.op3_bottom_k_fingerprints(spark, sf).collect()}
    rows = sorted((d, t or "") for d, t in rows)
    for k, (d, t) in enumerate(rows):
        nxt, h = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, b, c = (shingle_set(x, 5, False) for x in (t, edited, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        # fewer than K shingles: the estimates are exact
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12
        assert r.n_shingles_estimate == len(a) and len(r.fingerprint) == 16 * len(a)
    same = {}
    for d, t in rows:
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def xxh(words, seed=42):
    """The engine's hash of several strings or longs: each hashed with the hash before it as seed."""
    import xxhash
    h = seed
    for w in words:
        raw = w.encode() if isinstance(w, str) else w.to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(raw, seed=h % (1 << 64))
    return h - (1 << 64) if h >= 1 << 63 else h


def test_op3_sketches_of_long_texts(spark, write):
    """Texts of far more than K shingles: sketches, likeness and counts from plain sorted hashes."""
    r = random.Random(12)
    k = fingerprints.K
    base = [f"w{i}é" for i in range(900)]
    rows = []
    for d in range(12):
        w = base[: r.randint(300, 900)]
        for _ in range(r.randint(0, 60)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    rows += [(20, rows[0][1]), (21, "Long" * 50_000), (22, " ".join(base * 12))]
    sf = write("documents", [(d, t, None, None, None) for d, t in rows], DOCS)
    got = {x.doc_id: x for x in fingerprints.op3_bottom_k_fingerprints(spark, sf).collect()}

    def hashes(t):
        w = [xxh([x]) for x in WORDS.findall(t)]
        return {xxh(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else None

    def low(s):
        return sorted(s)[:k]

    def near(a, b):
        union = sorted(set(low(a)) | set(low(b)))[:k]
        return len(set(union) & set(low(a)) & set(low(b))) / len(union)

    for at, (d, t) in enumerate(rows):
        nxt, h = rows[(at + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        a, b, c = hashes(t), hashes(edited), hashes(nxt)
        x = got[d]
        if a is None:
            assert len(x.fingerprint) == 16
            continue
        assert len(a) > k
        assert x.fingerprint == "".join(f"{v % (1 << 64):016X}" for v in low(a))
        assert x.edited_fingerprint == "".join(f"{v % (1 << 64):016X}" for v in low(b))
        assert abs(x.near_edited - near(a, b)) < 1e-12
        if c is not None:
            assert abs(x.near_next - near(a, c)) < 1e-12
        assert abs(x.n_shingles_estimate / len(a) - 1) < 0.35


def test_op3_one_row_equal_ids_and_no_rows(spark, write):
    one = fingerprints.op3_bottom_k_fingerprints(spark, write("documents", [(4, "abcdef", None, None, None)], DOCS)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1.0
    rows = [(1, "bb", None, None, None), (1, "aa", None, None, None), (1, "aa", None, None, None), (None, "zz", None, None, None)]
    got = fingerprints.op3_bottom_k_fingerprints(spark, write("documents", rows, DOCS)).collect()
    assert sorted(r.edited_sha256 for r in got) == sorted(
        hashlib.sha256(x).hexdigest() for x in (b"za", b"aa", b"ab", b"bz"))
    assert fingerprints.op3_bottom_k_fingerprints(spark, write("documents", [], DOCS)).count() == 0


def test_sketches_merge_like_the_union(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    a, b = (" ".join(r.choice(words) for _ in range(900)) for _ in range(2))
    df = spark.createDataFrame([(1, "k", a), (2, "k", b), (3, "other", a)], "id int, grp string, text string")
    d = fingerprints.add_sketch(df, "text", "s")
    merged = {x.grp: x.s for x in fingerprints.merge_groups(d, "grp", "s").collect()}
    s = {x.id: x.s for x in d.collect()}
    assert merged["k"] == sorted({*s[1], *s[2]})[: fingerprints.K] and merged["other"] == s[3]
    est = d.select("id", fingerprints.distinct_count(F.col("s")).alias("n")).collect()
    assert all(abs(x.n - 896) < 0.35 * 896 for x in est)
