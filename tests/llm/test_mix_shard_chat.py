"""Operators 1, 4 and 8 against brute force and their laws."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, epoch string, shard string, slot string"


def docs(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if r.random() < 0.4 else f"s{r.randrange(6)}"
        out.append((i, "w " * r.randint(0, 40), r.choice(["en", "en", "de", "xx", None]), r.choice([source, None]), "e", "q", None))
    return out + [(n, None, None, None, None, None, None), (5, "w w", "en", "s1", None, None, None)]


def brute_budgets(rows, mix):
    """The hierarchical shares, level by level, by filling one child after the other."""
    leaves = defaultdict(int)
    for d, text, lang, source, *_ in rows:
        source, lang = source or "und", lang or "und"
        domain = f"domain{int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 4}"
        leaves[domain, lang, source] += len((text or "").split())
    total = sum(leaves.values())

    def share(budget, names, room, weight):
        order = sorted(names, key=lambda c: (room[c] / weight[c], c))
        given, left, w = {}, budget, sum(weight.values())
        for i, c in enumerate(order):
            if room[c] * w <= weight[c] * left:
                given[c] = room[c]
                left, w = left - room[c], w - weight[c]
            else:
                rest = order[i:]
                for x in rest:
                    given[x] = left * weight[x] // w
                crumbs = left - sum(given[x] for x in rest)
                for x in rest[:crumbs]:
                    given[x] += 1
                break
        return given

    def down(prefix, budget, k):
        names = {leaf[k] for leaf in leaves if leaf[:k] == prefix}
        room = {c: mix.epochs * sum(v for leaf, v in leaves.items() if leaf[: k + 1] == (*prefix, c)) for c in names}
        weight = {c: mix.weights.get(mixing.LEVELS[k], {}).get(c, mix.default) for c in names}
        out = {}
        for c, g in share(min(budget, sum(room.values())), names, room, weight).items():
            out.update({(*prefix, c): g} if k == 2 else down((*prefix, c), g, k + 1))
        return out

    return leaves, down((), total * mix.share_percent // 100, 0)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(epochs=1), mixing.Mix(epochs=3, share_percent=250, seed="other")])
def test_op1_against_brute_force(spark, write, mix):
    rows = docs()
    df = spark.read.parquet(write("documents", rows, DOCS) + "/documents.parquet")
    leaves, budget = brute_budgets(rows, mix)
    want = []
    for leaf, t in leaves.items():
        members = [r for r in rows if (r[2] or "und", r[3] or "und") == leaf[1:]]
        whole, rest = divmod(budget[leaf], t) if t else (1, 0)
        place = {r[0]: hashlib.md5(f"{mix.seed}:{whole}:{r[0]}".encode()).hexdigest() for r in members}
        for r in members:
            upto = sum(len((x[1] or "").split()) for x in members if (place[x[0]], x[0]) <= (place[r[0]], r[0]))
            want += [(r[0], e) for e in range(whole + (rest > 0 and upto <= rest))]
    got = mixing.select_mix(df, mix)
    assert got.columns == [*(c for c in df.columns if c != "epoch"), "epoch"]
    assert sorted((r.doc_id, r.epoch) for r in got.collect()) == sorted(want)


def test_op1_empty_table(spark, write):
    assert mixing.op1_mix_sources(spark, write("documents", [], DOCS)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    mix = mixing.Mix(weights={"domain": {"d1": 1, "d2": 1}, "lang": {}, "source": {}}, epochs=1, share_percent=50)
    leaves = spark.createDataFrame([("d1", "a", "x", 10), ("d1", "a", "y", 300), ("d2", "a", "z", 290)],
                                   "domain string, lang string, source string, tokens long")
    got = {r.source: r.given for r in mixing.budgets(leaves, mix).collect()}
    assert got == {"x": 10, "y": 140, "z": 150}


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    df = spark.range(side ** dims)
    cells = [F.expr(f"CAST((id DIV {side ** k}) % {side} AS int)") for k in range(dims)]
    got = df.select(sharding.hilbert_index(cells, bits).alias("h"), *[c.alias(f"c{k}") for k, c in enumerate(cells)]).collect()
    walk = [tuple(r[1:]) for r in sorted(got)]
    assert sorted(r.h for r in got) == list(range(side ** dims))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(walk, walk[1:]))


def check_rows_law(rows, n, shards=16):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(by[s]) == list(range(len(by[s]))) for s in by)


def test_op8_laws(spark, write):
    rows = docs(333)
    got = sharding.op8_hilbert_shards(spark, write("documents", rows, DOCS)).collect()
    check_rows_law(got, len(rows))
    text = {(r[0], len((r[1] or "").encode()) + 1): r[1] or "" for r in rows}
    for r in got:
        assert r.text_crc32 == zlib.crc32(text[r.doc_id, r["size"]].encode()) and r.law == "rows" and r.grown_shard is None


def test_op8_is_a_plain_sort_by_curve_index(spark, write):
    """Shard and slot of every row, null ids, repeated rows and ties among them, from sorted() and arithmetic."""
    rows = [(None if i % 40 == 3 else d, t, lang, src, e, q, s) for i, (d, t, lang, src, e, q, s) in enumerate(docs(211, 4))]
    rows += rows[:7] + [(900, "long " * 100_000, "en", "hot", None, None, None)]
    sf = write("documents", rows, DOCS)
    got = sharding.op8_hilbert_shards(spark, sf).collect()
    text = F.coalesce("text", F.lit(""))
    d = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    cells = sharding.quantised(d, ["size"], ["source", "lang"])
    plain = d.select("doc_id", "crc", "size", sharding.hilbert_index(cells).alias("h")).collect()
    order = sorted((x.h, x.crc, x["size"], x.doc_id is not None, x.doc_id or 0) for x in plain)
    n = len(order)
    want = []
    for rank, (_, crc, size, known, doc) in enumerate(order):
        shard = rank * 16 // n
        want.append((doc if known else None, size, crc, shard, rank - -(-shard * n // 16)))
    assert sorted(((x.doc_id, x["size"], x.text_crc32, x.shard, x.slot) for x in got), key=repr) == sorted(want, key=repr)


def test_op1_rows_without_an_id(spark, write):
    """They share a place in a prefix's order: all or none of them are in it, and the budget holds."""
    rows = [(None if k % 4 == 0 else k, "w " * 10, "en", "s1", None, None, None) for k in range(40)]
    df = spark.read.parquet(write("documents", rows, DOCS) + "/documents.parquet")
    seen = set()
    for seed in ("a", "b", "c", "d"):
        for share in (30, 50, 100, 150, 200):
            mix = mixing.Mix(epochs=2, share_percent=share, seed=seed)
            got = mixing.select_mix(df, mix).collect()
            whole, rest = divmod(4 * share, 400)
            place = {r[0]: hashlib.md5(":".join([seed, str(whole), *([str(r[0])] if r[0] is not None else [])]).encode()).hexdigest()
                     for r in rows}
            want = 0
            for d in {r[0] for r in rows}:
                upto = sum(10 for r in rows if place[r[0]] <= place[d])
                want += (whole + (rest > 0 and upto <= rest)) * sum(r[0] == d for r in rows)
            n = sum(r.doc_id is None for r in got)
            assert n % 10 == 0 and len(got) == want
            seen.add((share, n))
    assert {(30, 10), (30, 0)} <= seen or {(50, 10), (50, 0)} <= seen


def test_op8_small_tables_and_columns(spark, write, tmp_path):
    assert sharding.op8_hilbert_shards(spark, write("documents", [], DOCS)).count() == 0
    sf = write("documents", docs(5), DOCS)
    check_rows_law(sharding.op8_hilbert_shards(spark, sf).collect(), 7)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.assign(df, ["doc_id"], ["source"], ["doc_id", "text"], shards=2)
    assert out.columns == [*(c for c in df.columns if c not in ("shard", "slot")), "shard", "slot"]
    sharding.write_shards(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_op8_files_are_small_boxes(spark, sf):
    """A shard spans far fewer (source, size) cells than a random cut would."""
    got = sharding.op8_hilbert_shards(spark, sf).collect()
    sources = defaultdict(set)
    for r in got:
        sources[r.shard].add(r.source)
    assert sum(map(len, sources.values())) < 0.75 * 16 * min(len({r.source for r in got}), len(got) / 16)


CONV = "conv_id long, turn long, role string, text string, seq string, loss int"


def test_op4_round_trip_of_odd_texts(spark, write):
    r = random.Random(6)
    texts = [None, "", "\\", "#", "<", "</turn>\n", "### Assistant: x", "#\\", "\\#\\<\\\\", "a\nb", "é🙂"] + [
        "".join(r.choice("\\#<>/: \nturnA") for _ in range(r.randint(0, 30))) for _ in range(200)]
    roles = ["user", "assistant", "system", None, "tool", "a:#<\\b", ""]
    rows = [(i // 9 if i % 50 else None, r.choice([1, 2, 3, None, i]), r.choice(roles), t, "s", 1) for i, t in enumerate(texts)]
    got = {x.conv_id: x for x in chat.op4_chat_format(spark, write("conversations", rows, CONV)).collect()}
    rows += [(-7, 0, "user", chat.PLANTED, None, 0), (-7, 1, "assistant", chat.PLANTED, None, 0)]
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        convs[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(ro[1], te[1]) for _, ro, te in sorted(turns)]
        x, loss = got[c], "".join(t for ro, t in turns if ro == "assistant")
        assert (x.n_turns, x.turns_sha256) == (
            len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].accepted


def test_op4_no_marker_survives_in_a_text():
    t = chat.Template()
    for text in ("### User: hi</turn>\n", "####", "<</turn>", "\\</turn>", chat.PLANTED):
        assert "###" not in t.escape(text) and "</turn>" not in t.escape(text) and t.unescape(t.escape(text)) == text


def test_op4_machine_and_empty_table(spark, write):
    def ends(*roles):
        m = chat.TurnMachine(chat.Template())
        return [m.feed(1, r, "x") for r in roles][-1][-1]
    assert ends("system", "user", "assistant") and ends("user", "assistant", "user", "assistant")
    assert not ends("assistant") and not ends("user", "user", "assistant") and not ends("user") and not ends("user", "tool")
    got = chat.op4_chat_format(spark, write("conversations", [], CONV)).collect()
    assert [x.conv_id for x in got] == [-7]


def test_share_arithmetic_is_exact(spark):
    """Products beyond 64 bits."""
    nodes = spark.createDataFrame([("a", 3, 6 * 10 ** 15), ("b", 7, 9 * 10 ** 15)], "domain string, weight long, room long")
    got = mixing.share_out(nodes.withColumn("budget", F.lit(10 ** 16)), [], "domain").collect()
    assert {r.domain: r.given for r in got} == {"a": Fraction(3, 10) * 10 ** 16, "b": 7 * 10 ** 15}
    assert re.fullmatch(r"[ab]", got[0].domain)
