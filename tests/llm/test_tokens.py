"""Operators 2 and 9 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, token_files

ALPHABET = "abcdefghijklmnopqrstuvwxyz'''  \n\t\x1c\x85\xa0éñßüŁΣςİ̇́漢字かな🙂०१½ﬁ　<|>endoftext|$#%&ABCZÀ한글\x00"
DOCS = "doc_id long, text string, extra string, ids string, n_tokens string"
ROWS = [(3, "Hello  World's\nthird", None, "x", "y"), (1, None, "a", None, None), (2, "", "", "", ""),
        (3, "Hello  World's\nthird", None, "x", "y"), (9, "<|endoftext|>A b<|startoftext|>", "z", None, "q"),
        (7, " \t\n", None, None, None), (-4, "long " * 5000 + "x" * 3000, None, None, None)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def lists(memo, ts):
    ids, first = memo.ids_of(ts)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]


def texts():
    r = random.Random(3)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return out + ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 60))) for _ in range(500)]


def test_encoders_equal_the_library(library):
    ts = texts()
    want = [e.ids for e in library.encode_batch(ts, add_special_tokens=False)]
    model, memo = bpe.model(bpe.tokenizer_path())
    got = lists(memo, ts)
    assert got == want
    assert [model.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in want]
    memo, kind = token_files.library_memo(bpe.tokenizer_path())
    assert lists(memo, ts) == want


def test_small_memories_change_nothing(library):
    from quarry.llm.chunks import ChunkMemo

    model, _ = bpe.model(bpe.tokenizer_path())
    memo = ChunkMemo(model.rules, model.encode_pieces, {}, kept=3, slot_bits=2, pool=200)
    ts = [t for t in texts()[:300] if "|" not in t]
    for k in range(0, len(ts), 7):
        part = ts[k:k + 7] * 2
        assert lists(memo, part) == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_op2_on_odd_rows(spark, write, library):
    got = sorted(tuple(r) for r in bpe.op2_bpe_prefix_dp(spark, write("documents", ROWS, DOCS)).collect())
    want = []
    for d, t, *_ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_encode_then_decode_keeps_other_columns(spark, write):
    df = spark.read.parquet(write("documents", ROWS, DOCS) + "/documents.parquet")
    path = bpe.tokenizer_path()
    enc = bpe.encode_documents(df, path)
    assert enc.columns == ["doc_id", "text", "extra", "ids", "n_tokens"]
    dec = {r.doc_id: r for r in bpe.decode_documents(enc, path).collect()}
    assert dec[3].decoded == "hello</w> world</w> 's</w> third</w>" and dec[1].decoded == "" and dec[3].extra is None


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_op9_files_read_back(spark, write, tmp_path, library, limit):
    sf = write("documents", ROWS, DOCS)
    where = str(tmp_path / "shards")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    token_files.write_token_files(df, where, bpe.tokenizer_path(), limit=limit)
    files = spark.read.parquet(where)
    got = token_files.read_token_files(spark, where).join(token_files.starts(files), ["part", "shard"])
    got = sorted((r.shard_start + r["at"], r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect())
    want, at = [], 0
    for d, t, *_ in sorted(ROWS, key=lambda r: (r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_op9_empty_table(spark, write):
    assert token_files.op9_wavelet_token_files(spark, write("documents", [], DOCS)).count() == 0


def test_wavelet_matrix_against_brute_force():
    r = np.random.default_rng(1)
    for n, top in ((0, 5), (1, 5), (700, 1), (5000, 49408), (3000, 7)):
        ids = r.integers(0, top, n).astype("<u2")
        docs, sizes, wm = token_files.unpack(token_files.pack([4], [n], ids))
        assert docs == [4] and sizes.tolist() == [n] and wm.all().tolist() == ids.tolist()
        for i in r.integers(0, max(n, 1), 20) if n else []:
            assert wm.access(int(i)) == ids[i]
        for t in [0, 3, 49407, *ids[:5].tolist()]:
            at = np.flatnonzero(ids == t).tolist()
            assert wm.count(t) == len(at) and wm.rank(t, n // 2) == sum(a < n // 2 for a in at)
            assert [wm.select(t, k) for k in range(min(len(at), 10))] == at[:10]
            if len(at) < 50:
                assert wm.find(t) == at


def test_lookups_open_only_the_blocks_they_touch():
    r = np.random.default_rng(2)
    ids = r.integers(0, 3000, 400_000).astype("<u2")
    ids[::7] = 5
    body = token_files.pack([1, None], [100, len(ids) - 100], ids)
    blocks = -(-len(ids) // token_files.BLOCK) * 12
    at = {t: np.flatnonzero(ids == t) for t in (5, 17)}
    for ask, most, want in [(lambda w: w.access(333_333), 12, ids[333_333]), (lambda w: w.rank(17, 200_000), 24, (at[17] < 200_000).sum()),
                            (lambda w: w.select(5, 30_000), 60, at[5][30_000]), (lambda w: w.select(17, 99), 60, at[17][99])]:
        docs, sizes, wm = token_files.unpack(body)
        assert wm.opened == 0 and docs == [1, None]
        assert ask(wm) == want and wm.opened <= most < blocks
    assert wm.find(17) == at[17].tolist() and (wm.all() == ids).all()


def test_op9_null_ids_come_first(spark, write):
    rows = [(0, "zero", None, None, None), (None, "of no id", None, None, None), (5, None, None, None, None),
            (None, None, None, None, None), (-1, "minus", None, None, None)]
    got = token_files.op9_wavelet_token_files(spark, write("documents", rows, DOCS)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, 0, 5]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_every_word_of_the_vocabulary_through_the_table(library):
    """Also those words that are one token: the table and the library agree on all of them."""
    m, _ = bpe.model(bpe.tokenizer_path())
    back = {c: b for b, c in enumerate(bpe.byte_alphabet())}
    words = []
    for w in m.last:
        try:
            words.append(bytes(back[c] for c in w).decode())
        except UnicodeDecodeError:
            continue  # part of a character
    words = [w for w in words if m.rules.pieces(w) == [w]]
    assert len(words) > 30_000
    want = [e.ids for e in library.encode_batch(words, add_special_tokens=False)]
    assert [m.encode_piece(w) for w in words] == want


def test_a_million_letters_without_a_blank(spark, write, library):
    import time
    r = random.Random(8)
    text = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))
    m, _ = bpe.model(bpe.tokenizer_path())
    began = time.time()
    ids = m.encode_piece(text)
    assert time.time() - began < 60
    assert ids == library.encode(text, add_special_tokens=False).ids
    rows = [(1, text, None, None, None), (None, text, None, None, None), (1, "x", None, None, None)]
    got = bpe.op2_bpe_prefix_dp(spark, write("documents", rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 1), (False, len(ids)), (True, len(ids))]


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}},
                                    {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_tokenizer_files_are_refused(tmp_path, change):
    import json
    spec = json.load(open(bpe.tokenizer_path(), encoding="utf-8")) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="tokenizer file"):
        bpe.PrefixBPE(str(path))
