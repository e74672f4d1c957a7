"""Operator 2, BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token the table holds the one last token that the
prefix's encoding ends with. An Aho-Corasick automaton over the vocabulary
(in place of a suffix automaton: it lists just the matches that the table needs)
gives the tokens that end at each prefix, longest first; a token is that last token if
it is compatible with the last token of the prefix before it, i.e. if merging
the texts of both leaves this very pair. Back-pointers from the end give the
ids. Only the longest word-end token's length of suffixes is tried at the end
of a pre-token, so its cost grows with its length alone. No merge queue runs
over the text.

The file's path is a parameter. Its vocabulary, merges, word end and special
strings are used as they are; the steps around the model (NFC, lower case, the
split pattern, the byte alphabet) are built in, and a file that asks for
others is refused (``chunks.refuse_other``).

Defined results: a null or blank text has no ids and decodes to the empty
text; a text of millions of letters without a blank is one pre-token and is
encoded whole. A null or repeated id is passed on like any other. Decoding joins the tokens by one space, as the library does for a file
without a decoder. Repeated rows give repeated results; an empty table gives
an empty result. Other columns, whatever their names, pass through
``encode_documents`` untouched, except that its two outputs replace columns
of the same names.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quarry.llm.chunks import ChunkMemo, Rules
from quarry.llm.common import read

PAIRS_KEPT = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the other
    bytes take code points from 256 on, in order."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


class PrefixBPE:
    """Encoder and decoder for a word-end BPE file."""

    def __init__(self, path: str):
        import ahocorasick

        self.rules = Rules(path)
        model = self.rules.spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        tokens = {i: t for t, i in (vocab | self.rules.special).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        # How a token came about: its rank and its two parts; letters have rank -1.
        # (arrays and one flat dictionary: every worker holds a copy)
        n = len(self.tokens)
        self.rank, self.left, self.right = (np.full(n, -1, np.int32) for _ in range(3))
        self.merge: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.merge[x << 32 | y] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, x, y
        self.rank, self.left, self.right = (array("i", v.tobytes()) for v in (self.rank, self.left, self.right))
        self.inner = ahocorasick.Automaton()
        self.last: dict[str, int] = {}
        for t, i in vocab.items():
            if t.endswith(self.end):
                self.last[t[: -len(self.end)]] = i
            else:
                self.inner.add_word(t, (i, len(t)))
        self.inner.make_automaton()
        self.longest = max(map(len, self.last))
        self._letter = byte_alphabet()
        self._pairs: dict[int, bool] = {}
        self._decimal: list[str] = []
        self.rules.spec = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE on the joined texts of two tokens leaves them apart.

        Both are unmerged along their shared border, latest merge first. A
        merge across the border that BPE would have done before the merge just
        undone would have used up one of its sides: then they don't stay."""
        known = self._pairs.get(a << 32 | b)
        if known is not None:
            return known
        x, y, bound, apart = a, b, len(self.merge), True
        while True:
            r = self.merge.get(x << 32 | y)
            if r is not None and r < bound:
                apart = False
                break
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:  # the border merge loses a tie: a merge further left of equal rank comes first
                x, bound = self.right[x], rx
            else:
                y, bound = self.left[y], ry + 1
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        self._pairs[a << 32 | b] = apart
        return apart

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        if not piece.isascii():
            piece = "".join(map(self._letter.__getitem__, piece.encode("utf-8")))
        elif not piece.isprintable():
            piece = "".join(map(self._letter.__getitem__, piece.encode("ascii")))
        n = len(piece)
        token, back, compatible = [-1] * (n + 1), [0] * (n + 1), self.compatible
        for end, (t, size) in self.inner.iter(piece):
            i = end + 1
            if i == n:
                break
            if token[i] < 0:
                j = i - size
                if j == 0 or (token[j] >= 0 and compatible(token[j], t)):
                    token[i], back[i] = t, j
        # The last token ends the word: the longest such token whose prefix has a table entry that it suits.
        for j in range(max(0, n - self.longest), n):
            t = self.last.get(piece[j:])
            if t is not None and (j == 0 or (token[j] >= 0 and compatible(token[j], t))):
                out = [t]
                while j > 0:
                    out.append(token[j])
                    j = back[j]
                return out[::-1]
        raise ValueError(f"no encoding for {piece!r}")

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.encode_piece(p), dtype="<u4").tobytes() for p in pieces]

    def decimal(self) -> list[str]:
        """The ids as text, made when first asked for."""
        if not self._decimal:
            self._decimal = [str(i) for i in range(len(self.tokens))]
        return self._decimal

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_MODELS: dict[tuple[str, int], tuple[PrefixBPE, ChunkMemo]] = {}
LARGE = 2  # times the chunk memory, where a worker does nothing else


def model(path: str, memory: int = 1) -> tuple[PrefixBPE, ChunkMemo]:
    """The encoder of a file and its chunk memory, once per worker."""
    key = (path, memory)
    if key not in _MODELS:
        m = PrefixBPE(path)
        special = {t: np.array([i], dtype="<u4").tobytes() for t, i in m.rules.special.items()}
        _MODELS[key] = m, ChunkMemo(m.rules, m.encode_pieces, special, kept=100_000 * memory,
                                    slot_bits=18 + memory, pool=3_000_000 * memory)
    return _MODELS[key]


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


ROWS = 256  # texts handled at a time within an Arrow batch


def _mapped(df: DataFrame, drop: tuple[str, ...], added: list[StructField], work) -> DataFrame:
    """``df`` without ``drop``, with ``added`` columns that ``work`` makes of small slices."""
    import pyarrow as pa

    keep = [f for f in df.schema.fields if f.name not in (*drop, *[f.name for f in added])]
    names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*[_column(part, n) for n in names], *work(part)],
                                                 names=[*names, *[f.name for f in added]])

    return df.mapInArrow(run, StructType([*keep, *added]))


def encode_documents(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (little-endian uint32, four bytes a token) and
    ``n_tokens`` of the whole text, and on demand ``decoded``, the text of the
    ids, from the same worker."""
    import pyarrow as pa

    def work(part):
        m, memo = model(path)
        ids, first = memo.ids_of(_column(part, text).to_pylist())
        out = (pa.array([ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
               pa.array(np.diff(first), pa.int64()))
        if not decoded:
            return out
        return *out, pa.array([m.decode(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:])], pa.string())

    added = [StructField("ids", BinaryType()), StructField("n_tokens", LongType())]
    return _mapped(df, (), [*added, *[StructField("decoded", StringType())] * decoded], work)


def decode_documents(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ``ids``."""
    import pyarrow as pa

    def work(part):
        m = model(path)[0]
        got = [np.frombuffer(x or b"", dtype="<u4").tolist() for x in _column(part, ids).to_pylist()]
        return (pa.array([m.decode(x) for x in got], pa.string()),)

    return _mapped(df, (), [StructField("decoded", StringType())], work)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` without its text, with ``n_tokens``, ``ids_text`` (decimal ids joined
    by one space) and ``decoded``: both ways in one pass over the texts."""
    import pyarrow as pa

    def work(part):
        m, memo = model(path, LARGE)
        decimal = m.decimal()
        ids, first = memo.ids_of(_column(part, text).to_pylist())
        got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        return (pa.array([len(x) for x in got], pa.int64()),
                pa.array([" ".join(map(decimal.__getitem__, x)) for x in got], pa.string()),
                pa.array([m.decode(x) for x in got], pa.string()))

    return _mapped(df, (text,), [StructField("n_tokens", LongType()), StructField("ids_text", StringType()),
                                 StructField("decoded", StringType())], work)


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of a table of texts."""
    return round_trip(df.select("doc_id", "text"), path).select(
        "doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; digests of both."""
    return digests(read(spark, sf_dir, "documents"), tokenizer_path())
