"""Operator 9, token ids as files: one wavelet matrix per shard.

Texts are encoded, sorted by document id and cut into shards of about
``SHARD_IDS`` ids at document borders. A shard is one binary file body: a
header, the documents' ids and lengths, the sorted ids that occur, and the
bit-planes of a wavelet matrix over their numbers in that order. Plane b holds
bit b of every number in the order that stable partitions by the higher bits
leave. Planes are compressed in blocks of ``BLOCK`` bits; beside them stand the
ones before each block, where its bytes begin, and the block of every
``BLOCK``-th one and zero. So access, rank (counting) and select (occurrence
lookup) open only the blocks that they touch, a few per plane. Spark
writes the bodies (one row and one Parquet file each), so half-written shards
of a lost executor never show.

Defined results: a null or blank text has no ids of its own, only the end id.
A null document id comes first, kept apart from the number 0 by a flag. Documents of equal id follow each other by their text. A text is never cut:
a very long one makes its shard longer. An empty table gives no shard and an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import tokenizer_path
from quarry.llm.chunks import ChunkMemo, Rules
from quarry.llm.common import read, scratch_path

MAGIC = b"QWM2"
SHARD_IDS = 1 << 20
BLOCK = 1 << 15
KEPT_BLOCKS = 64
END_ID = 2


def planes_of(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted ids that occur, and the bit-planes (packed, whole blocks) of
    the ids' places among them, highest bit first."""
    n = len(ids)
    seen = np.bincount(ids) > 0 if n else np.zeros(0, bool)
    alphabet = np.flatnonzero(seen).astype("<u4")
    bits = max(len(alphabet) - 1, 0).bit_length()
    kind = np.uint16 if bits <= 16 else np.uint32
    a = (np.cumsum(seen) - 1).astype(kind)[ids] if n else np.zeros(0, kind)
    room = -(-n // BLOCK) * (BLOCK // 8)
    planes = []
    for b in range(bits - 1, -1, -1):
        one = (a & kind(1 << b)) != 0
        plane = np.zeros(room, dtype=np.uint8)
        packed = np.packbits(one, bitorder="little")
        plane[: len(packed)] = packed
        planes.append(plane)
        if b:
            a = np.concatenate([a.compress(~one), a.compress(one)])
    return alphabet, planes


def _samples(before: np.ndarray) -> np.ndarray:
    """The block that holds every BLOCK-th of the bits counted by ``before`` (counts before each block, and in all)."""
    return np.searchsorted(before[1:], np.arange(0, before[-1], BLOCK), "right").astype("<u4")


_HEAD = "<4sIQQ"


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One shard's file body."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    alphabet, planes = planes_of(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = squeeze(b"".join([known.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
                              np.array(sizes, dtype="<i8").tobytes()]))
    support, blocks, at = [], [], 0
    for plane in planes:
        rows = plane.reshape(-1, BLOCK // 8)
        per = np.bitwise_count(rows.view(np.uint64)).sum(axis=1, dtype=np.int64)
        ones = np.concatenate([[0], np.cumsum(per)])
        # (the bits after the last id are zeros that no lookup asks for)
        zeros = np.minimum(np.arange(len(ones)) * BLOCK, len(ids)) - ones
        small = [squeeze(r.tobytes()) for r in rows]
        offsets = at + np.concatenate([[0], np.cumsum([len(x) for x in small])])
        at = int(offsets[-1])
        support += [ones.astype("<u8"), offsets.astype("<u8"), _samples(ones), _samples(zeros)]
        blocks += small
    parts = [index, squeeze(alphabet.tobytes()), b"".join(x.tobytes() for x in support)]
    head = struct.pack(_HEAD, MAGIC, len(planes), len(doc_ids), len(ids))
    return b"".join([head, struct.pack(f"<{len(parts)}Q", *map(len, parts)), *parts, *blocks])


class WaveletMatrix:
    """Lookups in a shard's body. A lookup opens the blocks that it touches: one
    a plane for access, two a plane at most for rank, and for select one more on
    the way up; ``opened`` counts them. A few opened blocks are kept."""

    def __init__(self, body: bytes | memoryview, n: int, alphabet: np.ndarray, bits: int, support: np.ndarray, first: int):
        self.n, self.alphabet, self.bits = n, alphabet, bits
        self._body, self._first, self.opened = memoryview(body), first, 0
        self._open: dict[tuple[int, int], bytes] = {}
        nb, at = -(-n // BLOCK) + 1, 0
        self._ones, self._offset, self._samples = [], [], []
        for _ in range(bits):
            self._ones.append(np.frombuffer(support, "<u8", nb, at).astype(np.int64))
            self._offset.append(np.frombuffer(support, "<u8", nb, at + 8 * nb).astype(np.int64))
            at += 16 * nb
            total = int(self._ones[-1][-1])
            pair = []
            for count in (n - total, total):
                size = -(-count // BLOCK)
                pair.append(size)
            one = np.frombuffer(support, "<u4", pair[1], at)
            zero = np.frombuffer(support, "<u4", pair[0], at + 4 * pair[1])
            self._samples.append((zero, one))
            at += 4 * (pair[0] + pair[1])
        self.zeros = [n - int(o[-1]) for o in self._ones]

    def _block(self, level: int, k: int) -> bytes:
        """The bits of one block of a plane."""
        got = self._open.get((level, k))
        if got is None:
            import zstandard

            a, b = self._offset[level][k: k + 2]
            got = zstandard.ZstdDecompressor().decompress(self._body[self._first + a: self._first + b])
            self.opened += 1
            if len(self._open) >= KEPT_BLOCKS:
                self._open.pop(next(iter(self._open)))
            self._open[level, k] = got
        return got

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK)
        ones = int(self._ones[level][k])
        if rest:
            ones += (int.from_bytes(self._block(level, k)[: -(-rest // 8)], "little") & ((1 << rest) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of the given value in a plane: the
        samples name two blocks between which it lies, the counts the one."""
        ones = self._ones[level]
        marks = self._samples[level][bit]
        lo = int(marks[k // BLOCK])
        hi = int(marks[k // BLOCK + 1]) if k // BLOCK + 1 < len(marks) else len(ones) - 2

        def before(j: int) -> int:
            return int(ones[j]) if bit else j * BLOCK - int(ones[j])

        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid - 1)
        row = np.unpackbits(np.frombuffer(self._block(level, lo), np.uint8), bitorder="little")
        return lo * BLOCK + int(np.flatnonzero(row == bit)[k - before(lo)])

    def access(self, i: int) -> int:
        v = 0
        for lev in range(self.bits):
            bit = self._block(lev, i // BLOCK)[i % BLOCK // 8] >> (i % 8) & 1
            ones = self._rank1(lev, i)
            v = v << 1 | bit
            i = self.zeros[lev] + ones if bit else i - ones
        return int(self.alphabet[v])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _bit_of(self, code: int, level: int) -> int:
        return code >> (self.bits - 1 - level) & 1

    def _down(self, code: int, i: int) -> int:
        """Where the first i places lead below the last plane."""
        for lev in range(self.bits):
            ones = self._rank1(lev, i)
            i = self.zeros[lev] + ones if self._bit_of(code, lev) else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token among the first i ids."""
        code = self._code(token)
        return 0 if code is None else self._down(code, i) - self._down(code, 0)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        code = self._code(token)
        return 0 if code is None else self._down(code, self.n if hi is None else hi) - self._down(code, lo)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        code = self._code(token)
        return self._up(code, self._down(code, 0) + k)

    def _up(self, code: int, i: int) -> int:
        for lev in range(self.bits - 1, -1, -1):
            bit = self._bit_of(code, lev)
            i = self._select(lev, bit, i - self.zeros[lev] if bit else i)
        return i

    def find(self, token: int) -> list[int]:
        code = self._code(token)
        if code is None:
            return []
        return [self._up(code, i) for i in range(self._down(code, 0), self._down(code, self.n))]

    def _plane(self, level: int) -> bytes:
        import zstandard

        opened = zstandard.ZstdDecompressor()
        cuts = (self._first + self._offset[level]).tolist()
        return b"".join(opened.decompress(self._body[a:b]) for a, b in zip(cuts, cuts[1:]))

    def all(self) -> np.ndarray:
        """Every id in order: the stable partitions undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        v = np.zeros(self.n, dtype=kind)
        for lev in range(self.bits - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self._plane(lev), np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, dtype=kind)
            z = self.zeros[lev]
            out[np.flatnonzero(~one)] = v[:z]
            out[np.flatnonzero(one)] = v[z:] | kind(1 << (self.bits - 1 - lev))
            v = out
        return self.alphabet[v]


def unpack(body: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, their numbers of ids, and the lookups of a shard; no plane is opened."""
    import zstandard

    magic, bits, n_docs, n = struct.unpack_from(_HEAD, body)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize(_HEAD)
    lengths = struct.unpack_from("<3Q", body, at)
    cuts = np.cumsum([at + 24, *lengths]).tolist()
    opened = zstandard.ZstdDecompressor().decompress
    index = opened(body[cuts[0]: cuts[1]])
    known = np.frombuffer(index, np.uint8, n_docs)
    ids, sizes = (np.frombuffer(index, "<i8", n_docs, n_docs * (1 + 8 * k)) for k in range(2))
    alphabet = np.frombuffer(opened(body[cuts[1]: cuts[2]]), "<u4")
    return ([d if k else None for d, k in zip(ids.tolist(), known.tolist())], sizes,
            WaveletMatrix(body, n, alphabet, bits, body[cuts[2]: cuts[3]], cuts[3]))


_MEMO: dict[str, tuple[ChunkMemo, str]] = {}


def library_memo(path: str) -> tuple[ChunkMemo, str]:
    """Chunk memory over the tokenizers library, and the type of an id."""
    if path not in _MEMO:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.normalizer = None  # pieces come normalised
        rules = Rules(path)
        model, rules.spec = rules.spec["model"], {}
        size = max(t.get_vocab_size(), END_ID + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        last = np.zeros(size, dtype=bool)
        last[[i for s, i in model["vocab"].items() if s.endswith(model["end_of_word_suffix"])]] = True

        def encode(pieces: list[str]) -> list[bytes]:
            # One call for many pieces: each ends with its only word-end token.
            ids = np.array(t.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=kind)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) != len(pieces):
                raise ValueError("pieces and word ends differ")
            raw, width = ids.tobytes(), ids.itemsize
            at = [0, *(ends * width).tolist()]
            return [raw[a:b] for a, b in zip(at, at[1:])]

        special = {s: np.array([i], dtype=kind).tobytes() for s, i in rules.special.items()}
        # Two-byte ids: twice the usual memory of chunks fits.
        _MEMO[path] = ChunkMemo(rules, encode, special, kind, kept=400_000, slot_bits=21, pool=12_000_000), kind
    return _MEMO[path]


def shards(rows: Iterator, path: str, part: int, limit: int = SHARD_IDS) -> Iterator[tuple]:
    """(part, shard, n_ids, body) of texts that come in order of their ids."""
    memo, kind = library_memo(path)
    end = np.array([END_ID], dtype=kind)
    docs, sizes, parts, n, k = [], [], [], 0, 0
    for doc_ids, texts in rows:
        ids, first = memo.ids_of(texts)
        for d, a, b in zip(doc_ids, first[:-1].tolist(), first[1:].tolist()):
            docs.append(d)
            sizes.append(b - a + 1)
            parts += [ids[a:b], end]
            n += sizes[-1]
            if n >= limit:
                yield part, k, n, pack(docs, sizes, np.concatenate(parts))
                docs, sizes, parts, n, k = [], [], [], 0, k + 1
    if docs:
        yield part, k, n, pack(docs, sizes, np.concatenate(parts))


def write_token_files(df: DataFrame, where: str, path: str, doc_id: str = "doc_id", text: str = "text",
                      limit: int = SHARD_IDS) -> None:
    """Encode ``text`` and write the shards, ascending by ``doc_id``, to ``where``:
    one Parquet file a shard, with columns part, shard, n_ids, body."""
    import pyarrow as pa

    def run(batches):
        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    p = b.slice(at, 256)
                    yield p.column(0).to_pylist(), p.column(1).to_pylist()

        for row in shards(rows(), path, TaskContext.get().partitionId(), limit):
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "n_ids", "body"), row))], schema=pa.schema(
                [("part", pa.int32()), ("shard", pa.int32()), ("n_ids", pa.int64()), ("body", pa.binary())]))

    # (the range key is the id alone: its sample goes to the driver, texts must not)
    ordered = df.select(doc_id, text).repartitionByRange(doc_id).sortWithinPartitions(doc_id, text)
    (ordered.mapInArrow(run, "part int, shard int, n_ids long, body binary")
     .write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(where))


def starts(files: DataFrame) -> DataFrame:
    """part, shard and the number of ids in all shards before it: sums within
    a part, and over the parts (as many as tasks wrote)."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    before = parts.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return files.select("part", "shard", within.alias("within")).join(before, "part").select(
        "part", "shard", (F.col("before") + F.col("within")).alias("shard_start"))


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """part, shard, at (first id in the shard), doc_id, n_tokens and ids_crc32
    of every document, from the files alone."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for part, shard, body in zip(*(c.to_pylist() for c in b.columns)):
                docs, sizes, wm = unpack(body)
                ids = wm.all()
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s): 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(ends - sizes),
                     pa.array(docs, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "shard", "at", "doc_id", "n_tokens", "ids_crc32"])

    bodies = spark.read.parquet(where).select("part", "shard", "body")
    return bodies.mapInArrow(run, "part int, shard int, at long, doc_id long, n_tokens long, ids_crc32 long")


def op9_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded, written as shards and read back."""
    where = scratch_path(spark, "token-shards")
    write_token_files(read(spark, sf_dir, "documents"), where, tokenizer_path())
    files = spark.read.parquet(where)
    return read_token_files(spark, where).join(starts(files), ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
