"""Encoding of whole texts from remembered chunks and pieces.

The tokenizer's rules never look across ASCII white space, so a text's ids are
those of its chunks (runs without it) one after the other, and a chunk's ids
are those of its pieces (pre-tokens). A worker remembers the ids of chunks
and of pieces; only new pieces go to the encoder.

Chunks are found in numpy: a table of ``1 << SLOT_BITS`` slots holds, at the
place that a chunk's hash names, its 64-bit hash, its first eight bytes, and
where its ids lie in a pool. A new chunk takes the slot of an older one. A
full pool is emptied with the table. Pieces are in a dictionary of at most
``KEPT`` entries; when it is full, further ones live for one batch, and
after ``TURNS`` times its size of these it starts anew.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Callable, Iterable

import numpy as np

from quarry.llm.shingles import joined_words

SLOT_BITS = 20
POOL = 6_000_000
KEPT = 200_000
TURNS = 10
LONGEST = 48

_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # masks of the first k bytes
_BLANK = "\t\n\x0b\x0c\r"
# White space as the split pattern's engine sees it.
_WHITE = r"\t-\r \x85\xa0  -     　"


def split(text: str) -> list[str]:
    """The chunks of a text; blanks next to each other leave empty strings."""
    for c in _BLANK:
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


# What a tokenizer file must ask for around its model. The rules
# below do just this; a file with others is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
         "byte_fallback": False, "ignore_merges": False}


def refuse_other(spec: dict) -> None:
    """Raise for a tokenizer file whose rules aren't those built in here."""
    model = spec.get("model") or {}
    asked = [("normalizer", spec.get("normalizer"), NORMALIZER), ("pre_tokenizer", spec.get("pre_tokenizer"), PRE_TOKENIZER),
             ("decoder", spec.get("decoder"), None), ("post_processor", spec.get("post_processor"), None),
             *[(f"model.{k}", model.get(k), v) for k, v in MODEL.items()]]
    for name, got, want in asked:
        if got != want:
            raise ValueError(f"tokenizer file with another {name}: {got!r}")
    if not model.get("end_of_word_suffix"):
        raise ValueError("tokenizer file without a word end")
    odd = [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]
           or "<" not in t["content"]]
    if odd:
        raise ValueError(f"tokenizer file with other kinds of added tokens: {odd}")


class Rules:
    """What the tokenizer file does before its model: special strings stand for
    themselves, the rest is brought to NFC, lower-cased and cut by the pattern.
    A file that asks for anything else is refused."""

    def __init__(self, path: str):
        import regex

        self.spec = json.load(open(path, encoding="utf-8"))
        refuse_other(self.spec)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._piece = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_WHITE}\p{{L}}\p{{N}}]+")
        self._special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case is taken character by character: no final sigma
                return self._piece.findall("".join(map(str.lower, text)))
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[:-1].isalpha() and text[-1] in ".,":
            return [text[:-1], text[-1]]
        return self._piece.findall(text)

    def pieces(self, chunk: str) -> list[str]:
        if "<" not in chunk or not self._special.search(chunk):
            return self._plain(chunk)
        out, at = [], 0
        for m in self._special.finditer(chunk):
            out += [*self._plain(chunk[at:m.start()]), m[0]]
            at = m.end()
        return out + self._plain(chunk[at:])


class Memory:
    """A bounded dictionary from strings to bytes."""

    def __init__(self, kept: int, first: dict):
        self.known, self._first, self._kept, self._passed = dict(first), first, kept, 0

    def keep(self, found: dict[str, bytes]) -> None:
        """Remember new entries while there is room."""
        room = self._kept - len(self.known)
        if room >= len(found):
            self.known.update((k, v) for k, v in found.items() if len(k) <= LONGEST)
            return
        self._passed += len(found)
        if self._passed > TURNS * self._kept:
            self.known, self._passed = dict(self._first), 0


class ChunkMemo:
    """``ids_of(texts)`` gives the ids of all texts in one array, and where each text's begin.

    ``encode_new`` takes a list of pieces and gives the bytes of each;
    ``special`` has the bytes of the special strings; ``kind`` is an id's type."""

    def __init__(self, rules: Rules, encode_new: Callable[[list[str]], Iterable[bytes]], special: dict[str, bytes],
                 kind: str = "<u4", kept: int = KEPT, slot_bits: int = SLOT_BITS, pool: int = POOL):
        self._rules, self._encode, self._pieces = rules, encode_new, Memory(kept, special)
        self._kind, self._bits, self._most = kind, slot_bits, pool
        self._empty()

    def _empty(self) -> None:
        n = 1 << self._bits
        self._hash, self._head = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self._at, self._size = np.zeros(n, np.uint32), np.zeros(n, np.uint16)
        self._pool, self._used = np.zeros(1 << 16, self._kind), 0

    def _store(self, raw: bytes) -> int:
        """Put ids at the end of the pool; where they begin."""
        ids = np.frombuffer(raw, self._kind)
        at, end = self._used, self._used + len(ids)
        if end > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros(max(len(self._pool), end), self._kind)])
        self._pool[at:end] = ids
        self._used = end
        return at

    def ids_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self._used > self._most:
            self._empty()
        whole, start, end, h, first = joined_words([(t or "").encode("utf-8", "replace") for t in texts])
        # The first eight bytes: with the hash they are the chunk's identity.
        eight = np.ndarray(len(whole), "<u8", whole + b" " * 8, strides=(1,))
        head = eight[start] & _FIRST[np.minimum(end - start, 8)]
        slot = (h >> np.uint64(64 - self._bits)).astype(np.int64)
        hit = (self._hash[slot] == h) & (self._head[slot] == head)
        at, size = self._at[slot].astype(np.int64), self._size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            at[miss], size[miss] = self._learn(whole, start, end, h, head, slot, miss)
        before = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(at - before[:-1], size) + np.arange(before[-1])
        return self._pool[take], before[first]

    def _learn(self, whole, start, end, h, head, slot, miss) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks that aren't in the table: place and number in the pool."""
        _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
        new = miss[one]
        raw = self._encoded([whole[a:b].decode("utf-8") for a, b in zip(start[new].tolist(), end[new].tolist())])
        size = np.array([len(r) for r in raw]) // np.dtype(self._kind).itemsize
        at = self._store(b"".join(raw)) + np.cumsum(size) - size
        keep = (end[new] - start[new] <= LONGEST) & (size < 1 << 16)
        s = slot[new][keep]
        self._hash[s], self._head[s], self._at[s], self._size[s] = h[new][keep], head[new][keep], at[keep], size[keep]
        # (of two new chunks with one slot the last assignment wins in all four arrays alike)
        return at[back], size[back]

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        gc.disable()  # only lists of strings come and go here; none refers back
        try:
            cut = list(map(self._rules.pieces, chunks))
            known = self._pieces.known
            fresh = list(set().union(*cut).difference(known))
            found = dict(zip(fresh, self._encode(fresh))) if fresh else {}
            out = [b"".join([known[p] if p in known else found[p] for p in ps]) for ps in cut]
            self._pieces.keep(found)
            return out
        finally:
            gc.enable()
