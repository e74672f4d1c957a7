"""Hashed word shingles of whole texts, in numpy over the bytes of many texts.

A-Z are lower-cased, words are the runs without ASCII white space. Words get a
64-bit polynomial hash over their bytes from running sums, shingles a mix of
their words' hashes; a text of fewer words than a shingle has its whole
sequence as the only one, a text without words none.
"""

from __future__ import annotations

import numpy as np

WIDTH = 4
PIECE = 1 << 18  # bytes hashed at a time (cut at white space)

_U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=_U)
_SIZE = 0x589965CC75374CC3

_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _grown(n: int) -> None:
    """Powers of the base and of its inverse, up to n."""
    for k, base in enumerate((_BASE, _BASE_INVERSE)):
        p = _powers[k]
        while len(p) <= n:
            p = np.concatenate([p, p * _U(pow(base, len(p), 1 << 64))])
        _powers[k] = p


def _piece_words(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of a byte array that starts and ends with a blank."""
    inside = ~_BLANK[c]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    _grown(len(c))
    sums = np.cumsum((c.astype(_U) + _U(1)) * _powers[0][: len(c)], dtype=_U)
    h = (sums[end - 1] - sums[start - 1]) * _powers[1][start]
    return start, end, mix(h + (end - start).astype(_U) * _U(_SIZE))


def joined_words(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts (as bytes) joined by blanks; start, end and hash of each word in
    that; and the number of each text's first word (one more entry at the end)."""
    whole = b" " + b" ".join(raws) + b" "
    at = np.cumsum([0, *[len(r) + 1 for r in raws]])
    c = np.frombuffer(whole, np.uint8)
    found, a = [], 0
    while a < len(c) - 1:
        b = min(a + PIECE, len(c) - 1)
        while not _BLANK[c[b]]:
            b += 1
        s, e, h = _piece_words(c[a: b + 1])
        found.append((s + a, e + a, h))
        a = b
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found))
    return whole, starts, ends, hashes, np.searchsorted(starts, at)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry at the end)."""
    *_, hashes, first = joined_words([(t or "").encode("utf-8", "replace").translate(_LOWER) for t in texts])
    return hashes, first


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, first = word_hashes(texts)
    n = max(len(w) - WIDTH + 1, 0)
    g = np.zeros(n, _U)
    for k in range(WIDTH):
        g += w[k: k + n] * _WORD[k]
    g = mix(g)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(g[a: b - WIDTH + 1]))
        elif b > a:
            part = w[a:b] * _WORD[: b - a]
            out.append(mix(part.sum(dtype=_U, keepdims=True) + _U((b - a) * _SIZE % (1 << 64))))
        else:
            out.append(np.zeros(0, _U))
    return out
