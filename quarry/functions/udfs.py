"""Python twins of native operators (the slow path, kept small): a scalar
pandas UDF, a grouped-aggregate pandas UDF and a Python UDTF. Each one is
checked to give the same rows as its native counterpart."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from quarry.functions.text import WHITESPACE

_NON_LETTER = re.compile(f"[^a-z{WHITESPACE}]")
_WS_RUN = re.compile(f"[{WHITESPACE}]+")


PIECE = 256  # texts whose results are held at a time


def _clean_text_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Arrow-batched twin of ``functions.text.clean_text``. Results leave in pieces:
    a batch has a set number of rows, and texts may be long."""
    def one(t):
        if t is None:
            return None
        t = t.strip(WHITESPACE).lower()
        t = _NON_LETTER.sub(" ", t)
        return _WS_RUN.sub(" ", t).strip(WHITESPACE)
    for s in batches:
        for at in range(0, len(s), PIECE):
            yield s.iloc[at: at + PIECE].map(one)


def _otsu_from_histogram(v: pd.Series, n: pd.Series) -> int:
    """Grouped-aggregate twin of the Otsu threshold, fed with one image's
    histogram (≤ 256 rows, never the pixels): maximal
    (N·S0 − n0·S)² / (n0·(N − n0)), lowest threshold on ties, 0 if none."""
    order = np.argsort(v.to_numpy())
    vs = v.to_numpy()[order].astype(np.int64)
    ns = n.to_numpy()[order].astype(np.int64)
    n0 = np.cumsum(ns)
    s0 = np.cumsum(ns * vs)
    tot_n, tot_s = n0[-1], s0[-1]
    ok = n0 < tot_n
    if not ok.any():
        return 0
    num = (tot_n * s0 - n0 * tot_s).astype(np.float64)
    score = np.where(ok, num * num / np.where(ok, (n0 * (tot_n - n0)).astype(np.float64), 1.0), -np.inf)
    best = np.flatnonzero(score == score.max())[0]
    return int(vs[best])


class _PipeTableRows:
    """Python UDTF twin of ``parse_pipe_table``: one output row per cell."""

    _SEP = re.compile(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$")

    def eval(self, md: str):
        if md is None:
            return
        lines = [ln for ln in md.split("\n") if ln.strip() and not self._SEP.match(ln)]
        for r, ln in enumerate(lines):
            inner = re.sub(r"^\||\|$", "", ln.strip())
            for c, cell in enumerate(inner.split("|")):
                yield r, c, cell.strip(), r == 0


# The UDF objects are built on first use: declaring them parses their type
# strings, which needs an active session.
def clean_text_pandas(col):
    return pandas_udf(_clean_text_batches, "string")(col)


def otsu_from_histogram(v, n):
    return pandas_udf(_otsu_from_histogram, "int")(v, n)


def pipe_table_rows_udtf():
    return udtf(_PipeTableRows, returnType="row: bigint, col: bigint, cell: string, is_header: boolean")
