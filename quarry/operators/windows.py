"""Square windows over images at a cost per pixel that the window's size doesn't change.

An image is cut into tiles; a tile gets its own pixels and a halo of the
window's radius, and a task works on one tile at a time, so images of any size
are many tasks. Sums come from a summed-area table, extrema from running
extrema of blocks as long as the window, forward and back, and medians from the
counts, in summed-area tables, of the pixels up to each level that occurs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 128


def mapped(j: np.ndarray, n: int, border: str) -> np.ndarray:
    """Where the places ``j`` of a line of length n are read, by the border rule."""
    if border == "replicate":
        return np.clip(j, 0, n - 1)
    if border == "reflect":
        m = j % (2 * n)
        return np.where(m >= n, 2 * n - 1 - m, m)
    if border == "reflect101":
        if n == 1:
            return np.zeros_like(j)
        m = j % (2 * (n - 1))
        return np.where(m >= n, 2 * (n - 1) - m, m)
    raise ValueError(border)


def box(a: np.ndarray, k: int) -> np.ndarray:
    """Sums of all k × k windows."""
    s = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def extrema(a: np.ndarray, k: int, op) -> np.ndarray:
    """Extrema (``np.minimum`` or ``np.maximum``) of all k × k windows, along one axis and then the other."""
    for _ in range(2):
        n = len(a)
        rest = -n % k
        fill = np.inf if op is np.minimum else -np.inf
        rows = np.concatenate([a, np.full((rest, a.shape[1]), fill)]).reshape(-1, k, a.shape[1])
        ahead = op.accumulate(rows, axis=1).reshape(-1, a.shape[1])
        back = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1, a.shape[1])
        a = op(back[: n - k + 1], ahead[k - 1: n]).T
    return a


def medians(a: np.ndarray, k: int) -> np.ndarray:
    """Middle values of all k × k windows (k odd)."""
    need = k * k // 2 + 1
    out = np.empty((a.shape[0] - k + 1, a.shape[1] - k + 1))
    left = np.ones(out.shape, bool)
    for level in np.unique(a):
        found = left & (box(a <= level, k) >= need)
        out[found] = level
        left &= ~found
        if not left.any():
            break
    return out


_KINDS = {"sum": lambda a, k: box(a, k), "median": medians, "min": lambda a, k: extrema(a, k, np.minimum),
          "max": lambda a, k: extrema(a, k, np.maximum)}


def _worker(kind: str, radius: int, border: str, tile: int, whole: bool):
    def run(table):
        import pyarrow as pa

        y, x, v = (table[c].to_numpy() for c in ("y", "x", "v"))
        h, w, ty, tx = (table[c][0].as_py() for c in ("_h", "_w", "_ty", "_tx"))
        y0, x0 = ty * tile, tx * tile
        y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
        top, left = max(0, y0 - radius), max(0, x0 - radius)
        known = np.zeros((min(h, y1 + radius) - top, min(w, x1 + radius) - left))
        there = np.zeros(known.shape, bool)
        known[y - top, x - left] = v
        there[y - top, x - left] = True
        rows, cols = np.arange(y0 - radius, y1 + radius), np.arange(x0 - radius, x1 + radius)
        if border == "ignore":  # windows end at the image's edge
            fill = np.inf if kind == "min" else -np.inf
            a = np.full((len(rows), len(cols)), fill)
            ok_r, ok_c = (rows >= 0) & (rows < h), (cols >= 0) & (cols < w)
            a[np.ix_(ok_r, ok_c)] = known
        else:
            a = known[np.ix_(mapped(rows, h, border) - top, mapped(cols, w, border) - left)]
        out = _KINDS[kind](a, 2 * radius + 1)
        at = np.argwhere(there[y0 - top: y1 - top, x0 - left: x1 - left])
        got = out[at[:, 0], at[:, 1]]
        n = len(at)
        return pa.table({"img": pa.array([table["img"][0].as_py()] * n, table["img"].type),
                         "ch": pa.array([table["ch"][0].as_py()] * n, table["ch"].type),
                         "y": pa.array((at[:, 0] + y0).astype(np.int32)), "x": pa.array((at[:, 1] + x0).astype(np.int32)),
                         "v": pa.array(got.astype(np.int64) if whole else got)})
    return run


def windowed(r: DataFrame, kind: str, radius: int, border: str, tile: int | None = None) -> DataFrame:
    """(img, ch, y, x, v) with v the window's ``kind`` (sum, median, min, max)
    around each pixel. Medians and extrema keep the type of v, sums are doubles.
    ``border``: replicate, reflect, reflect101, or ignore (extrema only)."""
    side = tile or max(TILE, 2 * radius)  # a pixel goes to four tiles at most, then
    size = r.groupBy("img").agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"))

    def tiles(c: str):
        return F.explode(F.sequence(F.floor(F.greatest(F.col(c) - radius, F.lit(0)) / side).cast("int"),
                                    F.floor((F.col(c) + radius) / side).cast("int")))

    kept = dict(r.dtypes)
    whole = kind != "sum" and kept["v"] not in ("double", "float")
    rows = r.select("img", "ch", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
                    F.col("v").cast("double").alias("v")).join(size, "img")
    rows = rows.withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x"))
    rows = rows.filter((F.col("_ty") * side < F.col("_h")) & (F.col("_tx") * side < F.col("_w")))
    out = rows.groupBy("img", "ch", "_ty", "_tx").applyInArrow(
        _worker(kind, radius, border, side, whole),
        f"img {kept['img']}, ch {kept['ch']}, y int, x int, v {'bigint' if whole else 'double'}")
    v = F.col("v").cast("double" if kind == "sum" else kept["v"]).alias("v")
    return out.select("img", "ch", F.col("y").cast(kept["y"]).alias("y"), F.col("x").cast(kept["x"]).alias("x"), v)
