"""Many linear models of one table, fitted together.

A one-vs-rest classifier with cross-fitted calibration is one convex problem
per class and fold. All problems see the same rows, so their weight vectors
travel together: a pass over the rows adds up the loss and the gradient of
every problem at its own point, and the driver moves each point by its own
quasi-Newton step. The number of passes is that of the slowest problem, not
the sum over all, and what the driver holds is classes x folds x features
numbers, whatever the number of rows.

Rows are sparse: ``idx`` (array<int>) and ``val`` (array<double>).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.session import scratch_path

ROWS = 512  # rows made dense at a time
FILE_BLOCKS = 32  # of a stored file, of which a reader holds a column
FAN_IN = 32  # partial sums that one task, or the driver, adds up
_MEMORY = 10


class Descent:
    """Limited-memory BFGS with backtracking, by question and answer:
    ``point`` is where the loss is wanted next (None when done), ``tell`` takes
    the loss and the gradient there."""

    def __init__(self, start: np.ndarray, tol: float, max_iter: int):
        self.point: np.ndarray | None = start.copy()
        self.x, self.f, self.g = start, math.inf, None
        self.tol, self.left, self.first = tol, max_iter, None
        self.t, self.d, self.pairs = 1.0, None, []
        self.converged = False

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.g is not None:
            slope = float(self.g @ self.d)
            if not f <= self.f + 1e-4 * self.t * slope:
                # the minimum of the parabola through both values and the slope
                dip = -slope * self.t * self.t / (2 * (f - self.f - slope * self.t)) if math.isfinite(f) else 0.0
                self.t = min(max(dip, 0.1 * self.t), 0.5 * self.t)
                self.point = self.x + self.t * self.d if self.t > 1e-12 else None
                self.converged = self.point is None  # no smaller value along a descent direction
                return
            s, y = self.point - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs[1 - _MEMORY:], (s, y, 1.0 / (s @ y))]
        self.x, self.f, self.g = self.point, f, g
        size = float(np.linalg.norm(g))
        self.first = self.first or size
        self.left -= 1
        self.converged = size <= self.tol * max(self.first, 1e-12)
        if self.converged or self.left < 0:
            self.point = None
            return
        self.d = self._direction(g)
        self.t = 1.0 if self.pairs else min(1.0, 1.0 / size)
        self.point = self.x + self.t * self.d

    def _direction(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y, r in reversed(self.pairs):
            a = r * (s @ q)
            kept.append(a)
            q -= a * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(self.pairs, reversed(kept)):
            q += (a - r * (y @ q)) * s
        return -q if g @ q > 0 else -g


def parts_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many tasks read rows that many passes go over: a few hundred passes
    over little data cost what starting their tasks costs."""
    return max(1, min(4 * max(spark.sparkContext.defaultParallelism, 8), -(-rows // per_task)))


def _columns(batch, *names):
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _dense(idx, val, size: int):
    """Blocks of rows of two list columns as dense matrices with a column of ones; each
    with its first row. All are one and the same buffer: a block holds until the next one."""
    off = idx.offsets.to_numpy()
    i, v = idx.values.to_numpy(), val.values.to_numpy()
    wide = size + 1
    buffer = np.zeros((min(ROWS, len(idx)), wide))
    buffer[:, size] = 1.0
    flat = buffer.ravel()
    for at in range(0, len(idx), ROWS):
        n = min(ROWS, len(idx) - at)
        a, b = off[at], off[at + n]
        cells = np.repeat(np.arange(n) * wide, np.diff(off[at: at + n + 1])) + i[a:b]
        flat[cells] = v[a:b]
        yield at, buffer[:n]
        flat[cells] = 0.0


_BLOCK = "label binary, fold binary, n binary, idx binary, val binary"


def _stored_blocks(rows: DataFrame, n_parts: int) -> DataFrame:
    """Rows (label, fold, idx, val) in blocks of ``ROWS``: numbers that many passes go
    over travel as they are, not value by value."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                label, fold, idx, val = _columns(b.slice(at, ROWS), "label", "fold", "idx", "val")
                label, fold = (c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (label, fold))
                cells = label, fold, np.diff(idx.offsets.to_numpy()).astype(np.int32), idx.flatten().to_numpy(), val.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells],
                                                 names=["label", "fold", "n", "idx", "val"])

    path = scratch_path(rows.sparkSession, "svm-rows")
    rows.repartition(n_parts).mapInArrow(run, _BLOCK).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return rows.sparkSession.read.schema(_BLOCK).parquet(path)


def _blocks(batch, size: int):
    """(classes, folds, dense rows with a column of ones) of stored blocks. The rows of
    all blocks lie in one and the same buffer: they hold until the next block."""
    wide = size + 1
    flat = None
    for cells in zip(*_columns(batch, "label", "fold", "n", "idx", "val")):
        label, fold, n, idx, val = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, ("f8", "f8", "i4", "i4", "f8")))
        if flat is None:
            buffer = np.zeros((ROWS, wide))
            buffer[:, size] = 1.0
            flat = buffer.ravel()
        at = np.repeat(np.arange(len(n)) * wide, n) + idx
        flat[at] = val
        yield label, fold, buffer[:len(n)]
        flat[at] = 0.0


def _total(parts: DataFrame, n_parts: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the ``total`` blobs (float64 of ``shape``) that the tasks of
    ``parts`` give, added in tasks while there are more than the driver should add."""
    import pyarrow as pa

    def add(batches):
        out = np.zeros(shape)
        for b in batches:
            for blob in b.column(0):
                out += np.frombuffer(blob.as_buffer()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["total"])

    while n_parts > FAN_IN:
        n_parts = -(-n_parts // FAN_IN)
        parts = parts.repartition(n_parts).mapInArrow(add, "total binary")
    out = np.zeros(shape)
    for r in parts.collect():
        out += np.frombuffer(bytes(r.total)).reshape(shape)
    return out


def _minimise(frame: DataFrame, n_parts: int, starts: list[np.ndarray], at_points, tol: float,
              max_iter: int) -> list[Descent]:
    """Minimise all problems over ``frame``. ``at_points(batch, which, points)``
    gives the losses and gradients (one row a problem) of a batch's rows."""
    import pyarrow as pa

    sc = frame.sparkSession.sparkContext
    runs = [Descent(s, tol, max_iter) for s in starts]
    size = len(starts[0])
    while True:
        which = [k for k, r in enumerate(runs) if r.point is not None]
        if not which:
            return runs
        asked = sc.broadcast(np.stack([runs[k].point for k in which]))  # problems x features numbers

        def run(batches, which=which, asked=asked):
            out = np.zeros((len(which), size + 1))
            for b in batches:
                out += at_points(b, which, asked.value)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["total"])

        got = _total(frame.mapInArrow(run, "total binary"), n_parts, (len(which), size + 1))
        asked.unpersist()
        for k, row in zip(which, got):
            f, g = row[0], row[1:]
            prior = getattr(at_points, "prior", 0.0)
            p = runs[k].point
            runs[k].tell(f + 0.5 * prior * float(p @ p), g + prior * p)


@dataclass(frozen=True)
class _Hinge:
    """C times the squared hinge loss of class against rest, rows of one fold left out, plus half the squared norm."""

    size: int
    c: float
    classes: np.ndarray  # of each problem
    left_out: np.ndarray
    prior: float = 1.0

    def __call__(self, batch, which, points):
        cls, out = self.classes[which], self.left_out[which]
        total = np.zeros((len(which), self.size + 2))
        for label, fold, x in _blocks(batch, self.size):
            y = np.where(label[:, None] == cls, 1.0, -1.0)
            slack = np.maximum(0.0, 1.0 - y * (x @ points.T)) * (fold[:, None] != out)
            total[:, 0] += self.c * (slack * slack).sum(0)
            total[:, 1:] -= 2 * self.c * (y * slack).T @ x
        return total


@dataclass(frozen=True)
class _Sigmoid:
    """Log-loss of 1/(1 + exp(-(a m + b))) against Platt's targets, on the margins of the rows that a fold left out."""

    label: str
    fold: str
    classes: np.ndarray
    folds: np.ndarray
    targets: np.ndarray  # of the rest and of the class, by problem

    def __call__(self, batch, which, points):
        label, fold, margins = _columns(batch, self.label, self.fold, "margins")
        label, fold = label.to_numpy(zero_copy_only=False), fold.to_numpy(zero_copy_only=False)
        m = margins.values.to_numpy().reshape(len(label), -1) if len(label) else np.zeros((0, 1))
        total = np.zeros((len(which), 3))
        for row, (k, p) in enumerate(zip(which, points)):
            rows = fold == self.folds[k]
            x = m[rows, self.classes[k]]
            t = np.where(label[rows] == self.classes[k], self.targets[k, 1], self.targets[k, 0])
            z = p[0] * x + p[1]
            total[row, 0] = (np.logaddexp(0, z) - t * z).sum()
            d = 0.5 * (1 + np.tanh(0.5 * z)) - t
            total[row, 1:] = d @ x, d.sum()
        return total


@dataclass(frozen=True)
class CalibratedSVM:
    """A linear machine and a sigmoid per class and fold; folds answer together."""

    weights: np.ndarray  # folds x classes x (features + 1)
    slopes: np.ndarray  # folds x classes x 2
    passes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        m = np.einsum("nd,fkd->nfk", x, self.weights)
        p = 0.5 * (1 + np.tanh(0.5 * (m * self.slopes[None, ..., 0] + self.slopes[None, ..., 1])))
        total = p.sum(2, keepdims=True)
        p = np.where(total > 0, p / np.where(total > 0, total, 1), 1.0 / p.shape[2])
        return p.mean(1)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``idx`` and ``val``) with ``probs`` and ``prediction``, the first most probable class."""
        import pyarrow as pa

        keep = [f for f in df.schema.fields if f.name not in ("probs", "prediction")]
        size = self.weights.shape[2] - 1
        names = [f.name for f in keep]

        def run(batches):
            for b in batches:
                idx, val = _columns(b, "idx", "val")
                p = np.concatenate([self.probabilities(x) for _, x in _dense(idx, val, size)] or
                                   [np.zeros((0, self.weights.shape[1]))])
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
                best = pa.array(p.argmax(1).astype(float) if len(p) else np.zeros(0))
                yield pa.RecordBatch.from_arrays([*_columns(b, *names), lists, best], names=[*names, "probs", "prediction"])

        schema = StructType([*keep, StructField("probs", ArrayType(DoubleType())), StructField("prediction", DoubleType())])
        return df.select(*names).mapInArrow(run, schema)


def calibrated_svm(train: DataFrame, label: str, fold: str, n_classes: int, size: int, folds: int = 5,
                   c: float = 1.0, max_iter: int = 2000, tol: float = 1e-4) -> CalibratedSVM:
    """Linear classifiers with squared hinge loss and inverse L2 strength ``c``
    (the intercept is a feature of its own), class against rest, once per fold
    without the fold's rows; the margins of these rows give the sigmoid that
    turns the classifier's margins into probabilities. A scored row has the
    mean, over the folds, of the probabilities normalised over the classes.

    ``train`` has ``idx``, ``val``, the class number ``label`` and the fold
    number ``fold``. It is stored once, because every pass reads it."""
    import pyarrow as pa

    spark = train.sparkSession
    n_parts = parts_for(spark, train.count(), 8 * ROWS)
    none_i, none_v = F.array().cast("array<int>"), F.array().cast("array<double>")
    rows = train.select(F.col(label).cast("int").alias("label"), F.col(fold).cast("int").alias("fold"),
                        F.coalesce("idx", none_i).alias("idx"), F.coalesce("val", none_v).alias("val"))
    frame = _stored_blocks(rows, n_parts).persist()
    try:
        n_parts = frame.rdd.getNumPartitions()
        classes = np.tile(np.arange(n_classes), folds)
        left_out = np.repeat(np.arange(folds), n_classes)
        hinge = _Hinge(size, c, classes, left_out)
        fitted = _minimise(frame, n_parts, [np.zeros(size + 1)] * len(classes), hinge, tol, max_iter)
        weights = np.stack([r.x for r in fitted]).reshape(folds, n_classes, size + 1)

        def margins(batches):
            for b in batches:
                for lab, fo, x in _blocks(b, size):
                    m = np.einsum("nd,nkd->nk", x, weights[fo.astype(int)])
                    lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * n_classes, m.ravel())
                    numbers = [pa.array(v, from_pandas=True).cast(pa.int32()) for v in (lab, fo)]
                    yield pa.RecordBatch.from_arrays([*numbers, lists], names=[label, fold, "margins"])

        out = scratch_path(spark, "svm-margins")
        schema = f"{label} int, {fold} int, margins array<double>"
        frame.mapInArrow(margins, schema).write.parquet(out)
        held = spark.read.schema(schema).parquet(out)
        counts = {(r[0], r[1]): r["count"] for r in held.groupBy(fold, label).count().collect()}  # classes x folds rows
        pos = np.array([counts.get((f, k), 0) for f, k in zip(left_out, classes)], float)
        size_of = np.array([sum(n for (f, _), n in counts.items() if f == g) for g in left_out], float)
        targets = np.stack([1 / (size_of - pos + 2), (pos + 1) / (pos + 2)], axis=1)
        sigmoid = _Sigmoid(label, fold, classes, left_out, targets)
        starts = [np.array([0.0, math.log((p + 1) / (n - p + 1))]) for p, n in zip(pos, size_of)]
        slopes = _minimise(held, held.rdd.getNumPartitions(), starts, sigmoid, 1e-6, max_iter)
        return CalibratedSVM(weights, np.stack([r.x for r in slopes]).reshape(folds, n_classes, 2),
                             max(max_iter - min(r.left for r in fitted), 0))
    finally:
        frame.unpersist()
