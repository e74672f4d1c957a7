"""Gradient boosting of several classes on one softmax.

A round fits one small regression tree per class to the residuals of the
softmax over the classes' scores. All trees of a round grow together, a level a
pass: every task adds up, for each class, node, feature and bin, the residuals,
their curvature and the rows; the sums (a few numbers per bin, whatever the
number of rows) decide the splits. Rows of one class that share all their bins
share their scores and residuals in every round: they are counted once and travel
as one row with its number. Such rows carry their binned features and their
scores; the trees since the scores were last written are applied on the fly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quarry.operators.forest import binned as binned_columns
from quarry.operators.linear import _columns, _total, parts_for
from quarry.session import scratch_path

BINS = 64
ROWS = 8192  # a task
REWRITE = 10  # rounds after which the rows' scores are written anew


@dataclass
class Tree:
    """A complete tree: a feature and the last bin that goes left for each inner
    node in level order (all rows go left where a node isn't split), leaf values."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner = (1 << depth) - 1
        return cls(depth, np.zeros(inner, int), np.full(inner, BINS), np.zeros(1 << depth))

    def nodes(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Each row's node among those of a level."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(level):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return at - ((1 << level) - 1)

    def of(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins, self.depth)]


def residuals(scores: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-hot class less softmax, and its curvature |r|(1 − |r|), per row and class."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    r = (y[:, None] == np.arange(scores.shape[1])) - e / e.sum(1, keepdims=True)
    return r, np.abs(r) * (1 - np.abs(r))


def histograms(bins: np.ndarray, r: np.ndarray, h: np.ndarray, n: np.ndarray, trees: list[Tree],
               level: int) -> np.ndarray:
    """[class, node, feature, bin, (residual, curvature, rows)] of some rows, each standing for ``n``."""
    k, f, nodes = r.shape[1], bins.shape[1], 1 << level
    out = np.zeros((k, nodes, f, BINS, 3))
    r, h = r * n[:, None], h * n[:, None]
    for c, tree in enumerate(trees):
        node = tree.nodes(bins, level) * BINS
        for j in range(f):
            slot = node + bins[:, j]
            for m, w in enumerate((r[:, c], h[:, c], n)):
                out[c, :, j, :, m] = np.bincount(slot, w, nodes * BINS).reshape(nodes, BINS)
    return out


def split(hist: np.ndarray) -> tuple[int, int]:
    """Feature and cut of the best split of a node by the squared difference of the sides' mean
    residuals, weighted by their rows (first of equal ones); (0, BINS) where none separates anything."""
    left = hist.cumsum(1)
    total = left[:, -1:, :]
    n_l, n_r = left[..., 2], total[..., 2] - left[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = left[..., 0] / n_l - (total[..., 0] - left[..., 0]) / n_r
        gain = np.where((n_l > 0) & (n_r > 0), n_l * n_r / (n_l + n_r) * gap * gap, 0.0)
    best = int(gain.argmax())
    if gain.flat[best] <= 1e-12:
        return 0, BINS
    return divmod(best, hist.shape[1])


def leaves(hist: np.ndarray, cut: tuple[int, int], classes: int) -> tuple[float, float]:
    """Values of the two leaves below a node of the last level: a Newton step each."""
    f, b = cut
    left = hist[f, : b + 1].sum(0)
    out = []
    for r, h, _ in (left, hist[f].sum(0) - left):
        out.append((classes - 1) / classes * r / h if h > 1e-12 else 0.0)
    return out[0], out[1]


def grow(classes: int, depth: int, summed) -> list[Tree]:
    """The trees of one round; ``summed(trees, level)`` gives the histograms of all rows."""
    trees = [Tree.empty(depth) for _ in range(classes)]
    for level in range(depth):
        hist = summed(trees, level)
        for c, tree in enumerate(trees):
            for node in range(1 << level):
                at = (1 << level) - 1 + node
                tree.feature[at], tree.cut[at] = split(hist[c, node])
                if level == depth - 1:
                    tree.value[2 * node: 2 * node + 2] = leaves(hist[c, node], (tree.feature[at], tree.cut[at]), classes)
    return trees


@dataclass
class BoostedClassifier:
    cuts: list[np.ndarray]
    prior: np.ndarray
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of the features; missing values are above all others."""
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def added(self, scores: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
        out = scores.copy()
        for trees in rounds:
            for c, t in enumerate(trees):
                out[:, c] += self.rate * t.of(bins)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.added(np.tile(self.prior, (len(x), 1)), self.binned(x), self.rounds)

    def transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        """``df`` with ``probs`` and ``prediction``, the first most probable class."""
        import pyarrow as pa

        keep = [f for f in df.schema.fields if f.name not in ("probs", "prediction")]
        names, model = [f.name for f in keep], self

        def run(batches):
            for b in batches:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in _columns(b, "__x")[0].flatten()], axis=1)
                s = model.scores(x)
                e = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
                p = e / e.sum(1, keepdims=True)
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
                best = pa.array(p.argmax(1).astype(float) if len(p) else np.zeros(0))
                yield pa.RecordBatch.from_arrays([*_columns(b, *names), lists, best], names=[*names, "probs", "prediction"])

        x = F.struct(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)]).alias("__x")
        schema = StructType([*keep, StructField("probs", ArrayType(DoubleType())), StructField("prediction", DoubleType())])
        return df.select(*names, x).mapInArrow(run, schema)


def fit_boosting(train: DataFrame, label: str, features: list[str], classes: int, rounds: int = 100, depth: int = 3,
                 rate: float = 0.1, rewrite: int = REWRITE) -> BoostedClassifier:
    """Boosted trees for class numbers 0 to ``classes`` − 1. Features are cut at
    up to ``BINS`` − 1 quantiles; the first scores are the logs of the classes'
    shares. Rows without a label don't count."""
    import pyarrow as pa

    spark = train.sparkSession
    rows = train.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("y"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features)])
    shares = [k / BINS for k in range(1, BINS)]
    got = rows.agg(*[F.percentile_approx(f"x{k}", shares, 10_000).alias(f"q{k}") for k in range(len(features))]).first()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
    n = np.array([counts.get(c, 0) for c in range(classes)], float)
    prior = np.log(np.maximum(n, 1e-9) / max(n.sum(), 1))
    model = BoostedClassifier([np.unique(np.array(q or [], float)) for q in got], prior, rate)

    def first(batches):
        for b in batches:
            y, count, *x = (c.to_numpy(zero_copy_only=False) for c in _columns(b, "y", "count", *keys))
            yield pack(y, count, np.stack(x, axis=1).astype(np.uint8), np.tile(prior, (len(y), 1)))

    def pack(y, count, bins, scores):
        return pa.RecordBatch.from_arrays(
            [pa.array(y, pa.int32()), pa.array(count, pa.int64()), pa.array([r.tobytes() for r in bins], pa.binary()),
             pa.array([r.tobytes() for r in scores], pa.binary())], names=["y", "count", "bins", "scores"])

    def read(b):
        y, count, bins, scores = _columns(b, "y", "count", "bins", "scores")
        return (y.to_numpy(zero_copy_only=False), count.to_numpy(zero_copy_only=False),
                np.frombuffer(b"".join(bins.to_pylist()), np.uint8).reshape(len(b), -1),
                np.frombuffer(b"".join(scores.to_pylist())).reshape(len(b), -1))

    schema = "y int, count bigint, bins binary, scores binary"

    def kept(df: DataFrame) -> tuple[DataFrame, int]:
        path = scratch_path(spark, "boosting")
        df.write.parquet(path)
        frame = spark.read.schema(schema).parquet(path).persist()
        return frame, frame.rdd.getNumPartitions()

    keys = [f"b{k}" for k in range(len(features))]
    names = [f"x{k}" for k in range(len(features))]
    path = scratch_path(spark, "boosting-cells")
    rows.select("y", *binned_columns(names, [c.tolist() for c in model.cuts])).groupBy("y", *keys).count().write.parquet(path)
    cells = spark.read.parquet(path)
    frame, parts = kept(cells.repartition(parts_for(spark, cells.count(), ROWS)).mapInArrow(first, schema))
    since: list[list[Tree]] = []
    try:
        for _ in range(rounds):
            def summed(trees: list[Tree], level: int) -> np.ndarray:
                shape = (classes, 1 << level, len(features), BINS, 3)
                earlier = list(since)

                def run(batches):
                    out = np.zeros(shape)
                    for b in batches:
                        if b.num_rows:
                            y, count, bins, scores = read(b)
                            out += histograms(bins, *residuals(model.added(scores, bins, earlier), y), count, trees, level)
                    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["total"])

                return _total(frame.mapInArrow(run, "total binary"), parts, shape)

            trees = grow(classes, depth, summed)
            model.rounds.append(trees)
            since.append(trees)
            if len(since) >= rewrite and len(model.rounds) < rounds:
                done = list(since)

                def onward(batches):
                    for b in batches:
                        if b.num_rows:
                            y, count, bins, scores = read(b)
                            yield pack(y, count, bins, model.added(scores, bins, done))

                old = frame
                frame, parts = kept(frame.mapInArrow(onward, schema))
                old.unpersist()
                since = []
        return model
    finally:
        frame.unpersist()
