"""Random forests on a few features of many rows.

A forest that cuts each feature into at most ``BINS`` bins can't tell rows apart
that share all their bins. All it takes from the table is how many rows of each
class lie in a cell of the grid of bins; one aggregation counts them, and the
cells are bounded by the product of the bins, whatever the number of rows. A
row's bootstrap draws are Poisson numbers of mean 1, so the draws of a cell's n
rows add up to a Poisson number of mean n, which is drawn at once.

Trees are dealt over tasks: a task grows its trees a level at a time (Gini
impurity, a fresh random choice of features per node, no split without a gain),
and the trees are stored as one row each, never on the driver. To score rows,
their distinct cells go through the trees (tasks add up the answers of their
trees) and are joined back to the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.linear import _columns, _total
from quarry.session import scratch_path

BINS = 32
MAX_CELLS = 1 << 24  # the grid's size; wider tables need Spark ML's forest
BROADCAST = 1 << 19  # cells whose answers are broadcast
TREES = 4  # a task
MIN_GAIN = 1e-14  # below it: rounding

SCHEMA = "tree int, feature array<int>, cut array<int>, left array<int>, share array<double>"


# ---------------------------------------------------------------- bins and cells

def cuts_of(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Places to cut each column: at all of its values if these are few, else at
    up to ``bins`` − 1 quantiles. A row lies in the bin of the cuts below its value."""
    shares = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(c, shares, 10_000).alias(f"q{k}") for k, c in enumerate(names)],
                   *[F.approx_count_distinct(c).alias(f"n{k}") for k, c in enumerate(names)]).first()
    few = [k for k in range(len(names)) if got[f"n{k}"] <= 2 * bins]
    sets = rows.agg(*[F.collect_set(names[k]).alias(f"s{k}") for k in few]).first() if few else None
    out = []
    for k in range(len(names)):
        values = {v for v in (sets[f"s{k}"] if k in few else ()) if not math.isnan(v)}
        if k in few and len(values) <= bins:
            out.append(sorted(values)[:bins - 1])
        else:
            out.append(sorted({v for v in got[f"q{k}"] or () if not math.isnan(v)}))
    return out


def binned(names: list[str], cuts: list[list[float]]) -> list[Column]:
    """Bins (``b0``, ``b1``, …) of the columns; missing values are above all others."""
    out = []
    for k, (c, at) in enumerate(zip(names, cuts)):
        value, bin_ = F.coalesce(F.col(c), F.lit(float("nan"))), F.lit(0)
        for v in at:
            bin_ = bin_ + (value > F.lit(float(v))).cast("int")
        out.append(bin_.cast("int").alias(f"b{k}"))
    return out


def features_of(df: DataFrame, features: str, *keep: str) -> tuple[DataFrame, list[str]]:
    """The vector column ``features`` as the columns x0, x1, …"""
    first = df.select(features).first()
    names = [f"x{k}" for k in range(first[0].size if first else 0)]
    x = df.select(*keep, vector_to_array(features).alias("__x"))
    return x.select(*keep, *[F.get("__x", F.lit(k)).alias(n) for k, n in enumerate(names)]), names


def counted(cells: DataFrame, width: int, by: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``cells``: b0, …, label, and ``by`` (a number) → the distinct cells [cell, bin]
    and the rows [by, cell, class]; a cell a row reaches the driver for every class."""
    names = [f"b{k}" for k in range(width)]
    got = cells.groupBy(*([by] if by else []), *names, "label").count().toArrow()
    read = lambda c: got.column(c).to_numpy().astype(int)
    bins = np.stack([read(n) for n in names], axis=1) if got.num_rows else np.zeros((0, width), int)
    cell, at = np.unique(bins, axis=0, return_inverse=True)
    label, part = read("label"), read(by) if by else np.zeros(got.num_rows, int)
    out = np.zeros((int(part.max(initial=0)) + 1, len(cell), int(label.max(initial=0)) + 1))
    np.add.at(out, (part, at.reshape(-1), label), read("count"))
    return cell.astype(np.uint8), out


# ---------------------------------------------------------------- one tree

def best_splits(at: np.ndarray, bins: np.ndarray, w: np.ndarray, total: np.ndarray,
                allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature (−1: none gains) and last bin to the left for each node; ``at``: node
    of each cell, ``w``: its rows by class, ``total``: the nodes' rows by class."""
    n, rows = len(total), total.sum(1)
    whole = (total ** 2).sum(1) / rows ** 2
    gain, feature, cut = np.full(n, MIN_GAIN), np.full(n, -1), np.zeros(n, int)
    for j in range(bins.shape[1]):
        of = np.flatnonzero(allowed[at, j])
        if not len(of):
            continue
        slot, back = np.unique(at[of] * 256 + bins[of, j], return_inverse=True)
        node = slot // 256
        sums = np.stack([np.bincount(back, w[of, c], len(slot)) for c in range(w.shape[1])], axis=1)
        first = np.flatnonzero(np.diff(node, prepend=-1))
        length = np.diff(np.append(first, len(slot)))
        running = sums.cumsum(0)
        left = running - np.repeat(running[first] - sums[first], length, axis=0)
        right = total[node] - left
        n_l, n_r = left.sum(1), right.sum(1)
        inside = n_r > 0.5
        purity = (left ** 2).sum(1) / n_l + (right ** 2).sum(1) / np.where(inside, n_r, 1.0)
        g = np.where(inside, purity / rows[node] - whole[node], -1.0)
        top = np.maximum.reduceat(g, first)
        where = np.flatnonzero(g == np.repeat(top, length))
        place = where[np.flatnonzero(np.diff(node[where], prepend=-1))]  # the first of equal cuts
        better = top > gain[node[first]]
        k = node[first][better]
        gain[k], feature[k], cut[k] = top[better], j, slot[place][better] % 256
    return feature, cut


def grow(bins: np.ndarray, counts: np.ndarray, depth: int, rng) -> tuple[np.ndarray, ...]:
    """A tree on a bootstrap draw of the cells' rows: per node its feature (−1: a
    leaf), last bin to the left, left child (the right one follows), class shares."""
    w = rng.poisson(counts).astype(float)
    drawn = w.sum(1) > 0
    bins, w = bins[drawn].astype(int), w[drawn]
    f, classes = bins.shape[1], counts.shape[1]
    tries = math.ceil(math.sqrt(f))
    if not len(w):
        return np.array([-1]), np.array([0]), np.array([0]), np.full((1, classes), 1 / classes)
    at, n, made, out = np.zeros(len(w), int), 1, 1, []
    for level in range(depth + 1):
        total = np.stack([np.bincount(at, w[:, c], n) for c in range(classes)], axis=1)
        feature, cut, left = np.full(n, -1), np.zeros(n, int), np.zeros(n, int)
        mixed = (total > 0).sum(1) > 1
        if level < depth and mixed.any():
            open_ = mixed[at]
            bins, w, at = bins[open_], w[open_], at[open_]
            allowed = np.zeros((n, f), bool)
            np.put_along_axis(allowed, rng.random((n, f)).argsort(1)[:, :tries], True, axis=1)
            feature, cut = best_splits(at, bins, w, total, allowed)
        inner = feature >= 0
        rank = np.cumsum(inner) - 1
        left[inner] = made + 2 * rank[inner]
        out.append((feature, cut, left, total / total.sum(1, keepdims=True)))
        if not inner.any():
            break
        go = inner[at]
        bins, w, at = bins[go], w[go], at[go]
        at = 2 * rank[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        n = 2 * int(inner.sum())
        made += n
    return tuple(np.concatenate(part) for part in zip(*out))


def answers(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """Class shares of the leaf that each cell comes to."""
    feature, cut, left, share = tree
    node, rows = np.zeros(len(bins), int), np.arange(len(bins))
    while True:
        inner = feature[node] >= 0
        if not inner.any():
            return share[node]
        node = np.where(inner, left[node] + (bins[rows, feature[node]] > cut[node]), node)


# ---------------------------------------------------------------- many trees

def grown(spark: SparkSession, bins: np.ndarray, counts: np.ndarray, trees: int, depth: int, seed: int) -> DataFrame:
    """The trees of a forest, a row each (lazy); tree k is drawn from the seed and k alone."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                *ints, share = grow(bins, counts, depth, np.random.default_rng([seed, k]))
                lists = [pa.array([v.astype(t)]) for v, t in zip((*ints, share.ravel()), ("i4", "i4", "i4", "f8"))]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *lists],
                                                 names=["tree", "feature", "cut", "left", "share"])

    return spark.range(0, trees, 1, -(-trees // TREES)).mapInArrow(run, SCHEMA)


def summed_answers(trees: DataFrame, parts: int, bins: np.ndarray, classes: int, firsts: list[int]) -> np.ndarray:
    """[first, cell, class]: mean answers of the first 100, 200, … trees (``firsts``)."""
    import pyarrow as pa

    shape = (len(firsts), len(bins), classes)

    def run(batches):
        out = np.zeros(shape)
        for b in batches:
            tree, *cols = _columns(b, "tree", "feature", "cut", "left", "share")
            for i, k in enumerate(tree.to_pylist()):
                *ints, share = (c[i].values.to_numpy() for c in cols)
                got = answers((*ints, share.reshape(-1, classes)), bins)
                for m, first in enumerate(firsts):
                    if k < first:
                        out[m] += got
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["total"])

    return _total(trees.mapInArrow(run, "total binary"), parts, shape) / np.array(firsts)[:, None, None]


class CellForestModel(Model, HasFeaturesCol, MLWritable, MLReadable):
    """Trees in a table at ``path``, the cuts of the features."""

    def __init__(self, cuts=(), classes: int = 0, trees: int = 0, path: str = ""):
        super().__init__()
        self.cuts, self.classes, self.trees, self.path = list(cuts), classes, trees, path

    def _transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probs`` (mean shares over the trees) and ``prediction``."""
        import pyarrow as pa

        spark, width = df.sparkSession, len(self.cuts)
        names = [f"x{k}" for k in range(width)]
        keys = [f"__b{k}" for k in range(width)]
        base = df.drop("probs", "prediction")
        x = base.withColumn("__x", vector_to_array(self.getFeaturesCol()))
        x = x.select(*base.columns, *[F.get("__x", F.lit(k)).alias(n) for k, n in enumerate(names)])
        rows = x.select(*base.columns, *[b.alias(k) for b, k in zip(binned(names, self.cuts), keys)])
        got = rows.select(*keys).distinct().toArrow()
        bins = np.stack([got.column(k).to_numpy() for k in keys], axis=1).astype(np.uint8)
        parts = -(-self.trees // TREES)
        stored = spark.read.schema(SCHEMA).parquet(self.path).repartition(parts, "tree")
        p = summed_answers(stored, parts, bins, self.classes, [self.trees])[0]
        answer = pa.table({**{k: pa.array(bins[:, i].astype(np.int32)) for i, k in enumerate(keys)},
                           "probs": pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * self.classes, p.ravel()),
                           "prediction": pa.array(p.argmax(1).astype(float))})
        answer = spark.createDataFrame(answer)
        return rows.join(F.broadcast(answer) if len(bins) <= BROADCAST else answer, keys).drop(*keys)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader(cls)


class _ForestWriter(MLWriter):
    def __init__(self, model: CellForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={
            "cuts": m.cuts, "classes": m.classes, "trees": m.trees})
        self.sparkSession.read.schema(SCHEMA).parquet(m.path).write.parquet(f"{path.rstrip('/')}/trees")


class _ForestReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CellForestModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls(meta["cuts"], meta["classes"], meta["trees"], f"{path.rstrip('/')}/trees")
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class CellForest(Estimator, HasFeaturesCol, HasLabelCol, HasSeed):
    """Random forest classifier for a few features; labels are numbers from 0."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels below the root", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", numTrees=100, maxDepth=30, seed=42):
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> CellForestModel:
        cuts, bins, counts = training_cells(df, self.getLabelCol(), self.getFeaturesCol())
        trees, path = self.getOrDefault(self.numTrees), scratch_path(df.sparkSession, "forest")
        grown(df.sparkSession, bins, counts[0], trees, self.getOrDefault(self.maxDepth), self.getSeed()).write.parquet(path)
        return CellForestModel(cuts, counts.shape[2], trees, path)._set(featuresCol=self.getFeaturesCol())


def training_cells(df: DataFrame, label: str, features: str, held: Column | None = None):
    """The cuts of the training rows (those not ``held``), the cells of all rows and
    their rows [held, cell, class]. Rows without a label don't count."""
    known = df.filter(F.col(label).isNotNull())
    flag = (F.lit(False) if held is None else held).cast("int")
    x, names = features_of(known.withColumn("__held", flag).withColumn("__label", F.col(label).cast("int")),
                           features, "__held", "__label")
    cuts = cuts_of(x.filter(F.col("__held") == 0), names)
    if math.prod(len(c) + 1 for c in cuts) > MAX_CELLS:
        raise ValueError("too many features for a forest of cells: use Spark ML's")
    cells = x.select(*binned(names, cuts), F.col("__label").alias("label"), F.col("__held").alias("held"))
    bins, counts = counted(cells, len(names), "held")
    return cuts, bins, counts


def held_out_scores(df: DataFrame, label: str, features: str, held: Column, trees: list[int], depths: list[int],
                    seed: int) -> dict[int, list[float]]:
    """Accuracy on the rows ``held`` of forests grown on the others: depth → a score
    for each number of trees. The rows are read once, for their cells."""
    spark = df.sparkSession
    _, bins, counts = training_cells(df, label, features, held)
    at, most, out = np.arange(len(bins)), max(trees), {}
    if len(counts) < 2:  # no row is held out
        return {depth: [math.nan] * len(trees) for depth in depths}
    for depth in depths:
        p = summed_answers(grown(spark, bins, counts[0], most, depth, seed), -(-most // TREES), bins, counts.shape[2], trees)
        out[depth] = [float(counts[1][at, q.argmax(1)].sum() / counts[1].sum()) for q in p]
    return out
