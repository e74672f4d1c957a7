"""Operator 12, a quality classifier that learns which passages matter.

A document is a bag of passages of up to 64 words. Every passage becomes a
vector of measures (shares of byte classes, of capital, repeated and distinct
words, line ends, ...) and of hashed words; an encoder turns it into 32
features; a gated attention (tanh times sigmoid, softmax over the document)
weighs the passages, and the weighted mean of the encodings is scored by a
logistic unit. Only documents carry labels; the weights of the passages are
learned from them, by gradients written out in numpy.

Training takes at most ``DOCS`` labelled documents a label value, in the order
of an md5 of the id, and at most ``PASSAGES`` passages of each, evenly spread
(documented bounds of the fit alone). Scoring reads whole texts: a long one is
cut at white space into pieces of about a megabyte, and the attention's sums
are carried from piece to piece, so a text of any length is scored in bounded
memory besides the text itself.

Defined results: a null, empty or blank text is one passage of zeros and gets
the score of that. The score depends on the text alone, so equal texts have
equal scores and repeated rows repeated results. Of several label rows of an
id the highest value counts; null labels count as missing, and a null id is
never labelled or held out. Without any labelled row, or with one label value
only, there is no network and every score is the smoothed share of label 1
((ones + 1) / (rows + 2)). An empty table gives no rows. Extra columns are
kept by ``score_documents`` and ignored by the query; ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from quarry.llm.common import read
from quarry.llm.shingles import joined_words

WORDS = 64  # a passage
BUCKETS = 128  # hashed words
DOCS, PASSAGES = 2500, 256  # a label value; a document
PIECE = 1 << 20  # bytes of a text measured at a time
GROUP = 1 << 21  # bytes of several texts measured together

_HIDDEN, _GATE = 32, 16
_ROUNDS, _BATCH, _RATE, _DECAY = 40, 64, 0.01, 1e-4

# Classes of bytes: other, blank, line end, lower, capital, digit, symbol, mark, beyond ASCII.
_CLASSES = 9
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, 9, 11, 12, 13]] = 1
_CLASS[10] = 2
_CLASS[97:123] = 3
_CLASS[65:91] = 4
_CLASS[48:58] = 5
_CLASS[list(b"#*$%&|<>@^~_=+\\/{}[]")] = 6
_CLASS[list(b".,;:!?'\"()-")] = 7
_CLASS[128:] = 8
_MEASURES = _CLASSES + 9


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _measured(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of some texts, and the first passage of each text (one entry more)."""
    whole, start, end, hashes, first = joined_words(raws)
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // WORDS))
    begins = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((begins[-1], _MEASURES + BUCKETS), np.float32)
    if not len(start):
        return x, begins
    text_of = np.repeat(np.arange(len(raws)), n_words)
    passage = begins[text_of] + (np.arange(len(start)) - first[text_of]) // WORDS
    head = np.flatnonzero(np.diff(passage, prepend=-1))  # first word of each passage that has one
    at = passage[head]
    tail = np.concatenate([head[1:], [len(start)]]) - 1
    count = (tail - head + 1).astype(np.float32)
    c = _CLASS[np.frombuffer(whole, np.uint8)]
    a, b = start[head], end[tail]
    size = np.maximum(b - a, 1).astype(np.float32)
    caps = lower = None
    for k in range(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(c == k, dtype=np.int32)])
        x[at, k] = (sums[b] - sums[a]) / size
        if k == 3:
            lower = sums[end] - sums[start]
        elif k == 4:
            caps = sums[end] - sums[start]
    same_text = np.diff(text_of, prepend=-1) == 0
    again = same_text & np.concatenate([[False], hashes[1:] == hashes[:-1]])
    order = np.lexsort((hashes, passage))
    p, h = passage[order], hashes[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
    last = c[end - 1]

    def share(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(np.float32), head) / count

    length = (end - start).astype(np.float32)
    x[at, _CLASSES] = np.log1p(count)
    x[at, _CLASSES + 1] = np.log(np.add.reduceat(length, head) / count)
    x[at, _CLASSES + 2] = share(length == 1)
    x[at, _CLASSES + 3] = share((caps > 1) & (lower == 0))
    x[at, _CLASSES + 4] = share((caps > 0) & (lower > 0))
    x[at, _CLASSES + 5] = np.bincount(p[fresh], minlength=begins[-1])[at] / count
    x[at, _CLASSES + 6] = share(again)
    x[at, _CLASSES + 7] = share(last == 6)
    x[at, _CLASSES + 8] = share(last == 7)
    slot = passage * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64)
    found = np.bincount(slot, minlength=begins[-1] * BUCKETS).reshape(-1, BUCKETS)
    x[at, _MEASURES:] = found[at] / np.sqrt(count)[:, None]
    return x, begins


def _pieces(raw: bytes) -> list[bytes]:
    """A text cut at white space into pieces of about PIECE bytes (a longer run without any stays whole)."""
    if len(raw) <= PIECE:
        return [raw]
    out, a = [], 0
    while a < len(raw):
        b = a + PIECE
        while b < len(raw) and raw[b] not in b" \t\n\v\f\r":
            b += 1
        out.append(raw[a:b])
        a = b
    return out


def passages(text: str | None, most: int | None = None) -> np.ndarray:
    """The vectors of a text's passages; of more than ``most``, that many evenly spread."""
    found = [_measured([p])[0] for p in _pieces((text or "").encode("utf-8", "replace"))]
    x = np.concatenate(found)
    if most and len(x) > most:
        x = x[np.linspace(0, len(x) - 1, most).astype(int)]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """The parameters, by name; see the module's docstring."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = 12) -> Network:
        r = np.random.default_rng(seed)
        mean, scale = x.mean(0), x.std(0) + 0.02

        def normal(*shape: int) -> np.ndarray:
            return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)

        w = {"W": normal(x.shape[1], _HIDDEN), "b": np.zeros(_HIDDEN), "V": normal(_HIDDEN, _GATE),
             "U": normal(_HIDDEN, _GATE), "w": normal(_GATE), "c": normal(_HIDDEN), "d": np.zeros(1)}
        return cls(mean, scale, w)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled input, encoding, the two gates and the attention's logit of each passage."""
        p = self.weights
        s = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(s @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return s, h, t, g, (t * g) @ p["w"]

    def loss_and_gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean log-loss of the bags ``begins[k]:begins[k + 1]`` and its gradient by every parameter."""
        p = self.weights
        s, h, t, g, e = self.encode(x)
        sizes = np.diff(begins)
        bag = np.repeat(np.arange(len(y)), sizes)
        e = np.exp(e - np.maximum.reduceat(e, begins[:-1])[bag])
        a = e / np.add.reduceat(e, begins[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, begins[:-1])
        o = z @ p["c"] + p["d"][0]
        loss = np.mean(np.logaddexp(0, o) - y * o)
        do = (_sigmoid(o) - y) / len(y)
        dz = do[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, begins[:-1])[bag])
        du = de[:, None] * p["w"]
        dt, dg = du * g * (1 - t * t), du * t * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dh *= 1 - h * h
        return loss, {"W": s.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                      "c": z.T @ do, "d": np.array([do.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 13) -> Network:
        """Adam with weight decay over batches of bags in seeded order."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        step, steps = 0, _ROUNDS * -(-len(bags) // _BATCH)
        for _ in range(_ROUNDS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), _BATCH):
                pick = order[at: at + _BATCH]
                begins = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])])
                _, grads = self.loss_and_gradients(np.concatenate([bags[k] for k in pick]), begins, y[pick])
                step += 1
                rate = _RATE * (1 - (step - 1) / steps)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    ahead = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.weights[k] = self.weights[k] - rate * (ahead + _DECAY * self.weights[k])
        return self

    def pooled(self, x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per bag: the largest attention logit, and the sums of exp(logit - it) and of that times the encoding."""
        _, h, _, _, e = self.encode(x)
        top = np.maximum.reduceat(e, begins[:-1])
        w = np.exp(e - np.repeat(top, np.diff(begins)))
        return top, np.add.reduceat(w, begins[:-1]), np.add.reduceat(w[:, None] * h, begins[:-1])

    def _scores(self, total: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        return _sigmoid((weighted / total[..., None]) @ self.weights["c"] + self.weights["d"][0])

    def score_long(self, raw: bytes) -> float:
        """The score of one text by pieces, the attention's sums carried along."""
        top, total, weighted = -np.inf, 0.0, np.zeros(_HIDDEN)
        for piece in _pieces(raw):
            t, n, s = (v[0] for v in self.pooled(*_measured([piece])))
            most = max(top, t)
            total = total * np.exp(top - most) + n * np.exp(t - most)
            weighted = weighted * np.exp(top - most) + s * np.exp(t - most)
            top = most
        return float(self._scores(np.array([total]), weighted[None])[0])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The scores of whole texts: short ones together, long ones alone."""
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        out = np.zeros(len(raws))
        group, size = [], 0
        for k, raw in enumerate(raws):
            if len(raw) > PIECE:
                out[k] = self.score_long(raw)
                continue
            if size + len(raw) > GROUP:
                self._score_group(raws, group, out)
                group, size = [], 0
            group.append(k)
            size += len(raw)
        self._score_group(raws, group, out)
        return out

    def _score_group(self, raws: list[bytes], group: list[int], out: np.ndarray) -> None:
        if group:
            _, total, weighted = self.pooled(*_measured([raws[k] for k in group]))
            out[group] = self._scores(total, weighted)


def training_texts(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> DataFrame:
    """(key, quality, text): at most ``most`` documents a label value, none of them held out."""
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    # Ids first: only the labels that have a document count.
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.withColumn("key", F.md5(F.col("doc_id").cast("string")))
    # Only keys below a share that holds the first ``most`` of each value with room to spare are ordered.
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows
    share = {q: min(1.0, (1.2 * most + 100) / n) for q, n in counts.items()}
    limit = F.lit("")
    for q, part in share.items():
        limit = F.when(F.col("quality") == q, F.lit(f"{int(part * 0xFFFFFFFF):08x}" + "g")).otherwise(limit)
    pick = Window.partitionBy("quality").orderBy("key", "doc_id")
    known = known.filter(F.col("key") < limit).withColumn("n", F.row_number().over(pick)).filter(F.col("n") <= most)
    known = known.select("doc_id", "quality", "key")
    # (two label values, ``most`` ids each; of rows that repeat an id, the least text)
    return (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .groupBy("key", "quality").agg(F.min("text").alias("text")))


@dataclass
class Constant:
    """The answer where there is nothing to tell apart."""

    share: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> Network | Constant:
    """A classifier fitted on the bounded sample of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    The passages are measured where the texts are; the driver gets their vectors."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for key, q, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = passages(text, PASSAGES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([q], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                    names=["key", "quality", "x"])

    sample = training_texts(docs, labels, most).withColumn("quality", F.col("quality").cast("int"))
    rows = sorted((r.key, r.quality, bytes(r.x)) for r in
                  sample.mapInArrow(run, "key string, quality int, x binary").collect())
    y = np.array([q for _, q, _ in rows], float)
    if len(set(y)) < 2:
        return Constant(float((y.sum() + 1) / (len(y) + 2)))
    bags = [np.frombuffer(x, np.float32).reshape(-1, _MEASURES + BUCKETS) for _, _, x in rows]
    return Network.fresh(np.concatenate(bags)).fit(bags, y)


def score_documents(df: DataFrame, net: Network | Constant, text: str = "text", score: str = "score") -> DataFrame:
    """``df`` with the score of every whole text."""
    import pyarrow as pa

    keep = [f for f in df.schema.fields if f.name != score]
    names = [f.name for f in keep]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = net.score(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(got, pa.float64())],
                    names=[*names, score])

    return df.mapInArrow(run, StructType([*keep, StructField(score, DoubleType())]))


def op12_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the network learned from the labels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    d = score_documents(docs, net).drop("text")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))
