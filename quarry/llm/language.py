"""Operator 5, language identification by a bidirectional gated network over bytes.

The network reads a segment's bytes in both directions, gives every byte
position a distribution over the languages, and a document's probabilities
are the mean over all positions of its whole text. Segments are the runs
between ASCII white space (and every ``LONGEST_SEGMENT`` bytes of a longer
run), where the recurrence starts anew; a worker thus computes a segment once
and remembers its sums, which changes no result.

Training is backpropagation through time in numpy on the driver, on a bounded
sample: ``DOCS`` documents of each language (smallest md5 of the id), and of
their words ``WORDS`` occurrences of each language. Only rows with a language
whose crc32(id) mod 4 is not 2 are used; text is the only input.

Defined results: a null text or one without a letter is ``und`` with score 0.
Ties go to the language that sorts first. Without any labelled row every text
is ``und``. A long text is read whole, segment by segment. A null id is never
held out and its row may teach. Repeated rows give repeated results; an empty table gives an
empty result. ``identify`` keeps all columns; ``lang_pred`` and ``score``
replace columns of these names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quarry.llm.chunks import split
from quarry.llm.common import read, words

DOCS = 300
WORDS = 12_000
HIDDEN = 16
STEPS = 700
BATCH = 256
LONGEST_SEGMENT = 64
REMEMBERED = 150_000
MIN_SCORE = 0.35


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pad(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments (longest first) as a byte matrix, and their lengths."""
    sizes = np.array([len(s) for s in segments])
    width = int(sizes[0])
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), np.uint8).reshape(-1, width), sizes


def mirrored(m: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's bytes from its end."""
    at = np.maximum(sizes[:, None] - 1 - np.arange(m.shape[1])[None, :], 0)
    return np.take_along_axis(m, at, axis=1)


@dataclass
class ByteGRU:
    """Weights of both directions (x: byte table, u: recurrence) and of the output layer."""

    languages: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> ByteGRU:
        r = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        p = {}
        for d in "fb":
            p["x" + d] = normal(256, 3 * hidden, scale=0.3)
            p["u" + d] = normal(hidden, 3 * hidden, scale=hidden ** -0.5)
            p["v" + d] = normal(hidden, len(languages), scale=hidden ** -0.5)
        p["c"] = np.zeros(len(languages), np.float32)
        return ByteGRU(languages, p)

    def _scan(self, m: np.ndarray, active: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States after each byte; at step t only the first active[t] rows go on."""
        x, u = self.p["x" + d], self.p["u" + d]
        k = u.shape[0]
        h = np.zeros((len(m), k), np.float32)
        out = np.zeros((m.shape[1], len(m), k), np.float32)
        for t, n in enumerate(active):
            a, before = x[m[:n, t]], h[:n].copy() if tape is not None else h[:n]
            g = before @ u
            zr = _sigmoid(a[:, : 2 * k] + g[:, : 2 * k])
            z, r = zr[:, :k], zr[:, k:]
            new = np.tanh(a[:, 2 * k:] + r * g[:, 2 * k:])
            if tape is not None:
                tape.append((n, before, z, r, new, g[:, 2 * k:]))
            h[:n] = new + z * (before - new)
            out[t, :n] = h[:n]
        return out

    def _unscan(self, m: np.ndarray, tape: list, grad_out: np.ndarray, d: str, grads: dict) -> None:
        """Backpropagation through time for one direction."""
        u = self.p["u" + d]
        k = u.shape[0]
        dh = np.zeros((len(m), k), np.float32)
        gx, gu = np.zeros_like(self.p["x" + d]), np.zeros_like(u)
        for t in range(len(tape) - 1, -1, -1):
            n, before, z, r, new, cand = tape[t]
            g = dh[:n] + grad_out[t, :n]
            da = g * (1 - z) * (1 - new * new)
            dz = g * (before - new) * z * (1 - z)
            dr = da * cand * r * (1 - r)
            np.add.at(gx, m[:n, t], np.concatenate([dz, dr, da], axis=1))
            back = np.concatenate([dz, dr, da * r], axis=1)
            gu += before.T @ back
            dh[:n] = g * z + back @ u.T
        grads["x" + d], grads["u" + d] = gx, gu

    def _layout(self, m: np.ndarray, sizes: np.ndarray):
        steps = np.arange(m.shape[1])
        active = (sizes[None, :] > steps[:, None]).sum(axis=1)
        turn = np.maximum(sizes[None, :] - 1 - steps[:, None], 0)
        inside = sizes[None, :] > steps[:, None]
        return active, turn, inside, np.arange(len(m))[None, :]

    def position_probabilities(self, m: np.ndarray, sizes: np.ndarray, tapes: tuple | None = None):
        """(position, segment, language) probabilities, and what training needs."""
        active, turn, inside, cols = self._layout(m, sizes)
        f = self._scan(m, active, "f", tapes and tapes[0])
        b = self._scan(mirrored(m, sizes), active, "b", tapes and tapes[1])[turn, cols]
        s = f @ self.p["vf"] + b @ self.p["vb"] + self.p["c"]
        e = np.exp(s - s.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), inside, f, b, turn, cols

    def segment_sums(self, segments: list[bytes]) -> np.ndarray:
        """Per segment: the probabilities summed over its positions, and their number."""
        out = np.zeros((len(segments), len(self.languages) + 1))
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        for at in range(0, len(order), 2048):
            part = order[at: at + 2048]
            m, sizes = pad([segments[i] for i in part])
            if m.shape[1] == 0:
                continue
            probs, inside, *_ = self.position_probabilities(m, sizes)
            out[part, :-1] = np.where(inside[:, :, None], probs, 0).sum(axis=0)
            out[part, -1] = sizes
        return out

    def fit(self, segments: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH,
            seed: int = 7) -> ByteGRU:
        """Adam on the cross-entropy of every position."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = r.integers(0, len(segments), batch)
            pick = sorted(pick, key=lambda i: -len(segments[i]))
            m, sizes = pad([segments[i] for i in pick])
            tapes: tuple = ([], [])
            probs, inside, f, b, turn, cols = self.position_probabilities(m, sizes, tapes)
            g = probs.copy()
            g[:, np.arange(batch), labels[pick]] -= 1
            g *= inside[:, :, None] / inside.sum()
            grads = {"c": g.sum(axis=(0, 1)), "vf": np.tensordot(f, g, ([0, 1], [0, 1])),
                     "vb": np.tensordot(b, g, ([0, 1], [0, 1]))}
            gb = np.zeros_like(b)
            np.add.at(gb, (turn, np.broadcast_to(cols, turn.shape)), (g @ self.p["vb"].T) * inside[:, :, None])
            self._unscan(m, tapes[0], g @ self.p["vf"].T, "f", grads)
            self._unscan(mirrored(m, sizes), tapes[1], gb, "b", grads)
            rate = 0.01 * (0.1 ** (step / steps))
            for k, v in grads.items():
                v = np.clip(v, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                step_by = (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
                self.p[k] = (self.p[k] - rate * step_by).astype(np.float32)
        return self


def cut_segments(word: str) -> list[bytes]:
    raw = word.encode("utf-8", "replace")
    return [raw[i: i + LONGEST_SEGMENT] for i in range(0, len(raw), LONGEST_SEGMENT)]


class Pooler:
    """Document probabilities from remembered word sums."""

    def __init__(self, net: ByteGRU):
        self.net, self.known = net, {}
        self.rows = np.zeros((0, len(net.languages) + 2))

    def _learn(self, new: list[str]) -> None:
        pieces = [cut_segments(w) for w in new]
        sums = self.net.segment_sums([s for p in pieces for s in p])
        first = np.cumsum([0, *[len(p) for p in pieces[:-1]]])
        rows = np.zeros((len(new), sums.shape[1] + 1))
        rows[:, :-1] = np.add.reduceat(sums, first)
        rows[:, -1] = [w.isalpha() or any(map(str.isalpha, w)) for w in new]
        self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, rows])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        docs = [[w for w in split(t or "") if w] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
        new = list(set().union(*docs).difference(self.known))
        if new:
            self._learn(new)
        out = []
        for ws in docs:
            at = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
            total = self.rows[at].sum(axis=0)
            if not total[-1]:
                out.append(("und", 0.0))
                continue
            p = total[:-2] / total[-2]
            k = int(p.argmax())
            out.append((self.net.languages[k], round(min(1.0, max(0.0, float(p[k]))), 6)))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_words(df: DataFrame, docs: int = DOCS, per_language: int = WORDS) -> DataFrame:
    """(lang, word): at most ``per_language`` rows a language. Both picks are
    row numbers below a limit, which each task applies before any exchange."""
    labelled = df.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    pick = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    ids = (labelled.select("doc_id", "lang").withColumn("n", F.row_number().over(pick))
           .filter(F.col("n") <= docs).select("doc_id").distinct())
    texts = labelled.join(F.broadcast(ids), "doc_id", "left_semi")  # docs * languages rows at most
    found = texts.select("lang", "doc_id", F.posexplode(words(F.col("text"))).alias("at", "word"))
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "at")), "word")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("lang", "word")


def train(df: DataFrame) -> ByteGRU | None:
    """A network fitted on the bounded sample of ``df`` (doc_id, text, lang)."""
    rows = sorted((r.lang, r.word) for r in training_words(df).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    pairs = [(s, languages.index(lang)) for lang, w in rows for s in cut_segments(w)]
    return ByteGRU.fresh(languages).fit([s for s, _ in pairs], np.array([k for _, k in pairs]))


_POOLERS: dict[bytes, Pooler] = {}


def identify(df: DataFrame, net: ByteGRU | None, text: str = "text", pred: str = "lang_pred",
             score: str = "score") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` of every whole text."""
    import pyarrow as pa

    keep = [f for f in df.schema.fields if f.name not in (pred, score)]
    names = [f.name for f in keep]
    if net is None:
        return df.select(*[F.col(f"`{n}`") for n in names], F.lit("und").alias(pred), F.lit(0.0).alias(score))

    def run(batches):
        pooler = Pooler(net)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = pooler.predict(part.column(part.schema.get_field_index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(n)) for n in names],
                     pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=[*names, pred, score])

    return df.mapInArrow(run, StructType([*keep, StructField(pred, StringType()), StructField(score, DoubleType())]))


def filter_documents(df: DataFrame) -> DataFrame:
    """The rows of ``df`` whose language is known with a score of ``MIN_SCORE`` or more."""
    pred, score = ("__" + "_" * max(map(len, df.columns)) + n for n in ("pred", "score"))  # names that df doesn't have
    d = identify(df, train(df), "text", pred, score)
    return d.filter((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE)).drop(pred, score)


def op5_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = identify(docs.select("doc_id", "text"), train(docs))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
