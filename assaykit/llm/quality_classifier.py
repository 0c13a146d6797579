"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

A text is read as words in two forms: their letters in lower case, and their shape (``A`` upper-case, ``a`` lower-
case, ``0`` digit, other characters themselves, runs once), so that mark-up noise and shouting show without a list
of words. Each form is hashed to a slot. Every slot has a sparse random index vector of a few +1 and -1; a slot's
word vector is, by random indexing, the sum of the index vectors of its neighbours in the training texts, centred
and scaled to length 1, plus its own index vector. A document is the mean of its words' vectors and of the index
vectors of its shapes. The network (one hidden layer of tanh, numpy, full batches with Adam) is trained on labelled
rows outside the holdout; a fifth of them, set aside, choose the temperature that its logits are divided by, and the
scores are the calibrated probabilities.

Training uses at most ``max_rows`` labelled rows, those with the smallest hash of their id; index vectors and slots
need no corpus. Every row is scored on its whole text. The model, a few megabytes whatever the corpus, is broadcast.

Defined cases: a null or empty text has a pooled vector of zeros and gets the score that the network gives to that;
a null id counts as held out; with labels of one kind, or none, all scores are that kind's share (0.5 without any);
of repeated ids in the labels the lowest label counts; repeated rows are scored alike; a very long text is cut
into words at once, alone, and pooled in steps; an empty table gives an empty result. Other columns are kept unless they clash with those added, which win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, held_out, received, share, small_side, text_batches
from assaykit.llm.memory import lean
from assaykit.llm.sums import sum_arrays

DIM = 48
WORD_SLOTS = 1 << 15
SHAPE_SLOTS = 1 << 10
NONZERO = 4
NEIGHBOURS = 2
FEATURES = 2 * DIM
_MARKS = re.compile(rb"[^a-z0-9\x80-\xff]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
MOST_KNOWN = 150_000
#: Bytes of texts whose words are turned into vectors at once.
PIECE = 1 << 18
#: Words whose vectors are held at once.
STEP = 1 << 16
NAMES = ("score", "predicted", "held_out")


class Slots(dict):
    """For each word its slot of letters and its slot of shape, remembered for the words of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_KNOWN:
            self.clear()
        letters = xxhash.xxh64_intdigest(_MARKS.sub(b"", word.translate(_LOWER))) % WORD_SLOTS
        shape = xxhash.xxh64_intdigest(_RUN.sub(rb"\1", word.translate(_SHAPE))) % SHAPE_SLOTS
        self[word] = code = letters * SHAPE_SLOTS + shape
        return code

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots of letters, slots of shapes) of all words of the texts, and how many each has."""
        split = [t.split() if t else [] for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        code = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        return code // SHAPE_SLOTS, code % SHAPE_SLOTS, n


def some_texts(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """The texts in lists of about PIECE bytes; a longer one is alone."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t or b"")
        if size >= PIECE:
            yield own
            own, size = [], 0
    if own:
        yield own


def index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    out[np.repeat(np.arange(n), NONZERO), rng.integers(0, DIM, n * NONZERO)] = rng.choice([-1.0, 1.0], n * NONZERO)
    return out


def word_vectors(texts: DataFrame, index: np.ndarray) -> np.ndarray:
    """For each slot of letters the vector that its neighbours in the texts give it, with its own."""
    # An index vector is a few signs at a few places, so a neighbour is added at those places only.
    places = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    signs = np.take_along_axis(index, places, 1).astype(np.float64)

    def count(batches):
        slots, total = Slots(), np.zeros(WORD_SLOTS * DIM)
        for batch in batches:
            for some in some_texts(batch.column(0).cast(pa.binary()).to_pylist()):
                words, _, n = slots.read(some)
                of = np.repeat(np.arange(len(n)), n)
                for d in range(1, NEIGHBOURS + 1):
                    pairs = np.flatnonzero(of[d:] == of[:-d])
                    for near in (pairs[i : i + STEP] for i in range(0, len(pairs), STEP)):
                        for own, other in ((words[near + d], words[near]), (words[near], words[near + d])):
                            at = (own[:, None] * DIM + places[other]).ravel()
                            total += np.bincount(at, weights=signs[other].ravel(), minlength=len(total))
        return total

    total = sum_arrays(texts, count, WORD_SLOTS * DIM, np.float32).reshape(WORD_SLOTS, DIM)
    seen = np.abs(total).sum(1) > 0
    if seen.any():
        total[seen] -= total[seen].mean(0)
    length = np.sqrt((total**2).sum(1, keepdims=True))
    return index + np.divide(total, length, out=np.zeros_like(total), where=length > 0)


def pooled(texts: list[bytes | None], slots: Slots, vectors: np.ndarray, shape_index: np.ndarray) -> np.ndarray:
    """A row of features for each text: the means of its words' vectors and of its shapes' index vectors."""
    out = [np.zeros((0, FEATURES), np.float32)]
    for some in some_texts(texts):
        words, shapes, n = slots.read(some)
        x = np.zeros((len(some), FEATURES), np.float32)
        of = np.repeat(np.arange(len(some)), n)
        for i in range(0, len(of), STEP):
            own = of[i : i + STEP]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            x[own[starts], :DIM] += np.add.reduceat(vectors[words[i : i + STEP]], starts, axis=0)
            x[own[starts], DIM:] += np.add.reduceat(shape_index[shapes[i : i + STEP]], starts, axis=0)
        out.append(x / np.maximum(n, 1)[:, None].astype(np.float32))
    return np.concatenate(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Network:
    """logit = tanh((x - mean) / spread @ a + b) @ c + d, divided by the temperature."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.spread, self.temperature, self.constant = np.zeros(FEATURES), np.ones(FEATURES), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.spread @ a + b) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self.logits(x) / self.temperature)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, decay: float) -> None:
        if not len(y) or y.min() == y.max():
            self.constant = float(y[0]) if len(y) else 0.5
            return
        apart = np.arange(len(y)) % 5 == 0 if len(y) >= 20 else np.zeros(len(y), bool)
        if len(set(y[~apart])) < 2:
            apart[:] = False
        own, target = x[~apart].astype(float), y[~apart].astype(float)
        self.mean, self.spread = own.mean(0), own.std(0) + 1e-3
        z = (own - self.mean) / self.spread
        decay = decay + 3 / len(target)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, steps + 1):
            a, b, c, d = self.weights
            h = np.tanh(z @ a + b)
            error = (_sigmoid(h @ c + d) - target) / len(target)
            back = np.outer(error, c) * (1 - h * h)
            slopes = [z.T @ back + decay * a, back.sum(0), h.T @ error + decay * c, error.sum(keepdims=True)]
            for w, g, (m, v) in zip(self.weights, slopes, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        held = apart if apart.any() else ~apart
        logits, slack = self.logits(x[held].astype(float)), 1 / (held.sum() + 2)  # few rows without an error prove no certainty
        truth = np.where(y[held] == 1, 1 - slack, slack)
        loss = [-(truth * np.log(p + 1e-12) + (1 - truth) * np.log(1 - p + 1e-12)).mean() for p in (_sigmoid(logits / t) for t in TEMPERATURES)]
        self.temperature = TEMPERATURES[int(np.argmin(loss))]


TEMPERATURES = [float(t) for t in np.geomspace(0.25, 16, 49)]


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, hidden: int = 24, steps: int = 150, decay: float = 1e-4, seed: int = 7, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
    """(index vectors of shapes, word vectors, network); labels of held-out ids are not read."""
    known = labels.where(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_label"))
    chosen = cut(known.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(max_rows))
    rows = text_batches(docs).select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text")).join(small_side(chosen, max_rows), F.col("_doc") == F.col("_id")).select("_text", F.col("_label").cast("int").alias("_label"), F.col("_id").cast("long").alias("_id"))
    rows = cut(rows)
    index, shape_index = index_vectors(WORD_SLOTS, seed), index_vectors(SHAPE_SLOTS, seed + 1)
    vectors = word_vectors(rows.select("_text"), index)

    def features(batches):
        slots = Slots()
        for batch in batches:
            x = pooled(batch.column(0).cast(pa.binary()).to_pylist(), slots, vectors, shape_index)
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), batch.column(1), batch.column(2)], names=["x", "y", "id"])

    found = rows.mapInArrow(lean(features), "x binary, y int, id long").collect()
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), r["id"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in found]).reshape(-1, FEATURES)
    network = Network(hidden, seed)
    network.train(x, np.array([r["y"] for r in found], np.int64), steps, decay)
    return shape_index, vectors, network


def score_quality(docs: DataFrame, model, *, text: str = "text", threshold: float = 0.7, names: Sequence[str] = NAMES) -> DataFrame:
    """docs with score and predicted (1 from the threshold on)."""
    shared = share(docs.sparkSession, model)

    def run(texts):
        shape_index, vectors, network = received(shared)
        slots = Slots()
        for batch in texts:
            x = pooled([t.encode() if t else None for t in batch], slots, vectors, shape_index)
            yield _series(network.scores(x.astype(float)))

    score: Column = _iterator_udf(run)(F.col(text).cast("string"))
    return text_batches(docs).drop(*names[:2]).withColumn(names[0], score).withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))


def _series(values):
    import pandas as pd

    return pd.Series(values)


def _iterator_udf(run):
    import pandas as pd

    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(run)(texts)

    udf.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(udf, "double")


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", names: Sequence[str] = NAMES, **training) -> DataFrame:
    """docs with score, predicted and held_out, called as names says; columns of those names are replaced."""
    model = fit(docs, labels, doc_id=doc_id, text=text, **training)
    return score_quality(docs, model, text=text, threshold=threshold, names=names).withColumn(names[2], held_out(F.col(doc_id)))
