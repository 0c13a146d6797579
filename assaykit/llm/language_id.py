"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with FTRL.

A text's lower-cased letters, other characters as one blank, give its n-grams of one to three code points, hashed
into 2^16 slots. A slot's weight in a text is its share of the text's n-grams times its inverse document frequency,
counted over all labelled rows outside the holdout. One logistic regression over the learned languages is trained by
follow-the-regularised-leader with elastic-net penalties, a few rows a step, in a fixed order. Each pass reads the
same sample: about ``max_rows`` rows, as many of each language as there are, one of each language at least, and never
more than twice the larger of ``max_rows`` and the number of languages; a fifth of it chooses the temperature of the
softmax. Weights are dense over the languages, so more than ``max_languages`` of them raise an error; none is left
out. The share of slots with a weight of 0 grows with the l1 penalty. A text is cleaned at once and its n-grams are
counted in chunks that share their last two code points, so chunks change nothing.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row every text is;
a null language teaches nothing; a null id counts as held out; ties go to the first language by code points; repeated
rows are judged alike; a very long text is one row of work; an empty table gives an empty result. Other columns are
kept unless they clash with those added, which win.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name, held_out, named, received, share, text_batches
from assaykit.llm.memory import lean
from assaykit.llm.sums import sum_arrays

SLOTS = 1 << 16
CHUNK = 1 << 18
UNKNOWN = "und"
#: Scales TF-IDF weights, which are shares, to a size that gradient steps suit.
SCALE = 30.0
_OTHER = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def chunks(text: str) -> Iterator[np.ndarray]:
    """Slots of the n-grams of a text's letters, those that start in CHUNK code points at a time."""
    clean = _OTHER.sub(" ", text.lower()).strip()
    if not clean:
        return
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(c), CHUNK):
        part = c[at : at + CHUNK + 2].astype(np.uint64)  # with what the last n-grams reach into
        two = part[:-1] << np.uint64(21) | part[1:]
        three = part[:-2] << np.uint64(42) | two[1:]
        every = np.concatenate([part[:CHUNK], two[:CHUNK], three[:CHUNK]])
        yield ((every * _MIX) >> np.uint64(48)).astype(np.int64)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, TF-IDF weights) of a text."""
    counts = np.zeros(SLOTS, np.int64)
    for g in chunks(text):
        counts += np.bincount(g, minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, SCALE * counts[slots] / max(1, counts.sum()) * idf[slots]


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(for each slot, how many texts have it; number of texts with a letter)."""
    size = SLOTS + 32

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen = np.zeros(SLOTS, bool)
                if has_letter(t):
                    for g in chunks(t):
                        seen[g] = True
                    total[:SLOTS] += seen
                    total[SLOTS] += 1
        return total

    found = sum_arrays(texts, count, size, np.int64)
    return found[:SLOTS], int(found[SLOTS])


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with l1 and l2 penalties; weights are sparse."""

    def __init__(self, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))  # the last row is the constant
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """One step with the summed gradients of a few (slots, values, label)."""
        rows, place = np.unique(np.concatenate([[SLOTS], *(e[0] for e in examples)]), return_inverse=True)
        of = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
        values, place = np.concatenate([e[1] for e in examples]), place[1:]
        w = self.weights(rows)
        parts = values[:, None] * w[place]
        classes = range(w.shape[1])
        logits = np.stack([np.bincount(of, parts[:, k], len(examples)) for k in classes], 1) + w[-1]
        error = softmax(logits)
        error[np.arange(len(examples)), [e[2] for e in examples]] -= 1
        g = np.stack([np.bincount(place, values * error[of, k], len(rows)) for k in classes], 1)
        g[-1] += error.sum(0)  # the constant is the last row
        step = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - step * w
        self.n[rows] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


TEMPERATURES = [float(t) for t in np.geomspace(0.05, 10, 61)]


def fit(docs: DataFrame, *, max_rows: int = 3000, max_languages: int = 1000, passes: int = 3, batch: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """(languages, weights by slot times IDF, constants, temperature); rows of held-out ids are not read."""
    rows = text_batches(docs).where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"), F.col(doc_id).cast("long").alias("_id"))
    frequency, n = document_frequencies(rows.select("_text"))
    idf = np.log((1 + n) / (1 + frequency)) + 1
    # As many rows of each language, at most, so that a rare one is learned as well.
    draw = F.pmod(F.xxhash64("_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = cut(rows.groupBy("_lang").agg(F.count("*").alias("count"), F.min(F.when(F.col("_text").rlike(r"\p{L}"), draw)).alias("least")))
    n_languages = counts.limit(max_languages + 1).count()
    if n_languages > max_languages:
        raise ValueError(f"more than {max_languages} languages are labelled; raise max_languages or merge labels")
    share = max(1, max_rows // max(1, n_languages))
    dealt = rows.join(F.broadcast(counts).withColumnRenamed("_lang", "_l"), F.col("_lang") == F.col("_l"))
    # The row with a language's least draw is taken in any case, so that chance leaves no language out.
    dealt = dealt.withColumn("_first", F.coalesce(draw == F.col("least"), F.lit(False))).where((draw * F.col("count") <= 1.2 * share) | F.col("_first"))
    chosen = cut(dealt.select("_text", "_lang", "_id", "_first").orderBy(F.desc("_first"), F.xxhash64("_id", F.lit("order")), "_id").limit(2 * max(max_rows, n_languages)).drop("_first"))

    def read(batches):
        for some in batches:
            keep, out = [], []
            for i, t in enumerate(some.column(0).to_pylist()):
                if has_letter(t):
                    slots, values = features(t, idf)
                    keep.append(i)
                    out.append(np.concatenate([slots.astype(np.float32), values.astype(np.float32)]).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), some.column(1).take(at), some.column(2).take(at)], names=["x", "lang", "id"])

    found = chosen.mapInArrow(lean(read), "x binary, lang string, id long").collect()
    found.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), r["lang"], bytes(r["x"])))
    seen = sorted({r["lang"] for r in found}, key=lambda s: s.encode())
    if not seen:
        return [], np.zeros((SLOTS, 0), np.float32), np.zeros(0), 1.0
    examples = []
    for r in found:
        x = np.frombuffer(r["x"], np.float32)
        examples.append((x[: len(x) // 2].astype(np.int64), x[len(x) // 2 :].astype(np.float64), seen.index(r["lang"])))
    apart = examples[::5] if len(examples) >= 20 else []
    own = [e for i, e in enumerate(examples) if i % 5] if apart else examples
    learned = {label for *_, label in own}
    own = own + [e for e in apart if e[2] not in learned]  # a language with a single row is learned from it
    model = Ftrl(len(seen), alpha, beta, l1, l2)
    for _ in range(passes):
        for at in range(0, len(own), batch):
            model.learn(own[at : at + batch])
    w = model.weights()
    held = apart or own
    logits = np.array([values @ w[slots] + w[SLOTS] for slots, values, _ in held])
    truth = np.array([label for *_, label in held])
    slack = 1 / (len(truth) + len(seen))  # few rows without an error prove no certainty
    target = np.where(np.arange(len(seen)) == truth[:, None], 1 - slack, slack / max(1, len(seen) - 1))
    loss = [-(target * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in TEMPERATURES]
    return seen, (SCALE * w[:SLOTS] * idf[:, None]).astype(np.float32), w[SLOTS], TEMPERATURES[int(np.argmin(loss))]


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **training) -> DataFrame:
    """docs with held_out, lang_pred and score, the calibrated probability of that language."""
    shared = share(docs.sparkSession, fit(docs, doc_id=doc_id, text=text, **training))

    def predict(texts):
        languages, weights, constants, temperature = received(shared)
        for batch in texts:
            out = []
            for t in batch:
                if not languages or not has_letter(t):
                    out.append((UNKNOWN, 0.0))
                    continue
                total, n = np.zeros(len(languages)), 0
                for g in chunks(t):
                    # The weights of each n-gram, added up: the text's TF-IDF row times the weights.
                    total += np.bincount(g, minlength=SLOTS) @ weights if len(g) > SLOTS else weights[g].sum(0, dtype=np.float64)
                    n += len(g)
                p = softmax((total / max(1, n) + constants) / temperature)
                k = int(np.argmax(p))
                out.append((languages[k], float(p[k])))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    def udf(texts):
        return lean(predict)(texts)

    udf.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(udf, "lang_pred string, score double")(F.col(text).cast("string"))
    kept = docs.drop("lang_pred", "score", "held_out")
    out = free_name(kept, "out")
    return kept.withColumn(out, found).select(*named(kept), held_out(F.col(doc_id)).alias("held_out"), f"{out}.lang_pred", f"{out}.score")
