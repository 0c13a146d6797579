"""Quality rules whose cutoffs are chosen from labelled rows with a bound on false rejections.

Each text gets counts (words, their code points, symbols, repeated lines, words in repeated 5-word windows). A fixed
base rule fails texts that are too short or repeat themselves. Beyond it there are a few signals, larger for worse
texts, and one fixed path of cutoffs from lenient to strict: each step tightens one signal's cutoff, so a text that a
step rejects is rejected by all later ones. The labelled rows are a holdout, as the path doesn't depend on them. In
each stratum (language) the steps are tested in their order: of the good labelled rows that the base rule leaves, so
many are rejected by any signal at this step; the step holds if the exact binomial (Clopper-Pearson) upper bound on
their share is within ``max_false_rejection``. The search stops at the first step that doesn't hold, so one test level
per stratum is enough (fixed-sequence testing); the levels are ``risk`` divided by the number of strata (Bonferroni).
With probability ``1 - risk`` or more no stratum loses more than ``max_false_rejection`` of those texts by the cutoffs
of all signals together. A stratum with too few labelled rows gets no cutoff: by default about 220 good rows of each
of four strata are needed, none of them rejected.

Defined cases: a null text has no words and fails the base rule; a null stratum is a stratum of its own; of repeated
ids in the labels the highest label counts, so that rejecting it counts as false; without labels nothing but the base
rule rejects; a signal equal to its cutoff, as those of texts that tie, is not rejected; repeated rows are judged
alike; a text is read at once, whatever its length, one at a time; an empty table gives an empty result. Other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, small_side, text_batches
from assaykit.llm.memory import lean

STATS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
WINDOW = 5
#: Signal and its cutoffs, from lenient to strict; a text above a cutoff is rejected.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols_per_char": (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "repeated_lines_per_word": (0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03),
    "repeated_words": (0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0),
}
#: The path: at its k-th step, from 1, that signal gets that cutoff; the signals take turns.
PATH: list[tuple[str, float]] = [(s, grid[i]) for i in range(max(map(len, GRIDS.values()))) for s, grid in GRIDS.items() if i < len(grid)]


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words covered by a WINDOW-word window that occurs twice or more; equal numbers are equal words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key, span = ids[:n].copy(), distinct
    for i in range(1, WINDOW):
        if span > (1 << 62) // max(1, distinct):
            _, key = np.unique(key, return_inverse=True)
            span = len(key)
        key = key * distinct + ids[i : i + n]
        span *= distinct
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    if not len(starts):
        return 0
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[starts] += 1
    cover[starts + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def text_stats(raw: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a UTF-8 text."""
    if not raw:
        return 0, 0, 0, 0, 0
    words = raw.split()
    solid = np.frombuffer(raw.translate(None, SPACE), np.uint8)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return (
        len(words),
        int(((solid & 0xC0) != 0x80).sum()),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(numbers)),
    )


def document_stats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """A row of STATS for each document."""

    def run(batches):
        for batch in batches:
            stats = [text_stats(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*stats, strict=True)] if stats else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return text_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), STATS)


def signals() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_char": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeated_lines_per_word": F.col("n_dup_lines") / words,
        "repeated_words": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def first_step() -> Column:
    """The first step of the path that rejects a text; one more than the path has if none does."""
    named = signals()
    return F.least(*[F.when(named[s] > cutoff, F.lit(k)).otherwise(F.lit(len(PATH) + 1)) for k, (s, cutoff) in enumerate(PATH, 1)])


def at_most(failures: int, n: int, p: float) -> float:
    """The binomial probability of at most so many failures among n, at a share of p.

    It is the regularised incomplete beta function I(1 - p; n - failures, failures + 1), by its continued fraction,
    which takes about the square root of n steps whatever the number of failures.
    """
    if failures >= n or p <= 0:
        return 1.0
    a, b, x = n - failures, failures + 1, 1 - p
    if x > (a + 1) / (a + b + 2):  # the fraction converges fast on one side of the mean only
        return 1 - _beta_share(b, a, p)
    return _beta_share(a, b, x)


def _beta_share(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(1_000_000):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        value *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (value - 1)


def upper_bound(failures: int, n: int, level: float) -> float:
    """The exact binomial upper confidence bound: the share at which so few failures have probability level."""
    if failures >= n:
        return 1.0
    low, high = failures / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(failures, n, mid) > level else (low, mid)
    return high


def choose(n: int, rejected: list[int], share: float, level: float) -> int:
    """How many steps of the path hold in a stratum with n good rows, of which each step rejects so many."""
    for k, failures in enumerate(rejected):
        if failures > n * share or at_most(failures, n, share) > level:
            return k
    return len(rejected)


def cutoffs(stats: DataFrame, labels: DataFrame, *, max_false_rejection: float, risk: float) -> DataFrame:
    """(stratum, steps, cut_<signal> for each signal), of stats with base_failed and first_step; one row for each stratum with good rows."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")
    counts = [F.count_if(F.col("first_step") <= k).alias(f"step_{k}") for k in range(1, len(PATH) + 1)]
    by_stratum = cut(stats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts))
    level = risk / max(1, by_stratum.count())

    def run(batches):
        for batch in batches:
            out: dict = {"stratum": [], "steps": [], **{f"cut_{s}": [] for s in GRIDS}}
            for row in batch.to_pylist():
                steps = choose(row["n"], [row[f"step_{k}"] for k in range(1, len(PATH) + 1)], max_false_rejection, level)
                last = dict(PATH[:steps])
                out["stratum"].append(row["stratum"])
                out["steps"].append(steps)
                for s in GRIDS:
                    out[f"cut_{s}"].append(last.get(s))
            yield pa.RecordBatch.from_arrays([pa.array(out["stratum"], pa.string()), pa.array(out["steps"], pa.int32()), *[pa.array(out[f"cut_{s}"], pa.float64()) for s in GRIDS]], names=list(out))

    return by_stratum.mapInArrow(run, "stratum string, steps int, " + ", ".join(f"cut_{s} double" for s in GRIDS))


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    *,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_false_rejection: float = 0.02,
    risk: float = 0.05,
    doc_id: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """The counts of each document with base_failed, rejected_by (signals above their cutoff) and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = document_stats(docs, doc_id=doc_id, text=text, stratum=stratum)
    stats = cut(counted.withColumns({"base_failed": failed, "first_step": first_step()}))
    limits = small_side(cut(cutoffs(stats, labels, max_false_rejection=max_false_rejection, risk=risk)).withColumnRenamed("stratum", "s"), 10_000)
    named = signals()
    broken = F.array_compact(F.array(*[F.when(named[s] > F.col(f"cut_{s}"), F.lit(s)) for s in GRIDS]))
    return (
        stats.join(limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
        .withColumn("rejected_by", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.col("first_step") > F.coalesce("steps", F.lit(0))))
        .select(*counted.columns, "base_failed", "rejected_by", "kept")
    )
