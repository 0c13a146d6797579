import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import quality_classifier
from assaykit.llm.quality_classifier import DIM, NEIGHBOURS, SHAPE_SLOTS, WORD_SLOTS, Network, Slots, classify_quality, fit, index_vectors, pooled, word_vectors
from assaykit.llm.sums import sum_arrays

from .helpers import corpus, docs, prose

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        t = prose(rng, rng.randint(20, 60), 300)
        kind = i % 6
        out.append((i, " ".join(w + rng.choice(["###", "$$$"]) for w in t.split()) if kind == 0 else t.upper() + "!!" if kind == 1 else t))
    return out


def test_held_out_rows_are_judged_well(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0) for i in range(600)], LABELS)
    extra = [(None, None), (5000, ""), (5001, " \n"), (5002, "word " * 30000), (3, rows[3][1])]
    table = docs(spark, rows + extra).withColumn("score", F.lit("clash"))
    got = classify_quality(table, labels).collect()
    assert len(got) == 605 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == held(r["doc_id"]) for r in got)
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 > 1) for r in own) >= 0.97 * len(own)
    assert len({r["score"] for r in got if not (r["text"] or "").strip()}) == 1


def test_labels_of_held_out_rows_change_nothing(spark, rows):
    table = docs(spark, rows[:200])
    labels = [(i, int(i % 6 > 1), 0) for i in range(200)]
    wrong = [(i, 1 - q if held(i) else q, 0) for i, q, _ in labels]
    first, second = (sorted(map(str, classify_quality(table.select("doc_id", "text"), spark.createDataFrame(x, LABELS)).collect())) for x in (labels, wrong))
    assert first == second


def test_one_kind_of_label_and_none(spark, rows):
    table = docs(spark, rows[:20])
    for labels, want in (([(i, 1, 0) for i in range(20)], 1.0), ([], 0.5)):
        assert {r["score"] for r in classify_quality(table, spark.createDataFrame(labels, LABELS)).collect()} == {want}
    assert classify_quality(table.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_training_is_bounded_and_repeatable(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0) for i in range(600)], LABELS)
    a, b = (fit(docs(spark, rows).repartition(n), labels, max_rows=50) for n in (2, 5))
    assert np.allclose(a[1], b[1], atol=1e-4) and np.allclose(a[2].weights[0], b[2].weights[0], atol=1e-2)


def test_slots_and_temperature():
    slots = Slots()
    w, s, n = slots.read(["Thé the THE the### 12".encode(), None, b" x "])
    assert w[1] == w[2] == w[3] != w[0] and len({s[1], s[2], s[3]}) == 3 and n.tolist() == [5, 0, 1]
    net = Network(4, 1)
    net.train(np.random.default_rng(1).normal(size=(100, 96)), np.arange(100) % 2, 5, 1e-3)
    assert net.temperature > 0 and net.constant is None


@pytest.mark.parametrize(("piece", "step"), [(1, 1 << 16), (60, 3), (1 << 18, 7)])
def test_vectors_and_pooling_match_brute_force(spark, monkeypatch, piece, step):
    monkeypatch.setattr(quality_classifier, "PIECE", piece)
    monkeypatch.setattr(quality_classifier, "STEP", step)
    texts = [None, "", " \n", "one", "a b", "A b a B c!! 12 a b", *(t for _, t in corpus(3, 25) if t)]
    index, shape_index = index_vectors(WORD_SLOTS, 7), index_vectors(SHAPE_SLOTS, 8)
    want = np.zeros((WORD_SLOTS, DIM))
    slots = Slots()
    for t in texts:
        w, *_ = slots.read([(t or "").encode()])
        for i, x in enumerate(w):
            for j in range(max(0, i - NEIGHBOURS), min(len(w), i + NEIGHBOURS + 1)):
                if j != i:
                    want[x] += index[w[j]]
    seen = np.abs(want).sum(1) > 0
    want[seen] -= want[seen].mean(0)
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = index + np.where(length > 0, want / np.where(length > 0, length, 1), 0)
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert np.allclose(word_vectors(frame, index), want, atol=1e-4)
    got = pooled([None if t is None else t.encode() for t in texts], Slots(), want.astype(np.float32), shape_index)
    for t, row in zip(texts, got, strict=True):
        w, s, _ = slots.read([(t or "").encode()])
        each = [np.concatenate([want[a], shape_index[b]]) for a, b in zip(w, s, strict=True)] or [np.zeros(2 * DIM)]
        assert np.allclose(row, np.mean(each, axis=0), atol=1e-4)


def test_sparse_and_dense_sums(spark):
    for share in (1, 50):
        def count(batches):
            out = np.zeros(3200)
            for b in batches:
                for x in b.column(0).to_pylist():
                    out[x % 3200 // share * share] += x
            return out

        want = np.zeros(3200)
        for x in range(5000):
            want[x % 3200 // share * share] += x
        assert np.array_equal(sum_arrays(spark.range(5000).repartition(7), count, 3200), want)


def test_probabilities_are_calibrated(spark):
    """A tenth of the labels are wrong: scores are near 0.9 and 0.1, not near 1 and 0."""
    rng = random.Random(4)
    rows = [(i, " ".join(w + "###" * (i % 2) for w in prose(rng, 30, 300).split())) for i in range(3000)]
    labels = [(i, (i + 1) % 2 if rng.random() < 0.9 else i % 2, 0) for i in range(3000)]
    truth = {i: q for i, q, _ in labels}
    own = [r for r in classify_quality(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect() if r["held_out"]]
    for k in (0, 1):
        some = [r for r in own if r["doc_id"] % 2 == k]
        assert abs(sum(r["score"] for r in some) / len(some) - sum(truth[r["doc_id"]] for r in some) / len(some)) < 0.1


@pytest.mark.parametrize("name", ["score", "predicted", "HELD_OUT", "x", "_id", "_doc", "_label", "quality", "a.b"])
def test_clashing_names(spark, rows, name):
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0) for i in range(60)], LABELS)
    got = classify_quality(docs(spark, rows[:60]).selectExpr("doc_id", "text", f"doc_id * 10 AS `{name}`"), labels, steps=5).collect()
    assert len(got) == 60 and all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert name.lower() in ("score", "predicted", "held_out") or all(r[name] == 10 * r["doc_id"] for r in got)
