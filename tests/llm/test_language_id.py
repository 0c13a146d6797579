import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import language_id
from assaykit.llm.language_id import Ftrl, features, fit, has_letter, identify

from .helpers import docs

PARTS = {"xx": ["tha", "ing", "wh", "ore"], "yy": ["ção", "nho", "qua", "ões"], "zz": ["ungen", "sch", "ß", "keit"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_rows_are_recognised(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, k, rng.randint(5, 40)), k, "s") for i, k in enumerate(rng.choice(["xx", "xx", "xx", "yy", "zz"]) for _ in range(500))]
    rows += [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "12 #!", "xx", "s"), (None, text(rng, "yy", 9), "yy", "s"), (1003, text(rng, "zz", 9), None, "s"), rows[4], (1004, text(rng, "zz", 60_000), "zz", "s"), (1005, "日本語", None, "s")]
    got = identify(docs(spark, rows).withColumn("score", F.lit("clash"))).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (not has_letter(r["text"]))
    own = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in own) >= 0.98 * len(own)


def test_held_out_languages_teach_nothing(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, "xx", 10), "xx", "s") for i in range(60)]
    other = [(i, t, "never" if zlib.crc32(str(i).encode()) % 4 == 2 else k, s) for i, t, k, s in rows]
    assert {r["lang_pred"] for r in identify(docs(spark, other)).collect()} == {"xx"}


def test_no_language_is_left_out(spark):
    rng = random.Random(5)
    frame = docs(spark, [(i, text(rng, "xx", 3) if i % 3 else "12", f"l{i % 40:02}", "s") for i in range(1200)])
    assert fit(frame, max_rows=40, max_languages=40, passes=1)[0] == [f"l{i:02}" for i in range(40)]
    with pytest.raises(ValueError, match="more than 39 languages"):
        identify(frame, max_languages=39)


def test_too_many_languages_raise(spark):
    frame = docs(spark, [(i, "abc", f"l{i}", "s") for i in range(1600)])
    with pytest.raises(ValueError, match="more than 1000 languages"):
        identify(frame)


def test_nothing_to_learn(spark):
    got = identify(docs(spark, [(1, "abc", None, "s"), (2, "def", None, "s")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    assert identify(docs(spark, [(1, "a", "xx", "s")]).limit(0)).count() == 0


def slow_counts(text):
    """N-grams by slicing strings."""
    clean = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
    found = Counter()
    padded = f" {clean} "
    for n in (1, 2, 3) if clean else ():
        for i in range(len(padded) - n + 1):
            code = 0
            for ch in padded[i : i + n]:
                code = code << 21 | ord(ch)
            found[code * 0x9E3779B97F4A7C15 % (1 << 64) >> 48] += 1
    return found


def test_features_of_a_long_text_match_brute_force():
    t = (text(random.Random(3), "yy", 120_000) + " 12-日本 ß")[-600_000:]
    assert len(t) == 600_000 > 2 * language_id.CHUNK
    want = slow_counts(t)
    slots, values = features(t, np.ones(language_id.SLOTS))
    total = sum(want.values())
    assert dict(zip(slots.tolist(), (values * total / language_id.SCALE).round().astype(int).tolist(), strict=True)) == want


def test_chunks_change_nothing(monkeypatch):
    for t in ("", "12", "a", "ab", "abc", text(random.Random(3), "yy", 300)):
        want = slow_counts(t)
        for chunk in (1, 2, 3, 7, 100, 10**6):
            monkeypatch.setattr(language_id, "CHUNK", chunk)
            assert Counter(x for g in language_id.chunks(t) for x in g.tolist()) == want


def test_1200_languages_are_learned(spark):
    frame = docs(spark, [(i, f"{chr(0x4E00 + i % 1200)} {chr(0x4E00 + i % 1200)}", f"l{i % 1200:04}", "s") for i in range(4800)])
    languages, *_ = fit(frame, max_rows=2400, max_languages=1500, passes=1)
    assert languages == sorted({f"l{i % 1200:04}" for i in range(4800) if zlib.crc32(str(i).encode()) % 4 != 2})


@pytest.mark.parametrize("name", ["out", "_out", "score", "lang_pred", "Held_Out", "x", "count", "least", "a.b"])
def test_clashing_names(spark, name):
    rng = random.Random(8)
    table = docs(spark, [(i, text(rng, "xx", 5), "xx", "s") for i in range(20)]).selectExpr("doc_id", "text", "lang", f"doc_id * 10 AS `{name}`")
    got = identify(table, passes=1).collect()
    assert {r["lang_pred"] for r in got} == {"xx"} and all(isinstance(r["score"], float) for r in got)
    assert name.lower() in ("score", "lang_pred", "held_out") or all(r[name] == 10 * r["doc_id"] for r in got)


def test_probabilities_are_calibrated(spark):
    """A tenth of the labels are wrong, so no score should be near 1: the mean score is the share of right ones."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        k = rng.choice(["xx", "yy"])
        rows.append((i, text(rng, k, rng.randint(5, 20)), k if rng.random() < 0.9 else "zz", "s"))
    own = [r for r in identify(docs(spark, rows)).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == r["lang"] for r in own) / len(own)
    assert 0.85 <= right <= 0.95 and abs(sum(r["score"] for r in own) / len(own) - right) < 0.05


def test_a_step_is_the_gradient_of_its_rows():
    """One step from zero against the formulas written out."""
    rng = np.random.default_rng(5)
    some = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(4)]
    model = Ftrl(3, 0.5, 1.0, 0.001, 0.001)
    model.learn(some)
    for slot in (*range(50), language_id.SLOTS):
        for k in range(3):
            g = sum((1.0 if slot == language_id.SLOTS else dict(zip(s.tolist(), x.tolist(), strict=True)).get(slot, 0.0)) * (1 / 3 - (label == k)) for s, x, label in some)
            assert np.isclose(model.z[slot, k], g) and np.isclose(model.n[slot, k], g * g)


def test_penalty_makes_weights_sparse():
    rng = random.Random(4)
    kept = []
    for l1 in (0.0, 0.05):
        model = Ftrl(2, 0.5, 1.0, l1, 0.001)
        for k in range(60):
            g, n = np.unique(np.concatenate(list(language_id.chunks(text(rng, ["xx", "zz"][k % 2], 20)))), return_counts=True)
            model.learn([(g, n / n.sum() * 30, k % 2)])
        kept.append((model.weights() != 0).sum())
    assert kept[1] < kept[0]
