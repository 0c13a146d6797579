import random

import pytest
from pyspark.sql import functions as F

from assaykit.llm.common import text_hash
from assaykit.llm.substring_dedup import LETTERS, occurrences, remove_repeats

from .helpers import corpus, docs, prose, words


def brute(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            owner = first.get(tuple(w[k : k + window]))
            if i is not None and owner is not None and owner < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(map(str, out))


def rows_of(seed):
    rng = random.Random(seed)
    rows = corpus(seed, 80)
    passage = prose(rng, 30)
    w = passage.split()
    rows += [(300, passage), (301, " ".join(w[3:16])), (302, "\n".join(w[:12])), (303, passage + " " + passage), (299, " ".join(w[10:]))]
    rows += [(400, "a " * 3000), (401, "a " * 14), (402, "a " * 12), (None, passage), (None, passage), (301, " ".join(w[3:16])), (303, "other text " + passage), (-5, " ".join(w[5:20]))]
    rows += [(500 + i, passage + f" tail{i}") for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1500, 1 << 22])
def test_matches_brute_force(spark, block):
    rows = rows_of(21)
    table = docs(spark, rows).withColumn("n_words", F.lit("clash"))
    got = remove_repeats(table.repartition(3), block_bytes=block)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text"]
    assert sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])) for r in got.collect()) == brute(rows)


def test_hash_is_sparks(spark):
    texts = ["", "a", "é 日本", "x" * 1000]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h"))
    assert all(r["h"] == text_hash(r["t"].encode()) for r in frame.collect())
    assert spark.range(1).select(F.xxhash64(F.lit(None).cast("string")).alias("h")).first()["h"] == text_hash(None)


def test_words_of_several_letters():
    n = len(LETTERS) ** 2 + 500
    many = {b" ".join(b"%d" % i for i in range(n)): (1, 1), b" ".join(b"%d" % i for i in range(4000, 4040)): (2, 2), b"x " * 12 + b"y": (3, 4), b"x " * 12 + b"z": (5, 5)}
    found = occurrences(many, 13)
    short = b" ".join(b"%d" % i for i in range(4000, 4040))
    assert found == {short: (list(range(28)), [1] * 28), max(many, key=len): (list(range(4000, 4028)), [1] * 28), b"x " * 12 + b"y": ([0], [3])}


def test_occurrences_against_brute_force():
    for seed in range(40):
        rng = random.Random(seed)
        texts = {}
        for _ in range(30):
            t = " ".join(rng.choice("abc") for _ in range(rng.randint(1, 25))).encode()
            low = rng.randrange(9)
            texts[t] = (low, low + rng.choice([0, 0, 2]))
        ids = {}
        for t, (low, high) in texts.items():
            w = t.split()
            for i in range(len(w) - 3):
                ids.setdefault(tuple(w[i : i + 4]), set()).update((low, high))
        want = {}
        for t in texts:
            w = t.split()
            hits = [(i, min(ids[g])) for i in range(len(w) - 3) if len(ids[g := tuple(w[i : i + 4])]) > 1]
            if hits:
                want[t] = tuple(map(list, zip(*hits, strict=True)))
        assert occurrences(texts, 4) == want


@pytest.mark.parametrize("name", ["i", "h", "out", "marks", "_i", "_h", "_out", "_starts", "_lengths", "starts", "text_hash", "anchors", "I", "N_Removed"])
def test_clashing_names(spark, name):
    shared = " ".join(f"s{i}" for i in range(13))
    table = docs(spark, [(1, shared), (2, "x " + shared)]).selectExpr("doc_id", "text", f"doc_id * 10 AS `{name}`")
    got = remove_repeats(table).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["kept_text"]) for r in got] == [(0, shared), (13, "x")]
    assert name == "N_Removed" or [r[name] for r in got] == [10, 20]


def test_no_repeats_at_all(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 40, 10**9)) for i in range(20)]
    shared = " ".join(f"s{i}" for i in range(13))
    assert remove_repeats(docs(spark, rows)).agg(F.sum("n_removed")).first()[0] == 0
    assert remove_repeats(docs(spark, [*rows, (7, shared), (7, shared + " x")])).agg(F.sum("n_removed")).first()[0] == 0


def test_empty_table(spark):
    assert remove_repeats(docs(spark, [(1, "a")]).limit(0)).count() == 0
