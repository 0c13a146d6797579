import os
import random
from ast import literal_eval

from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm.quality_classifier import classify_quality

from .helpers import docs, prose, words
from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as grouped
from .test_mixing import targets
from .test_substring_dedup import brute as deduped


def make(spark, folder):
    rng = random.Random(31)
    items = [(i, prose(rng, 20)) for i in range(5)]
    passage = prose(rng, 60)
    rows = []
    for i in range(300):
        t = prose(rng, rng.randint(30, 90))
        kind = rng.random()
        if kind < 0.1:
            t = " ".join(w + "###" for w in t.split())
        elif kind < 0.2 and rows:
            t = rng.choice(rows)[1]
        elif kind < 0.25:
            t += " " + passage
        elif kind < 0.3:
            t += " " + rng.choice(items)[1].upper()
        rows.append((i, t, "en", rng.choice("aaab")))
    rows += [(900, passage, "en", "b"), (901, None, None, None), (902, "", "en", "a"), (None, prose(rng, 40), "en", "a"), (None, prose(rng, 40), "en", None), rows[7]]
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in t), 0) for i, t, *_ in rows[:200]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def plain(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source").collect()]


def test_each_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = make(spark, folder)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = frame.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{folder}/{k}")
        before, frame = frame, spark.read.parquet(f"{folder}/{k}")
        seen.append((before, frame))
        if k < 4:
            assert frame.columns == columns
    (a, b), (_, c), (_, d), (_, e), (_, f) = seen

    good = classify_quality(a, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
    assert sorted(map(str, plain(good))) == sorted(map(str, plain(b)))
    assert not any("###" in (t or "") for _, t, *_ in plain(b)) and len(plain(b)) > 250

    kept = {r.split(",")[0].strip("(") for r in grouped(plain(b)) if r.split(",")[0].strip("(") == r.split(",")[2].strip(" )")}
    assert {str(r[0]) for r in plain(c)} == kept and len([r for r in plain(c) if r[0] is not None]) == len(kept) - 1

    want = [literal_eval(x) for x in deduped([r[:2] for r in plain(c)])]
    got = {(r[0], " ".join(words(r[1]))) for r in plain(d)}
    assert got == {(i, t) for i, n, gone, t in want if gone == 0 or gone < n} and len(plain(d)) < len(plain(c))
    assert d.where("n_chars <> length(text)").count() == 0

    dirty = {literal_eval(x)[0] for x in contaminated([r[:2] for r in plain(d)], items) if literal_eval(x)[5]} - {None}
    assert dirty and sorted(map(str, plain(e))) == sorted(str(r) for r in plain(d) if r[0] not in dirty)

    sizes = {}
    for _, t, _, s in plain(e):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    rows = f.collect()
    for s, goal in targets(sizes).items():
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - goal) <= 50
        assert all(abs(r["target"] - goal) < 1e-6 and r["taken"] == r["epochs"] * len(words(r["text"])) for r in own)
    assert {(r["doc_id"], r["text"]) for r in rows} <= {r[:2] for r in plain(e)}


def test_rows_are_dropped_by_id_and_text(spark, tmp_path):
    rng = random.Random(32)
    a, b, c, d, e, f, item = (prose(rng, 40) for _ in range(7))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = docs(spark, [(1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (None, c + " x"), (3, d), (3, d + " x"), (None, e), (5, ""), (5, ""), (None, ""), (None, ""), (None, None), (6, f), (6, f)])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, near, str(tmp_path)).collect()]
    for one, other, i in ((c, c + " x", None), (d, d + " x", 3)):
        assert ((i, one) in got) != ((i, other) in got)
    assert sorted(map(str, (r for r in got if r[1] not in (c, c + " x", d, d + " x")))) == sorted(map(str, [(1, a), (2, b), (None, e), (5, ""), (None, ""), (None, ""), (None, None), (6, f)]))
    assert len(got) == 10

    dirty = docs(spark, [(1, a), (1, item), (None, f"{b} {item}"), (None, c), (2, "x " + item), (None, None)])
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_items(spark, dirty, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, a), (None, c), (None, None)]))


def test_run_applies_the_stages_to_documents(spark, tmp_path):
    make(spark, str(tmp_path))
    first = corpus_pipeline.run(spark, str(tmp_path))
    assert first.count() > 100 and first.columns[-5:] == ["size", "source_size", "target", "taken", "epochs"]


def test_empty_tables(spark, tmp_path):
    make(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


NAMES = ["score", "predicted", "HELD_OUT", "i", "h", "key", "rest", "n_words", "n_removed", "kept_text", "size", "Source_Size", "target", "taken", "epochs", "text_hash", "best", "_i", "a.b", "extra"]


def test_extra_columns_pass_through(spark, tmp_path):
    make(spark, str(tmp_path))
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in NAMES})
    frame = frame.where("doc_id < 120 OR doc_id IS NULL")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{k}")
        mixed = {c.lower() for c in corpus_pipeline.MIXED} if k == 4 else set()
        assert [c for c in frame.columns if c.lower() not in mixed] == [c for c in before.columns if c.lower() not in mixed]
        rows = frame.collect()
        assert rows and all(r[name] == (None if r["doc_id"] is None else f"{name}{r['doc_id']}") for r in rows for name in NAMES if name.lower() not in mixed)


def test_very_long_texts_pass_every_stage(spark, tmp_path):
    make(spark, str(tmp_path))
    rng = random.Random(33)
    long = docs(spark, [(1, prose(rng, 60_000)), (2, prose(rng, 50)), (3, "x" * 500_000 + " " + prose(rng, 200))])
    for _, stage in corpus_pipeline.STAGES[1:]:
        long = stage(spark, long, str(tmp_path))
    assert {r["doc_id"] for r in long.collect()} == {1, 2, 3}


def test_only_the_last_stage_is_left_behind(spark, tmp_path):
    make(spark, str(tmp_path))
    found = corpus_pipeline.run(spark, str(tmp_path))
    folder = os.path.dirname(os.path.dirname(found.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == ["4"]
