"""The registered queries that SQL can't express, over small tables, against brute force; and all of them over empty ones."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaykit.llm.queries import IMITATION, oracle_sql, queries

from .helpers import corpus, docs, prose
from .test_chat_format import TURNS, conversations, expected
from .test_quality_rules import slow_stats

WITHOUT_SQL = {"op4_quality_rules", "op5_count_tokens", "op6_quality_classifier", "op7_language_id", "op8_format_chat"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(51)
    own = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, t in corpus(51, 80)]
    return [*own, (500, "<|endoftext|> x " + prose(rng, 30), "en", "a"), (501, "a b c d e " * 12, "en", "a"), (502, "#" * 40 + " " + prose(rng, 20), "de", "b")]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, prose(random.Random(i), 15)) for i in range(4)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.example.com/en/{i}", "") for i in range(9)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([r for r in conversations() if r[0] != -1], TURNS).write.parquet(f"{path}/conversations.parquet")
    return path


def test_every_query_has_sql_or_a_test_here():
    assert set(queries()) - set(oracle_sql()) == WITHOUT_SQL and len(queries()) == 10


def test_quality_rules(spark, folder, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries()["op4_quality_rules"](spark, folder).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        stats = slow_stats(t)
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        assert got[i] == (*stats, failed, not failed)  # too few labels for a cutoff
    assert got[501][5] and not got[502][5]


def test_token_counts(spark, folder, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in queries()["op5_count_tokens"](spark, folder).collect()}
    assert got == want


def test_chat(spark, folder):
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries()["op8_format_chat"](spark, folder).collect()}
    assert got == expected(conversations()) and got[-1][2] == len(IMITATION)


@pytest.mark.parametrize("name", ["op6_quality_classifier", "op7_language_id"])
def test_classifiers_judge_every_row(spark, folder, rows, name):
    got = queries()[name](spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op8_format_chat" else 0), name
