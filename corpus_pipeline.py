"""A pipeline over documents: good texts, once each, without repeated passages or benchmark items, mixed by source.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's result as
Parquet in the shared folder and reads it again, so a lost executor never costs more than the stage at work.

Defined cases, beside those of the operators: the second and fourth stage tell rows apart by id and hash of the text, so
they drop rows without an id as others; a group without any id keeps its first text by hash, and one row of it; rows
that repeat an id and a text are near duplicates, of which one stays, but rows without an id and without words all
stay, as they link with nothing; a document that the third stage leaves without words goes; stages pass empty tables on. Stages return the columns of
documents, the last one also size, source_size, target, taken and epochs of each document that the mix takes, which
replace columns of those names; any other name may be a column's. A very long text is handled as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name, named, remove_folder, scratch_folder, small_side, table, word_count
from assaykit.llm.decontaminate import find_contamination
from assaykit.llm.jaccard_join import jaccard_groups
from assaykit.llm.mixing import mix_sources
from assaykit.llm.quality_classifier import classify_quality
from assaykit.llm.substring_dedup import remove_repeats

#: Ids with text hashes, sixteen bytes each, are broadcast up to this number; beyond it the joins shuffle.
BROADCAST_IDS = 500_000
#: What the last stage adds.
MIXED = ("size", "source_size", "target", "taken", "epochs")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows that have both id, which may be null, and text hash of a row of keys."""
    i, h = free_name(docs, "i"), free_name(docs, "h")
    gone = small_side(cut(keys.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()), BROADCAST_IDS)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h)), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the holdout, takes for good."""
    names = [free_name(docs, name) for name in ("score", "predicted", "held_out")]
    return classify_quality(docs, table(spark, sf_dir, "labels"), names=names).where(F.col(names[1]) == 1).select(*named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, or the smallest text hash if none has an id."""
    groups = cut(jaccard_groups(docs, keyed=True))
    kept = _without(docs, groups.where("NOT first"))
    if not groups.where("first AND (doc_id IS NOT NULL OR n_shingles > 0)").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        alone = F.col("doc_id").isNull() & (word_count(F.col("text")) == 0)
        key = free_name(docs, "key")
        once = kept.where(~alone).withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
        kept = once.unionByName(kept.where(alone))
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in a document with a smaller id; n_chars follows the text."""
    # Apart from docs, whose columns may be called as those that are added.
    rest = free_name(docs, "rest")
    found = remove_repeats(docs.select("doc_id", "text", F.struct(*named(docs)).alias(rest)))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col(f"{rest}.n_chars"))
    changed = {"text": text, "n_chars": n_chars}
    return left.select(*[changed.get(c, F.col(rest).getField(c)).alias(c) for c in docs.columns])


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return _without(docs, find_contamination(docs, table(spark, sf_dir, "benchmark"), keyed=True).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often it takes each."""
    kept = docs.drop(*MIXED)
    i, h = free_name(kept, "i"), free_name(kept, "h")
    taken = mix_sources(docs).where("epochs > 0").groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    plan = taken.agg(*[F.max(c).alias(c) for c in MIXED])
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    return kept.join(plan.hint("shuffle_hash"), same).drop(i, h)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_items),
    ("mixing sources", mix),
]

#: A trained classifier decides the first stage, which SQL cannot express; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from its files; what the stages before have written is removed once the next has read it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{scratch_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
