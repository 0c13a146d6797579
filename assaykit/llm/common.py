"""What several operators share: reading tables, cutting lineage, word counts, broadcasts behind a size check."""

from __future__ import annotations

import atexit
import pickle
import re
import shutil
import tempfile

import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where the session names none, as in tests on one machine, a temporary one is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if named is None:
            named = tempfile.mkdtemp(prefix="assaykit-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes what was written under a path of whatever file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """df, marked for broadcast if it has at most max_rows rows; beyond that the join shuffles both sides.

    Meant for rows of a few dozen bytes that are cheap to count, such as checkpointed ones.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast of value whose classes travel with it; read it with received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)


#: Bytes of rows sent to a Python worker at once.
BATCH_BYTES = 4 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose long texts are to go to Python workers: lowers the session's bytes per Arrow batch to BATCH_BYTES.

    Spark's default of 64 MB is held several times over per task, in the executor and in the worker.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.match(r"-?\d+", conf.get(key))[0]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def text_hash(text: bytes | None) -> int:
    """What Spark's xxhash64 gives for a text."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores before it, such that df has no column of that name in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; an unknown id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))
