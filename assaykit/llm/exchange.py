"""Blocks of documents that ask buckets about their items and get one answer each.

Counting something per distinct item of a corpus (a pre-token, a shingle, an anchor) with a row for each document
and item moves far more than the corpus. Here each task deals its documents into blocks of a few megabytes; a block
sends each bucket its distinct items once, packed in one compressed row; a bucket, which sees all blocks' items of
its share of the hash space, replies to each block; and the block's own notes meet the replies in a last task.

    documents -> requests -> exchange by bucket -> replies -> exchange by block -> merged rows

An item that is in a third of all documents makes one entry per block, not one per document, and the buckets' size
follows the session's number of shuffle partitions. Every step is a narrow function over rows that an exchange
holds, so a lost executor costs only its own tasks again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from assaykit.llm.common import text_batches
from assaykit.llm.memory import lean

#: route: what the exchange deals by; bucket: -1 for a block's own notes.
WIRE = "route int, block long, bucket int, payload binary"
WIRE_ARROW = pa.schema([("route", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
MOST_DOCS = 60_000
#: Rows turned into Python objects at once.
SLICE = 512


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings in one compressed string; integers in as few bytes as the largest needs, byte planes apart."""
    out = []
    for a in arrays:
        if isinstance(a, bytes):
            out.append(b"B" + len(a).to_bytes(8, "little") + a)
            continue
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "iu":
            a = a.astype(np.int64) if a.dtype.kind == "i" else a
            signed = a.dtype.kind == "i" and len(a) and a.min() < 0
            width = 8 if signed else max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
            planes = a.astype(np.uint64).view(np.uint8).reshape(len(a), 8)[:, :width].T.tobytes()
            out.append((b"S" if signed else b"U") + len(a).to_bytes(8, "little") + bytes([width]) + planes)
        else:
            raise TypeError(a.dtype)
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list:
    """The arrays (uint64, or int64 if any was negative) and byte strings given to pack()."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        kind, n, at = raw[at : at + 1], int.from_bytes(raw[at + 1 : at + 9], "little"), at + 9
        if kind == b"B":
            out.append(raw[at : at + n])
            at += n
            continue
        width, at = raw[at], at + 1
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        values = full.reshape(-1).view(np.uint64)
        out.append(values.view(np.int64) if kind == b"S" else values)
        at += n * width
    return out


def pack_sorted(values: np.ndarray, *more: np.ndarray | bytes) -> bytes:
    """pack(), with the first array, which must ascend, as its differences."""
    return pack(np.diff(values.astype(np.uint64), prepend=np.uint64(0)), *more)


def unpack_sorted(data: bytes) -> list:
    first, *more = unpack(data)
    return [np.cumsum(first, dtype=np.uint64), *more]


def join_bytes(items: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, items), np.int64, len(items)), b"".join(items)


def split_bytes(lengths: np.ndarray, blob: bytes) -> list[bytes]:
    ends = np.cumsum(lengths.astype(np.int64)).tolist()
    return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def documents_in_blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts as UTF-8 bytes or None) of about block_bytes each; a longer text is a block of its own.

    Columns: id, text and possibly more; an id is then a tuple of the id and those.
    """
    ids: list = []
    texts: list = []
    size = 0
    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        keys = batch.column(0).to_pylist()
        if batch.num_columns > 2:
            keys = list(zip(keys, *(c.to_pylist() for c in batch.columns[2:]), strict=True))
        for i, t in zip(keys, batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += 16 + len(t or b"")
            if size >= block_bytes or len(ids) >= MOST_DOCS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _groups(batches: Iterable[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    rows = ((b, k, p) for batch in batches for b, k, p in zip(batch.column("block").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True))
    return groupby(rows, key=lambda row: row[by == "bucket"])


def _wire(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), WIRE_ARROW.types, strict=True)], schema=WIRE_ARROW)


def block_exchange(
    docs: DataFrame,
    make: Callable[[list, list, int], tuple[bytes, dict[int, bytes]]],
    serve: Callable[[list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]],
    merge: Callable[[bytes, list[bytes]], pa.RecordBatch],
    schema: str,
    *,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """docs has an id, a text and possibly more columns; the result has the columns of schema, as merge() returns them.

    make(ids, texts, buckets): a block's notes, and its request to each bucket that it has items of.
    serve(requests): from all (block, request) of a bucket, (block, reply) for those that get one.
    merge(notes, replies): a block's rows.
    """
    session = docs.sparkSession
    buckets = 4 * int(session.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches):
        task, n = TaskContext.get().partitionId(), 0
        for ids, texts in documents_in_blocks(batches, block_bytes):
            block, n = (task << 32) + n, n + 1
            notes, requests = make(ids, texts, buckets)
            yield _wire([(block % buckets, block, -1, notes), *((k, block, k, p) for k, p in requests.items())])

    def answer(batches):
        for bucket, rows in _groups(batches, "bucket"):
            if bucket < 0:
                for block, _, payload in rows:
                    yield _wire([(0, block, -1, payload)])
                continue
            for block, payload in serve([(block, payload) for block, _, payload in rows]):
                yield _wire([(0, block, bucket, payload)])

    def conclude(batches):
        for _, rows in _groups(batches, "block"):
            (_, _, notes), *replies = rows
            yield merge(notes, [p for _, _, p in replies])

    asked = text_batches(docs).mapInArrow(lean(ask), WIRE).repartition("route").sortWithinPartitions("bucket")
    answered = asked.mapInArrow(lean(answer), WIRE).repartition("block").sortWithinPartitions("block", "bucket")
    return answered.mapInArrow(lean(conclude), schema)
