"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and everything beyond ASCII. A benchmark
item's windows are its runs of ``window`` consecutive words, or all its words if it has fewer. The windows of one
length m are searched together. The alphabet is the benchmark's vocabulary, any other word is 0, so numbers stand
for words exactly. A shift table, indexed by a hash of a block of two words, says how far the search may skip after
seeing that block at the end of the current position (m - 1 words if no window holds it); where it says 0, the hash
of the last four words selects a bucket of windows, and those are compared word by word.

The search runs over a few megabytes of texts at a time, cut into lanes that skip independently, one numpy step for
all lanes. Compiled windows are broadcast in shards of at most ``shard_bytes`` of benchmark text, used one after the
other, so neither a task nor the driver holds more than one shard's windows beside the list of shards. At most
``broadcast_bytes`` of benchmark text are broadcast at a time: of a larger benchmark the documents are searched for one
group of shards after the other, and what each pass has found is put together by id and text.

Defined cases: a null text has no words; an item without words (or null) has no windows; an item is contaminated
with each id once, however often rows repeat it, and a null item_id counts as the empty string; repeated documents
each get their row; a very long text is a block of its own, read whole; empty tables give no rows, or rows without
hits. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, received, share, text_batches, text_hash
from assaykit.llm.exchange import documents_in_blocks
from assaykit.llm.memory import lean

#: Lower-cases A-Z and turns what isn't part of a word into spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TABLE_BITS = 18
LANE = 1024
SUFFIX = 4
#: hit: ranges of words that windows cover.
FOUND = "doc_id long, text_hash long, n_words long, hit array<struct<start:int,end:int>>, items array<string>"


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def _block_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)


def _suffix_key(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = (key + c.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
    return key ^ (key >> np.uint64(32))


class Windows:
    """The windows of one length, compiled: rows of word numbers, shift table, suffix buckets."""

    def __init__(self, rows: np.ndarray):
        self.m = rows.shape[1]
        self.block = min(2, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.block + 1, np.int32)
        for end in range(self.block - 1, self.m):
            h = _block_hash(rows[:, end - self.block + 1], rows[:, end])
            np.minimum.at(self.shift, h.astype(np.int64), self.m - 1 - end)
        key = _suffix_key([rows[:, i] for i in range(self.m - min(SUFFIX, self.m), self.m)])
        self.order = np.argsort(key, kind="stable")
        self.rows = rows[self.order]
        self.keys, self.first, self.count = np.unique(key[self.order], return_index=True, return_counts=True)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, window) of every occurrence."""
        m, stops = self.m, []
        at = np.arange(m - 1, len(ids), LANE)
        end = np.minimum(at + LANE, len(ids))
        while len(at):
            skip = self.shift[_block_hash(ids[at - self.block + 1], ids[at]).astype(np.int64)]
            zero = skip == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(skip, 1)
            going = at < end
            at, end = at[going], end[going]
        if not stops:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        stop = np.concatenate(stops)
        key = _suffix_key([ids[stop - i] for i in range(min(SUFFIX, m) - 1, -1, -1)])
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[slot] == key
        stop, slot = stop[same], slot[same]
        n = self.count[slot]
        pos = np.repeat(stop, n)
        candidate = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        equal = np.ones(len(pos), bool)
        for i in range(m):
            equal[equal] = self.rows[candidate[equal], i] == ids[pos[equal] - (m - 1 - i)]
        return pos[equal], self.order[candidate[equal]]


def compile_items(items: list[tuple[str | None, str | None]], window: int) -> tuple[dict[bytes, int], list[tuple[Windows, list[list[str]]]]]:
    """(vocabulary, [(windows of a length, ids of the items that have each)])."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text.encode() if text is not None else None)]
        m = min(window, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item or "")
    return vocabulary, [(Windows(np.array(list(found), np.int32)), [sorted(x) for x in found.values()]) for m, found in sorted(by_length.items())]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 4 << 20,
    shard_bytes: int = 8 << 20,
    broadcast_bytes: int = 64 << 20,
    keyed: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of each document; items holds the ids of the items with occurring windows, sorted.

    keyed adds text_hash, the xxhash64 of the row's text, which tells rows without an id, or with the same, apart.
    """
    session = docs.sparkSession
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = -(-total // shard_bytes)

    def compiled(k: int):
        part = rows if n_shards == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_shards)) == k)
        return share(session, compile_items([(r["item"], r["text"]) for r in part.toLocalIterator()], window))

    picked = text_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    at_once = max(1, broadcast_bytes // shard_bytes)
    if n_shards <= at_once:
        found = picked.mapInArrow(lean(_searching([compiled(k) for k in range(n_shards)], block_bytes)), FOUND)
    else:
        found = None
        for at in range(0, n_shards, at_once):
            shards = [compiled(k) for k in range(at, min(n_shards, at + at_once))]
            one = cut(picked.mapInArrow(lean(_searching(shards, block_bytes)), FOUND).where(F.size("items") > 0))
            for shard in shards:
                shard.destroy()
            found = one if found is None else found.unionByName(one)
        hits = found.groupBy(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).agg(*[F.flatten(F.collect_set(c)).alias(c) for c in ("hit", "items")])
        sizes = picked.mapInArrow(lean(_searching([], block_bytes)), FOUND).drop("hit", "items")
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
        nothing = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("hit", "array<struct<start:int,end:int>>"), ("items", "array<string>"))]
        found = sizes.join(hits, same, "left").select("doc_id", "text_hash", "n_words", *nothing)
    # Of ranges in their order each adds what the ones before haven't covered.
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    add = lambda seen, r: F.struct((seen["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], seen["upto"]))).alias("n"), F.greatest(seen["upto"], r["end"]).alias("upto"))
    out = found.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", F.aggregate(F.array_sort("hit"), empty, add)["n"].cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
        *["text_hash"] * keyed,
    )


def _searching(shards: list, block_bytes: int):
    """A function from batches of (id, text) to rows of FOUND, with what the shards' windows hit."""

    def run(batches):
        single = received(shards[0]) if len(shards) == 1 else None
        for ids, texts in documents_in_blocks(batches, block_bytes):
            words = [words_of(t) for t in texts]
            # A 0 between documents, which no window holds, keeps occurrences inside one of them.
            n_words = np.array([len(w) for w in words], np.int64)
            first = np.cumsum(n_words + 1) - n_words - 1
            size = int(n_words.sum()) + len(words)
            cover = np.zeros(size + 1, np.int32)
            found: list[set[str]] = [set() for _ in ids]
            for shard in shards:
                vocabulary, groups = single or received(shard)
                number = np.zeros(size, np.int32)
                for at, w in zip(first.tolist(), words, strict=True):
                    number[at : at + len(w)] = np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w))
                for group, items in groups:
                    pos, hit = group.search(number)
                    np.add.at(cover, np.unique(pos) - group.m + 1, 1)
                    np.add.at(cover, np.unique(pos) + 1, -1)
                    doc = np.searchsorted(first, pos, side="right") - 1
                    for d, h in set(zip(doc.tolist(), hit.tolist(), strict=True)):
                        found[d].update(items[h])
                if len(shards) > 1:
                    shard.__dict__.pop("_value", None)  # read again, from the worker's own file, when needed
            edges = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False))
            start, end = edges[0::2], edges[1::2]
            doc = np.searchsorted(first, start, side="right") - 1
            ends = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32())
            ranges = pa.StructArray.from_arrays([pa.array(start - first[doc], pa.int32()), pa.array(end - first[doc], pa.int32())], ["start", "end"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(text_hash, texts), pa.int64()), pa.array(n_words), pa.ListArray.from_arrays(ends, ranges), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "hit", "items"],
            )

    return run
