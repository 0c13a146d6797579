"""Which items of a document (hashes of 48 bits) other documents have too, and how many.

A block asks each bucket about its distinct items once, whatever number of its documents have them; a bucket adds up
the blocks' counts and answers for the items that more than one document has. Items of one document of the block
carry that document's number along; the documents of the others stay in the block's notes. Two items may share a
hash; what is built on the answers must only get more to compare from that.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assaykit.llm.exchange import block_exchange, pack, pack_sorted, unpack, unpack_sorted

BITS = 48
#: Stands for the documents of an item that several of the block have.
SEVERAL = 0xFFFF


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def recurring_items(
    docs: DataFrame,
    items: Callable[[list, list], tuple[list[np.ndarray], bytes]],
    rows: Callable[[bytes, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch],
    schema: str,
    *,
    block_bytes: int,
) -> DataFrame:
    """items(ids, texts): for each unit of the block (a document or several equal ones) its distinct items, and notes.

    rows(notes, unit, item, count): the block's result from its units' recurring items, sorted by unit and item.
    """

    def make(ids, texts, buckets):
        sets, notes = items(ids, texts)
        unit = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        item = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(item, kind="stable")
        item, unit = item[order], unit[order]
        distinct, first, count = np.unique(item, return_index=True, return_counts=True)
        who = np.where(count == 1, unit[first] if len(first) else 0, SEVERAL)
        shared = np.repeat(count > 1, count)
        bucket = ((distinct >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(BITS - 16)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        requests = {}
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(distinct)], strict=True):
            if b > a:
                requests[int(bucket[a])] = pack_sorted(distinct[a:b], who[a:b], count[a:b] - 1)
        return pack(notes, pack_sorted(distinct[count > 1], count[count > 1] - 1), pack(unit[shared])), requests

    def serve(requests):
        asked = [(block, *unpack_sorted(p)) for block, p in requests]
        every = np.concatenate([item for _, item, _, _ in asked])
        distinct, inverse = np.unique(every, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([extra for *_, extra in asked]).astype(np.float64) + 1).astype(np.int64)[inverse]
        at = 0
        for block, item, who, _ in asked:
            n = total[at : at + len(item)]
            at += len(item)
            again = n > 1
            if again.any():
                yield block, pack_sorted(item[again], who[again], n[again] - 2)

    def merge(packed, replies):
        notes, shared, units = unpack(packed)
        several, extra = unpack_sorted(shared)
        (members,) = unpack(units)
        found = [unpack_sorted(p) for p in replies]
        item = np.concatenate([np.empty(0, np.uint64), *(f[0] for f in found)])
        who = np.concatenate([np.empty(0, np.uint64), *(f[1] for f in found)]).astype(np.int64)
        count = np.concatenate([np.empty(0, np.uint64), *(f[2] for f in found)]).astype(np.int64) + 2
        alone = who != SEVERAL
        # Every item of several units is answered: its units stand in the notes, in order of the items.
        sizes = extra.astype(np.int64) + 1
        known = np.argsort(item[~alone], kind="stable")
        counts_of_several = np.repeat(count[~alone][known], sizes)
        unit = np.concatenate([who[alone], members.astype(np.int64)])
        item = np.concatenate([item[alone], np.repeat(several, sizes)])
        count = np.concatenate([count[alone], counts_of_several])
        order = np.lexsort((item, unit))
        return rows(notes, unit[order], item[order], count[order])

    return block_exchange(docs, make, serve, merge, schema, block_bytes=block_bytes)
