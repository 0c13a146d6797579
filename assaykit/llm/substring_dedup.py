"""Substring deduplication: passages of ``window`` words that start in a document with a smaller id are removed.

1. Anchors. A window's anchor is the smallest hash of its runs of ``anchor`` words, so equal windows have equal
   anchors, and a document has an anchor for about every fifth word. Documents learn which of their anchors other
   documents have too (see recurring.py); any window that recurs has such an anchor.
2. Candidate passages. The windows with such an anchor, with their words, are the only places where a repetition can
   be. A block of documents sends each distinct passage once, to the anchor's bucket.
3. Automata. A bucket confirms which windows of its passages recur, by the hashes of all windows at once, compiles
   them into Aho-Corasick automata, sharded by anchor, one word spelled with a few letters, and streams the passages
   of all documents through them: that locates every occurrence, word by word. Each block gets the occurrences with
   the smallest id that the window starts in, which is taken from what the automaton found; a hash that two windows
   share only puts a needless word into the automaton.
4. Removal. The block marks the words of its documents with larger ids, and the marks are joined to the documents.

All documents take part in each step; what a bucket holds is bounded by the number of buckets, and a passage that a
third of all documents share comes once per block. Streaming whole documents through every automaton would cost the
corpus times the number of automata, which grows with the corpus as well; a document's passages go to just those
automata that can match there.

Defined cases: a null text has no words; a null id neither removes words nor loses any; rows with equal ids don't
remove each other's words; texts shorter than a window keep all words; a very long text is a block of its own, read
whole; an empty table gives an empty result. Other columns, whatever their names, are kept unless they clash with
those added, which win.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name, named, text_hash
from assaykit.llm.exchange import block_exchange, join_bytes, pack, split_bytes, unpack
from assaykit.llm.recurring import BITS, recurring_items, short
from assaykit.llm.shingles import Powers, Words, mix

ADDED = ("n_words", "n_removed", "kept_text")
ANCHORS = "doc_id long, text_hash long, anchors array<long>"
MARKS = "doc_id long, text_hash long, starts array<int>, lengths array<int>"
#: Words are spelled with these in automata.
LETTERS = "".join(map(chr, range(0x30, 0x70)))
#: A bucket's passages are dealt by anchor to this many automata.
SHARDS = 16


def window_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window that starts at each word, whether the window is within one text)."""
    runs, _ = words.runs(anchor)
    n = max(0, len(words.hash) - window + 1)
    least = runs[:n].copy()
    for i in range(1, window - anchor + 1):
        np.minimum(least, runs[i : i + n], out=least)
    # Mixed again: the smallest of several hashes is a small one, and buckets are cut from the hash space.
    return short(mix(least)), words.of[:n] == words.of[window - 1 : window - 1 + n] if n else np.empty(0, bool)


def _keys(of: np.ndarray, item: np.ndarray) -> np.ndarray:
    return (of.astype(np.uint64) << np.uint64(BITS)) | item.astype(np.uint64)


def recurring_anchors(docs: DataFrame, window: int, anchor: int, block_bytes: int) -> DataFrame:
    """Rows of ANCHORS for documents with any."""
    held: dict = {}

    def items(ids, texts):
        texts = [t if i is not None else None for i, t in zip(ids, texts, strict=True)]
        words = Words(texts, held.setdefault("powers", Powers()))
        least, valid = window_anchors(words, window, anchor)
        key = np.unique(_keys(words.of[: len(least)][valid], least[valid]))
        of = (key >> np.uint64(BITS)).astype(np.int64)
        sets = np.split(key & np.uint64((1 << BITS) - 1), np.searchsorted(of, np.arange(1, len(ids))))
        return sets, pack(np.array([i or 0 for i in ids], np.int64), np.array([text_hash(t) for t in texts], np.int64).view(np.uint64))

    def rows(notes, unit, item, count):
        ids, hashes = unpack(notes)
        some, first = np.unique(unit, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(unit)), pa.int32()), pa.array(item.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)[some]), pa.array(hashes.view(np.int64)[some]), lists], names=["doc_id", "text_hash", "anchors"])

    return recurring_items(docs, items, rows, ANCHORS, block_bytes=block_bytes)


def passages(words: Words, wanted: np.ndarray, window: int, anchor: int) -> list[tuple[int, int, int]]:
    """(first word, words, anchor) of each run of windows that have the same wanted (text, anchor) key."""
    least, valid = window_anchors(words, window, anchor)
    at = np.flatnonzero(valid)
    key = _keys(words.of[at], least[at])
    slot = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
    hit = wanted[slot] == key if len(wanted) else np.zeros(len(key), bool)
    at, key = at[hit], key[hit]
    if not len(at):
        return []
    cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(key.view(np.int64)) != 0)) + 1
    begin, end = at[np.append(0, cuts)], at[np.append(cuts - 1, len(at) - 1)]
    return list(zip(begin.tolist(), (end - begin + window).tolist(), least[begin].tolist(), strict=True))


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def confirmed(numbers: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each window that occurs under different ids, whether each passage holds such a window), by hashes.

    numbers: the words of the passages, one after the other; ends: where each ends; low, high: the smallest and largest
    id that each comes from.
    """
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    n = max(0, len(numbers) - window + 1)
    h = np.zeros(n, np.uint64)
    for i in range(window):
        h = h * np.uint64(0xD1342543DE82EF95) + mix(numbers[i : i + n].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(of[:n] == of[window - 1 : window - 1 + n])
    if not len(at):
        return at, np.zeros(len(ends), bool)
    order = at[np.argsort(h[at], kind="stable")]
    first = np.flatnonzero(np.append(True, np.diff(h[order].view(np.int64)) != 0))
    again = np.minimum.reduceat(low[of[order]], first) < np.maximum.reduceat(high[of[order]], first)
    holds = np.zeros(len(ends), bool)
    holds[of[order[np.repeat(again, np.diff(np.append(first, len(order))))]]] = True
    return order[first[again]], holds


def occurrences(texts: dict[bytes, tuple[int, int]], window: int) -> dict[bytes, tuple[list[int], list[int]]]:
    """For each passage (with the smallest and largest id it comes from): first words of its recurring windows, their smallest ids.

    A word is spelled with the fewest letters of a small alphabet that tell the words apart: an automaton looks
    through a node's children one by one, and the root would have one for each word.
    """
    number = _Numbers()
    split = [np.fromiter(map(number.__getitem__, t.split(b" ")), np.int64) for t in texts]
    low, high = (np.fromiter((ids[i] for ids in texts.values()), np.int64, len(texts)) for i in (0, 1))
    numbers, ends = np.concatenate([np.empty(0, np.int64), *split]), np.cumsum([len(w) for w in split], dtype=np.int64)
    places, holds = confirmed(numbers, ends, low, high, window)
    if not len(places):
        return {}
    width = 1
    while len(LETTERS) ** width < len(number):
        width += 1
    letters = np.frombuffer(LETTERS.encode("utf-32-le"), np.uint32)
    spelled = letters[np.stack([numbers // len(LETTERS) ** i % len(LETTERS) for i in range(width)], 1)].astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, place in enumerate(places.tolist()):
        automaton.add_word(spelled[place * width : (place + window) * width], k)
    automaton.make_automaton()
    streamed, found = np.flatnonzero(holds).tolist(), []
    least, most = np.full(len(places), np.iinfo(np.int64).max), np.full(len(places), np.iinfo(np.int64).min)
    begins = np.append(0, ends)
    for t in streamed:
        hits = [((end + 1) // width - window, k) for end, k in automaton.iter(spelled[begins[t] * width : begins[t + 1] * width]) if (end + 1) % width == 0]
        at, which = np.array([h[0] for h in hits], np.int64), np.array([h[1] for h in hits], np.int64)
        least[which], most[which] = np.minimum(least[which], low[t]), np.maximum(most[which], high[t])
        found.append((at, which))
    names, out = list(texts), {}
    for t, (at, which) in zip(streamed, found, strict=True):
        again = least[which] < most[which]
        if again.any():
            out[names[t]] = (at[again].tolist(), least[which][again].tolist())
    return out


def repeated_words(docs: DataFrame, window: int, anchor: int, block_bytes: int) -> DataFrame:
    """Rows of MARKS from (doc_id, text, text_hash, anchors)."""
    held: dict = {}

    def make(ids, texts, buckets):
        words = Words(texts, held.setdefault("powers", Powers()))
        wanted = np.unique(np.concatenate([np.empty(0, np.uint64), *(_keys(np.full(len(a), i), np.array(a, np.int64)) for i, (_, _, a) in enumerate(ids))]))
        start, end, raw = words.start, words.end, words.raw
        found: dict[bytes, list] = {}
        for first, n, a in passages(words, wanted, window, anchor):
            text = b" ".join(raw[start[first] : end[first + n - 1]].split())
            entry = found.setdefault(text, [a * buckets * SHARDS >> BITS, [], []])
            d = int(words.of[first])
            entry[1].append(d)
            entry[2].append(first - int(words.first[d]))
        ordered = sorted(found.items(), key=lambda e: e[1][0])
        doc_ids = [i for i, _, _ in ids]
        requests: dict[int, list] = {}
        for text, (shard, of, _) in ordered:
            own = [doc_ids[d] for d in of]
            requests.setdefault(shard // SHARDS, []).append((text, min(own), max(own), shard % SHARDS))
        notes = pack(
            np.array(doc_ids, np.int64),
            np.array([h for _, h, _ in ids], np.int64).view(np.uint64),
            np.array([len(e[1]) for _, e in ordered], np.int64),
            np.array([d for _, e in ordered for d in e[1]], np.int64),
            np.array([f for _, e in ordered for f in e[2]], np.int64),
        )
        return notes, {b: pack(*join_bytes([t for t, *_ in r]), *(np.array([x[i] for x in r], np.int64) for i in (1, 2, 3))) for b, r in requests.items()}

    def serve(requests):
        shards: list[dict[bytes, tuple[int, int]]] = [{} for _ in range(SHARDS)]
        asked = []
        for block, payload in requests:
            lengths, blob, low, high, shard = unpack(payload)
            texts = split_bytes(lengths, blob)
            asked.append((block, texts, high.tolist()))
            for t, a, b, k in zip(texts, low.tolist(), high.tolist(), shard.tolist(), strict=True):
                known = shards[k].get(t)
                shards[k][t] = (a, b) if known is None else (min(a, known[0]), max(b, known[1]))
        found: dict[bytes, tuple[list[int], list[int]]] = {}
        while shards:  # one automaton at a time
            found.update(occurrences(shards.pop(), window))
        for block, texts, high in asked:
            counts, places, owners = [], [], []
            for t, b in zip(texts, high, strict=True):
                hits = [(p, o) for p, o in zip(*found.get(t, ((), ())), strict=True) if o < b]
                counts.append(len(hits))
                places += [p for p, _ in hits]
                owners += [o for _, o in hits]
            yield block, pack(np.array(counts, np.int64), np.array(places, np.int64), np.array(owners, np.int64))

    def merge(notes, replies):
        ids, hashes, uses, of, first = (a.astype(np.int64) if a.dtype != np.uint64 or i != 1 else a for i, a in enumerate(unpack(notes)))
        answers = [unpack(p) for p in replies]
        counts, places, owners = (np.concatenate([np.empty(0, np.int64), *(a[i].astype(np.int64) for a in answers)]) for i in range(3))
        # Every use of a passage with every hit in it.
        passage = np.repeat(np.arange(len(uses)), uses)
        n = counts[passage]
        use = np.repeat(np.arange(len(of)), n)
        begin = np.cumsum(counts) - counts
        hit = np.repeat(begin[passage] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        gone = owners[hit] < ids[of[use]]
        doc, word = of[use][gone], first[use][gone] + places[hit][gone]
        key = np.unique(doc * (1 << 40) + word)
        doc, word = key >> 40, key & ((1 << 40) - 1)
        # Windows that touch or overlap are one range.
        new = np.append(True, (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + window)) if len(doc) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        last = np.append(heads[1:], len(doc))[: len(heads)] - 1
        starts, sizes, owner = word[heads], word[last] + window - word[heads], doc[heads]
        some, at = np.unique(owner, return_index=True)
        ends = pa.array(np.append(at, len(owner)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[some]), pa.array(hashes.view(np.int64)[some]), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (starts, sizes))],
            names=["doc_id", "text_hash", "starts", "lengths"],
        )

    return block_exchange(docs, make, serve, merge, MARKS, block_bytes=block_bytes)


def _without(text: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    out = []
    for t, s, n in zip(text, starts, lengths, strict=True):
        words = t.encode().split() if t else []
        kept = words
        if s is not None:
            kept, at = [], 0
            for a, size in zip(s.tolist(), n.tolist(), strict=True):
                kept += words[at:a]
                at = a + size
            kept += words[at:]
        out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])


def remove_repeats(
    docs: DataFrame,
    *,
    window: int = 13,
    anchor: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = 2 << 20,
) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the words that stay, joined by one space)."""
    docs = docs.drop(*ADDED)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    anchors = cut(recurring_anchors(rows, window, anchor, block_bytes)).groupBy("doc_id", "text_hash").agg(F.any_value("anchors").alias("anchors"))
    some = anchors.withColumnRenamed("doc_id", "i").withColumnRenamed("text_hash", "h").hint("shuffle_hash")
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    suspects = hashed.join(some, (F.col("doc_id") == F.col("i")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text", "text_hash", "anchors")
    marks = cut(repeated_words(suspects, window, anchor, block_bytes)).groupBy("doc_id", "text_hash").agg(F.any_value("starts").alias("starts"), F.any_value("lengths").alias("lengths"))
    i, h, m, out = (free_name(docs, name) for name in ("i", "h", "marks", "out"))
    marks = marks.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.struct("starts", "lengths").alias(m)).hint("shuffle_hash")
    marked = docs.join(marks, (F.col(doc_id).cast("long") == F.col(i)) & (F.xxhash64(F.col(text).cast("string")) == F.col(h)), "left")
    without = F.pandas_udf(_without, "n_words long, n_removed long, kept_text string")
    return marked.withColumn(out, without(F.col(text).cast("string"), f"{m}.starts", f"{m}.lengths")).select(*named(docs), f"{out}.*")
