"""Token counts of a byte-level BPE tokenizer without encoding the documents.

The pieces of a text are those of its pre-tokens, so each distinct pre-token is counted once in the corpus: blocks
of documents (see exchange.py) send their distinct pre-tokens to buckets, a bucket counts each of its pre-tokens
once with the library's model, and the counts are joined to the documents' pre-token frequencies and summed.

Pre-tokens are cut by the library's own pattern, with the regex module where the text has only code points below
U+0240, on which both agree (see the tests), and with the library's pre-tokenizer for other texts. Strings of
special tokens inside a text are one token each, as by the library's default.

Defined cases: a null text is empty and has 0 tokens; a null id stays null; repeated rows each get their row; a very
long text is a block of its own, read whole; an empty table gives an empty result. Other columns are not read, so
their names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaykit.llm.exchange import block_exchange, join_bytes, pack, split_bytes, unpack

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leading bytes up to this one encode code points below U+0240.
PLAIN = 0xC8


def byte_alphabet() -> dict[int, str]:
    """For each byte, as a Latin-1 code point, the character that byte-level models write for it."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PreTokens:
    """Cuts texts into pre-tokens as UTF-8 bytes; special strings are counted apart."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        kind = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or spec.get("normalizer") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("only a byte-level tokenizer without normalizer, prefix space or stripping special tokens is supported")
        self.library = Tokenizer.from_str(definition)
        self.find = regex.compile(PATTERN).findall
        strings = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None

    def __call__(self, raw: bytes) -> tuple[list[str], int]:
        text = raw.decode()
        parts, specials = [text], 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            specials = len(parts) - 1
        if not raw or np.frombuffer(raw, np.uint8).max() <= PLAIN:
            return [t for p in parts for t in self.find(p)], specials
        return [p[a:b] for p in parts if p for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(p)], specials


class _Counts(dict):
    """Pieces of pre-tokens, remembered for those of late."""

    def __init__(self, library: Tokenizer, most: int):
        super().__init__()
        self.model, self.letters, self.most = library.model, byte_alphabet(), most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[token] = n = len(self.model.tokenize(token.encode().decode("latin-1").translate(self.letters)))
        return n


def token_counter(definition: str, most: int = 200_000) -> Callable[[str], int]:
    """A function that counts the tokens of a text, one at a time, within a task."""
    pre_tokens = PreTokens(definition)
    counts = _Counts(pre_tokens.library, most)

    def count(text: str) -> int:
        found, specials = pre_tokens(text.encode())
        return specials + sum(map(counts.__getitem__, found))

    return count


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def count_tokens(docs: DataFrame, definition: str, *, limit: int = 512, doc_id: str = "doc_id", text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; definition is the tokenizer's JSON."""
    PreTokens(definition)  # an unsupported definition fails here, not in a task
    held: dict = {}

    def make(ids, texts, buckets):
        if "cut" not in held:
            held["cut"] = PreTokens(definition)
        cut = held["cut"]
        numbers, tokens, lengths, specials = _Numbers(), [], [], []
        for t in texts:
            found, special = cut(t or b"")
            tokens.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
            lengths.append(len(t or b""))
            specials.append(special)
        of = np.repeat(np.arange(len(texts)), [len(x) for x in tokens])
        pairs, freq = np.unique(of * max(1, len(numbers)) + np.concatenate(tokens), return_counts=True)
        doc, number = pairs // max(1, len(numbers)), pairs % max(1, len(numbers))
        per_doc = np.bincount(doc, minlength=len(texts))
        step = np.diff(number, prepend=0)
        step[np.searchsorted(doc, np.arange(len(texts))[per_doc > 0])] = number[np.searchsorted(doc, np.arange(len(texts))[per_doc > 0])]
        items = [k.encode() for k in numbers]
        bucket = np.fromiter((xxhash.xxh32_intdigest(k) for k in items), np.int64, len(items)) % buckets
        order = np.argsort(bucket, kind="stable")
        known = np.array([i is not None for i in ids], np.uint8)
        notes = pack(known, np.array([i or 0 for i in ids], np.int64), np.array(lengths, np.int64), np.array(specials, np.int64), per_doc, step, freq - 1, order)
        requests = {}
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            requests[int(bucket[part[0]])] = pack(*join_bytes([items[i] for i in part]))
        return notes, requests

    def serve(requests):
        """Each pre-token of the bucket is counted once, for whatever number of blocks that have it."""
        if "model" not in held:
            held["model"] = Tokenizer.from_str(definition).model
            held["letters"] = byte_alphabet()
        model, letters, counts = held["model"], held["letters"], {}
        asked = [(block, split_bytes(*unpack(p))) for block, p in requests]
        for item in {i for _, items in asked for i in items}:
            counts[item] = len(model.tokenize(item.decode("latin-1").translate(letters)))
        for block, items in asked:
            yield block, pack(np.fromiter(map(counts.__getitem__, items), np.int64, len(items)))

    def merge(notes, replies):
        known, ids, n_bytes, specials, per_doc, step, extra, order = unpack(notes)
        pieces = np.zeros(len(order), np.int64)
        if replies:  # in order of the buckets, as the requests were
            pieces[order.astype(np.int64)] = np.concatenate([unpack(p)[0] for p in replies]).astype(np.int64)
        per_doc = per_doc.astype(np.int64)
        of = np.repeat(np.arange(len(ids)), per_doc)
        total = np.cumsum(step.astype(np.int64))
        first = np.cumsum(per_doc) - per_doc
        base = np.zeros(len(ids), np.int64)
        has = per_doc > 0
        base[has] = total[first[has]] - step.astype(np.int64)[first[has]]
        number = total - base[of]
        n_tokens = specials.astype(np.int64) + np.bincount(of, weights=pieces[number] * (extra.astype(np.int64) + 1), minlength=len(ids)).astype(np.int64)
        doc_ids = pa.array(ids.astype(np.int64), mask=known == 0)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_bytes.astype(np.int64)), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return block_exchange(rows, make, serve, merge, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", block_bytes=block_bytes)
