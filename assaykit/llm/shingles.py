"""Hashes of words and word sequences, for a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed value: ASCII white space, which ends words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Bytes whose hashes are computed at once; cut at white space, so that only a longer word needs more.
PIECE = 1 << 18


class Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as far as some piece of text has needed."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, PIECE + (1 << 12))
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(self.n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse))


def _pieces(a: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of about PIECE bytes that end at white space."""
    at = 0
    while at < len(a):
        end = min(at + PIECE, len(a))
        while end < len(a) and not SPACE[a[end]]:
            ahead = np.flatnonzero(SPACE[a[end : end + PIECE]])
            end = min(len(a), end + (int(ahead[0]) if len(ahead) else PIECE))
        yield at, end
        at = end


class Words:
    """The words of a block of UTF-8 texts (None: no words): hashes, places in the block's bytes, and whose they are."""

    def __init__(self, texts: list[bytes | None], powers: Powers):
        self.raw = b"\n".join(t or b"" for t in texts)
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        offsets = np.cumsum(lengths + 1) - lengths - 1
        a = np.frombuffer(self.raw, np.uint8)
        parts = [self._piece(a[begin:end], begin, powers) for begin, end in _pieces(a)]
        empty = np.empty(0, np.int64)
        self.start, self.end = (np.concatenate([empty, *(p[i] for p in parts)]) for i in (0, 1))
        self.hash = np.concatenate([empty.astype(np.uint64), *(p[2] for p in parts)])
        self.first = np.append(np.searchsorted(self.start, offsets), len(self.start))
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    @staticmethod
    def _piece(a: np.ndarray, begin: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.flatnonzero(np.diff((~SPACE[a]).astype(np.int8), prepend=0, append=0))
        start, end = edges[0::2], edges[1::2]
        powers.upto(len(a) + 1)
        sums = np.zeros(len(a) + 1, np.uint64)
        # A word's value is the difference of two running sums, brought back to power 0; 1 is added so that no byte is 0.
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers.up[: len(a)], out=sums[1:])
        return start + begin, end + begin, mix((sums[end] - sums[start]) * powers.down[start])

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words that start at each word, whether they are all of one text); k - 1 shorter than the words."""
        n = max(0, len(self.hash) - k + 1)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _STEP + self.hash[i : i + n]
        return mix(h), self.of[:n] == self.of[k - 1 : k - 1 + n] if n else np.empty(0, bool)


def shingle_sets(texts: list[bytes | None], k: int, powers: Powers) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes; with fewer words, all of them are one shingle."""
    words = Words([t.translate(LOWER) if t else t for t in texts], powers)
    h, _ = words.runs(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in words.hash[a:b]:
                whole = mix(whole * _STEP + x)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
