import random

import numpy as np

from assaykit.llm import shingles
from assaykit.llm.exchange import join_bytes, pack, pack_sorted, split_bytes, unpack, unpack_sorted
from assaykit.llm.shingles import Powers, Words, shingle_sets

from .helpers import corpus, words


def test_words_and_places(monkeypatch):
    texts = [t.encode() if t is not None else None for _, t in corpus(3)] + [b"x" * 3000 + b" y", b"\x0b", "é 日本 é".encode()]
    whole = Words(texts, Powers())
    found = [[whole.raw[a:b].decode() for a, b in zip(whole.start[i:j], whole.end[i:j], strict=True)] for i, j in zip(whole.first[:-1], whole.first[1:], strict=True)]
    assert found == [words(t.decode() if t else t) for t in texts]
    by_word = {}
    for h, a, b in zip(whole.hash.tolist(), whole.start, whole.end, strict=True):
        assert by_word.setdefault(whole.raw[a:b], h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(shingles, "PIECE", 97)
    pieces = Words(texts, Powers())
    assert (pieces.hash == whole.hash).all() and (pieces.start == whole.start).all() and (pieces.of == whole.of).all()


def test_shingles_are_distinct_runs_of_lower_cased_words():
    texts = [b"a b c d e a b c d e", b"A b", b"a B", None, b"", b"a b c d e f"]
    sets = shingle_sets(texts, 5, Powers())
    assert [len(s) for s in sets] == [5, 1, 1, 0, 0, 2]
    assert sets[1] == sets[2] and len(np.intersect1d(sets[0], sets[5])) == 1


def test_packed_arrays():
    rng = random.Random(1)
    a = np.array([rng.randrange(2**63) for _ in range(50)] + [2**64 - 1], np.uint64)
    b = np.array([-5, 0, 2**40], np.int64)
    got = unpack(pack(a, b, b"xyz", np.empty(0, np.int64)))
    assert (got[0] == a).all() and (got[1] == b).all() and got[2] == b"xyz" and len(got[3]) == 0
    s = np.sort(a)
    first, second = unpack_sorted(pack_sorted(s, b))
    assert (first == s).all() and (second == b).all()
    items = [b"", b"a", b"bcd"]
    assert split_bytes(*unpack(pack(*join_bytes(items)))) == items and split_bytes(np.empty(0, np.int64), b"") == []
