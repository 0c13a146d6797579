import hashlib
import random
import re

import numpy as np
import pytest

from assaykit.llm.decontaminate import Windows, compile_items, find_contamination

from .helpers import docs, prose

ITEMS = "item_id long, text string"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items, window=10):
    out = []
    for i, text in rows:
        w, hit, found = tokens(text), set(), set()
        for item, t in items:
            v = tokens(t)
            m = min(window, len(v))
            grams = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k : k + m]) in grams:
                    hit.update(range(k, k + m))
                    found.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


@pytest.mark.parametrize(("shard", "at_once"), [(60, 64 << 20), (200, 500), (1 << 23, 64 << 20)])
def test_matches_brute_force(spark, shard, at_once):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 30]), 40)) for i in range(25)] + [(3, "same Same WORDS here"), (100, None), (101, " ?! "), (102, "é-à_ß1"), (None, "nobody knows"), (103, "of the")]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(0, 40), 60)]
        for _ in range(rng.randint(0, 3)):
            v = tokens(rng.choice(items)[1])
            a = rng.randint(0, 3)
            parts += [rng.choice([" ", ", ", "\n", "--"]).join(v[a : a + rng.randint(1, 20)]).upper(), prose(rng, rng.randint(0, 5), 60)]
        rows.append((i % 70, " ".join(parts)))
    rows += rows[:5]
    rows += [(None, rows[3][1]), (200, None), (201, ""), (202, "!!"), (None, "Nobody knows of the"), (203, " ".join(["x"] * 4000 + ["nobody", "KNOWS"]))]
    got = find_contamination(docs(spark, rows), spark.createDataFrame(items, ITEMS), shard_bytes=shard, broadcast_bytes=at_once, block_bytes=900)
    assert sorted(map(str, map(tuple, got.drop("items").collect()))) == brute(rows, items)


def test_occurrences_at_the_edges_of_lanes():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 4, 5000).astype(np.int32)
    rows = np.unique(np.stack([ids[i : i + 10] for i in (0, 1014, 1018, 1023, 2040, 4990)]), axis=0)
    pos, hit = Windows(rows).search(ids)
    want = {(i + 9, k) for i in range(4991) for k in range(len(rows)) if (ids[i : i + 10] == rows[k]).all()}
    assert set(zip(pos.tolist(), hit.tolist(), strict=True)) == want and len(want) >= 6


def test_windows_are_shared_by_items():
    vocabulary, groups = compile_items([("a", "x y"), ("b", "X, Y"), ("c", "x")], 10)
    assert len(vocabulary) == 2 and [items for _, items in groups] == [[["c"]], [["a", "b"]]]


def test_empty_tables(spark):
    items, some = spark.createDataFrame([], ITEMS), docs(spark, [(1, "a b")])
    assert [tuple(r)[:4] for r in find_contamination(some, items).collect()] == [(1, 2, 0, 0)]
    assert find_contamination(some.limit(0), items).count() == 0
