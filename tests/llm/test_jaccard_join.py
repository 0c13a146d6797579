import random

import numpy as np
import pytest

from assaykit.llm.components import components
from assaykit.llm.jaccard_join import SETS, jaccard_groups, join_regions, link_region, regions
from assaykit.llm.queries import op2_jaccard_join

from .helpers import corpus, docs, prose, words


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, percent=80):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = [[r[0] for j, r in enumerate(rows) if find(j) == find(i) and r[0] is not None] for i in range(len(rows))]
    return sorted(str((r[0], len(sets[i]), min(ids[i], default=r[0]))) for i, r in enumerate(rows))


def mutated(rng, text, share):
    return " ".join(f"m{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def cluster_rows(seed):
    """Copies at every distance from their originals, so that groups chain and rings fill."""
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        base = prose(rng, rng.randint(60, 200))
        for _ in range(40):
            base = mutated(rng, base, 0.01) if rng.random() < 0.3 else base
            out.append(mutated(rng, base, rng.choice([0.0, 0.003, 0.01, 0.02, 0.04])))
    rng.shuffle(out)
    return list(enumerate(out))


EDGES = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c d e"), (906, "a b c d e"), (905, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (907, "x " * 5000), (908, "X\n" * 9000)]


@pytest.mark.parametrize("block", [2000, 1 << 22])
def test_matches_brute_force(spark, block):
    rows = corpus(11, 90) + EDGES
    got = jaccard_groups(docs(spark, rows).repartition(3), block_bytes=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize(("most", "depths"), [(3000, 2), (2500, 0)])
def test_large_regions_are_cut_exactly(spark, most, depths):
    rows = cluster_rows(12)
    got = jaccard_groups(docs(spark, rows), most=most, pivots=3, depths=depths)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_link_region_against_all_pairs():
    for seed in range(30):
        rng = random.Random(seed)
        base = set(rng.sample(range(1000), 60))
        sets = []
        for _ in range(60):
            base = base ^ set(rng.sample(range(1000), rng.randint(0, 3)))
            sets.append(base ^ set(rng.sample(range(1000), rng.randint(0, 9))))
        got, _ = link_region([np.array(sorted(s), np.uint64) for s in sets], [True] * 60, 80)
        want = list(range(60))
        for i in range(60):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    a, b = want[i], want[j]
                    want = [min(a, b) if x in (a, b) else x for x in want]
        assert got == want


def chained(seed, clusters=10, size=10):
    """Sets of 100 in close clusters, each cluster tied to the next by a single link."""
    rng = random.Random(seed)
    fresh = iter(range(1, 10**6))
    centre, out = [next(fresh) for _ in range(100)], []
    for _ in range(clusters):
        out += [[next(fresh), *centre[1:]] for _ in range(size)]
        after = list(centre)
        moved = rng.sample(range(1, 100), 16)
        for at in moved:
            after[at] = next(fresh)
        out.append([after[at] if at in moved[:3] else x for at, x in enumerate(centre)])
        out.append([centre[at] if at in moved[3:6] else x for at, x in enumerate(after)])
        centre = after
    rng.shuffle(out)
    return [np.array(sorted(s), np.uint64) for s in out]


def test_regions_cut_on_several_levels_keep_every_link(spark):
    rows, want = [], set()
    for seed in range(5):
        sets = chained(seed)
        names = [f"{seed:02}/{i:03}".encode() for i in range(len(sets))]
        roots, cells = link_region(sets, [True] * len(sets), 80)
        assert set(roots) == {0} and cells > 0
        want |= {(n, names[0]) for n in names}
        rows += [(names[0][:2], n, [int(x) for x in s], True) for n, s in zip(names, sets, strict=True)]
    links = join_regions(spark.createDataFrame(rows, SETS), percent=80, most=4000, pivots=3, depths=3)
    assert {(bytes(r["node"]), bytes(r["root"])) for r in components(links).collect()} == want


def test_small_regions_beside_large_ones_keep_their_links(spark):
    """The join that takes out large regions must not scatter the rows of small ones."""
    rng, rows, want = random.Random(7), [], set()
    for r in range(60):
        base = rng.sample(range(10**6), 50)
        for i in range(200 if r == 0 else 6):
            own = [*base[1:], rng.randrange(10**6, 10**9)]
            rows.append((f"{r:02}".encode(), f"{r:02}/{i:03}".encode(), own, True))
            want.add((f"{r:02}/{i:03}".encode(), f"{r:02}/000".encode()))
    for most in (10**6, 2000):
        links = join_regions(spark.createDataFrame(rows, SETS).repartition(9), percent=80, most=most)
        assert {(bytes(r["node"]), bytes(r["root"])) for r in components(links).collect()} == want


def test_inactive_row_beside_a_settled_one_is_compared(spark):
    """Only x and y, and y and z, are linked; z came in inactive. Any of the three may be the pivot."""
    rows = []
    for i in range(8):
        for name, first, active in (("x", 0, True), ("y", 8, True), ("z", 16, False)):
            rows.append((f"{i}".encode(), f"{i}{name}".encode(), list(range(first, first + 100)), active))
    links = join_regions(spark.createDataFrame(rows, SETS), percent=80, most=100, pivots=1, depths=1)
    assert {(bytes(r["node"]), bytes(r["root"])) for r in components(links).collect()} == {(f"{i}{n}".encode(), f"{i}x".encode()) for i in range(8) for n in "xyz"}


def test_regions_come_from_pivots(spark):
    """Documents that share a shingle of their windows share a region; pivots hand over until few are left."""
    rng, rows = random.Random(14), []
    for c in range(200):
        rows.append((f"{c:03}".encode(), sorted(rng.sample(range(c // 20 * 50, c // 20 * 50 + 60), 12))))
    table = spark.createDataFrame(rows, "class binary, window array<long>")
    most = []
    for rounds in (0, 1, 2):
        found = {bytes(r["class"]): set(map(bytes, r["regions"])) for r in regions(table, rounds).collect()}
        for a, x in rows:
            for b, y in rows:
                assert a == b or not set(x) & set(y) or found[a] & found[b]
        most.append(sum(map(len, found.values())))
    assert most[0] > 1.3 * most[1] > 1.3 * most[2]


def test_null_and_repeated_ids_take_linear_work(spark):
    """The stage that reads shingle sets sees each text about once, whatever the ids."""
    rng = random.Random(15)
    base = [prose(rng, 40) for _ in range(300)]
    rows = [(None if i % 2 else 7, base[i % 300] + (" end" if i % 600 < 300 else " fin")) for i in range(1200)]
    got = jaccard_groups(docs(spark, rows))
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_the_query_makes_voronoi_cells(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in cluster_rows(16)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    made = spark.sparkContext.accumulator(0)
    got = op2_jaccard_join(spark, str(tmp_path), counter=made)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows) and made.value > 0


def test_components(spark):
    rng = random.Random(13)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {n: n for e in edges for n in e}
    for _ in range(len(edges)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {n: r for n, r in want.items() if n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_empty_table(spark):
    assert jaccard_groups(docs(spark, [(1, "a")]).limit(0)).count() == 0
