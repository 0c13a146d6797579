"""N-gram Jaccard join as an exact metric-space join, with the groups of linked documents.

Jaccard distance is a metric, so documents within e of each other lie within e of each other's distance to any
pivot. On word shingles nearly all pairs are at distance 1, so pivots drawn from the whole corpus would tell nothing
apart: each one must be near the documents that it is to divide. Of its n shingles in any common order the first
n - ceil(t n) + 1 are a window that no linked document can miss; the order is rarest first, and as shingles that no
other document has cannot be shared, a document with more of those than it may differ in has an empty window and is
done. The documents with a shingle in their windows are a region, and the smallest of them (by the hash of its set)
is its pivot. A pivot that is in the region of a smaller one hands its own regions over to that, twice; whatever it
hands to whom, two documents with a window's shingle in common stay in one region. So a region is named by its
pivot, holds what is near it, and a document is in one or two of them.

A region is then joined recursively. Several of its documents become pivots. A pivot's linked documents, its ball,
are one group; only documents in its ring, farther than e but within 2e, can link with the ball from outside, so only
those are compared again; what lies beyond is not compared with the ball at all. What is unsettled is cut into the
pivots' Voronoi cells: a cell holds the documents nearest to its pivot and, by the triangle inequality, those at most
2e farther from it than from their own. Cells whose documents are all settled are dropped, the others are cut again,
until few documents are left to compare or a cell no longer gets smaller. Small regions are cut in a task each, larger
ones first by the same steps as DataFrame operations: where cells would hold most of the region several times, other
pivots are tried on the whole of it, and what is still large after that is joined in blocks. A document that is compared in another cell is compared in this one too if it is in the ring of a
pivot here, as the documents of that ball are then settled.

Equal shingle sets are one class throughout, settled inside each block of documents before anything is exchanged, so
thousands of exact copies count as one document and as one row a block. Shingles are 64-bit hashes; the first step's
are cut to 48 bits, which only adds comparisons.

Defined cases: a text without words, or null, has 0 shingles and links with nothing; a text of fewer words than a
shingle has one; a null id is reached but never the smallest; repeated rows are linked, with equal or without ids; a
text above a block's size is a block of its own, read whole; an empty table gives none; other columns are not read,
so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, small_side, text_hash
from assaykit.llm.components import components
from assaykit.llm.exchange import SLICE, pack, unpack
from assaykit.llm.memory import lean
from assaykit.llm.recurring import recurring_items, short
from assaykit.llm.shingles import Powers, shingle_sets

MEMBERS = "array<struct<doc_id:long,text_hash:long>>"
FEATURES = f"class binary, n_shingles long, window array<long>, members {MEMBERS}"
SETS = "region binary, class binary, shingles array<long>, active boolean"
LINKS = "x binary, y binary"
#: So few documents are compared one by one; more are cut into cells.
LEAF = 4
MOST_PIVOTS = 16
#: Pivots of large regions are broadcast up to so many shingles, of eight bytes each.
BROADCAST_SHINGLES = 4_000_000
#: A small row of each large region is broadcast up to so many of them.
MOST_REGIONS = 100_000


def allowed(n: np.ndarray | int, percent: int):
    """How many of its n shingles a document may have that a linked one lacks."""
    return n - -(-percent * n // 100)


def _class_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def features(docs: DataFrame, k: int, percent: int, block_bytes: int) -> DataFrame:
    """Rows of FEATURES, one for each class in a block: a class is a hash of a shingle set, null without shingles.

    window: its rarest shared shingles; members: the ids and text hashes of the block's documents with that set.
    """
    held: dict = {}

    def items(ids, texts):
        powers = held.setdefault("powers", Powers())
        classes: dict[bytes, int] = {}
        units, of, sizes = [], [], []
        for s in shingle_sets(texts, k, powers):
            if not len(s):
                of.append(0)
                continue
            c = classes.setdefault(_class_of(s), len(classes))
            if c == len(units):
                units.append(np.unique(short(s)))
                sizes.append(len(s))
            of.append(c + 1)
        known = np.array([i is not None for i in ids], np.uint8)
        hashes = np.array([text_hash(t) for t in texts], np.int64).view(np.uint64)
        notes = pack(known, np.array([i or 0 for i in ids], np.int64), hashes, np.array(of, np.int64), np.array(sizes, np.int64), np.array([len(u) for u in units], np.int64), b"".join(classes))
        return units, notes

    def rows(notes, unit, item, count):
        known, ids, hashes, of, sizes, distinct, names = unpack(notes)
        of, sizes, distinct = of.astype(np.int64), sizes.astype(np.int64), distinct.astype(np.int64)
        shared = np.bincount(unit, minlength=len(sizes))
        length = allowed(sizes, percent) - (distinct - shared) + 1
        order = np.lexsort((item, count, unit))
        place = np.arange(len(order)) - np.searchsorted(unit[order], unit[order])
        chosen = order[place < length[unit[order]]]
        # Row 0 is for documents without shingles, row c for class c - 1.
        n_window = np.bincount(unit[chosen] + 1, minlength=len(sizes) + 1)
        window = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_window)), pa.int32()), pa.array(item[chosen].astype(np.int64)))
        by_class = np.argsort(of, kind="stable")
        n_members = np.bincount(of, minlength=len(sizes) + 1)
        member = pa.StructArray.from_arrays([pa.array(ids.astype(np.int64)[by_class], mask=known[by_class] == 0), pa.array(hashes.view(np.int64)[by_class])], ["doc_id", "text_hash"])
        members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_members)), pa.int32()), member)
        name = pa.array([None, *(names[i : i + 16] for i in range(0, len(names), 16))], pa.binary())
        out = pa.RecordBatch.from_arrays([name, pa.array(np.append(0, sizes)), window, members], names=["class", "n_shingles", "window", "members"])
        return out if n_members[0] else out.slice(1)

    return recurring_items(docs, items, rows, FEATURES, block_bytes=block_bytes)


class Region:
    """The shingle sets of a region's documents, with the documents of each shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.docs = of[np.argsort(token, kind="stable")]
        counts = np.bincount(token)
        self.begin = np.cumsum(counts) - counts
        self.counts = counts
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])

    def overlaps(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents that share a shingle with document p, how many they share)."""
        t = self.tokens[p]
        n = self.counts[t]
        near = self.docs[np.repeat(self.begin[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        if len(near) < len(self.sizes):
            return np.unique(near, return_counts=True)
        both = np.bincount(near, minlength=len(self.sizes))
        who = np.flatnonzero(both)
        return who, both[who]


class Groups:
    """Documents found to be linked."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)


def _compare(region: Region, members: list[int], active: np.ndarray, percent: int, groups: Groups) -> None:
    """Links of active documents of a region, one after the other, with all of it; members are their numbers in groups."""
    settled = ~active
    must, done = np.zeros(len(members), bool), np.zeros(len(members), bool)
    stack = np.flatnonzero(active)[::-1].tolist()
    while stack:
        p = stack.pop()
        if done[p] or (settled[p] and not must[p]):
            continue
        done[p] = True
        who, both = region.overlaps(p)
        union = region.sizes[who] + region.sizes[p] - both
        ball = 100 * both >= percent * union
        for i in who[ball].tolist():
            groups.link(members[p], members[i])
        settled[who[ball]] = True
        # Within 2e of the pivot, but not in its group: may link with a settled document of the ball.
        again = who[(100 * both >= (2 * percent - 100) * union) & ~ball]
        for z in again[~done[again] & ~must[again]].tolist():
            if groups.find(members[z]) != groups.find(members[p]):
                must[z] = True
                stack.append(z)


def _cells(region: Region, members: list[int], active: np.ndarray, percent: int, groups: Groups) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(what of a region is active still, (documents, whether each is active) of the Voronoi cells that have such)."""
    live = np.flatnonzero(active)
    pivots = live[np.unique(np.linspace(0, len(live) - 1, min(MOST_PIVOTS, max(2, math.isqrt(len(live))))).astype(int))]
    both = np.zeros((len(pivots), len(members)), np.int64)
    for k, p in enumerate(pivots.tolist()):
        who, n = region.overlaps(p)
        both[k, who] = n
    union = region.sizes + region.sizes[pivots][:, None] - both
    ball = 100 * both >= percent * union
    for k, i in zip(*(x.tolist() for x in np.nonzero(ball)), strict=True):
        groups.link(members[pivots[k]], members[i])
    root = np.array([groups.find(m) for m in members])
    ring = (100 * both >= (2 * percent - 100) * union) & ~ball & (root != root[pivots][:, None])
    # A document that came in inactive may be all that is left to compare with one that settles here.
    active = (active & ~ball.any(0)) | ring.any(0)
    far = 1 - both / union
    home = far.argmin(0)
    within = far <= far.min(0) + 2 * (100 - percent) / 100 + 1e-9
    cells = [(np.flatnonzero(w), active[w] & (home[w] == k)) for k, w in enumerate(within)]
    return active, [(docs, own) for docs, own in cells if own.any()]


def link_region(sets: list[np.ndarray], active: list[bool], percent: int) -> tuple[list[int], int]:
    """(for each document the first one of its group, as far as links of active documents reach; Voronoi cells made)."""
    groups, made = Groups(len(sets)), 0
    stack = [(list(range(len(sets))), np.array(active, bool))]
    while stack:
        members, live = stack.pop()
        region, cells = Region([sets[i] for i in members]), []
        if live.sum() > LEAF:
            live, cells = _cells(region, members, live, percent, groups)
            made += len(cells)
        if sum(len(docs) for docs, _ in cells) > 1.5 * len(members):  # cells that hold most of the region are no help
            cells = []
        if not cells:
            _compare(region, members, live, percent, groups)
        stack += [([members[i] for i in docs.tolist()], own) for docs, own in cells]
    return [groups.find(i) for i in range(len(sets))], made


def _join_regions(sets: DataFrame, percent: int, counter) -> DataFrame:
    """LINKS of each region's documents with the first one of their group."""

    def run(batches):
        region, names, shingles, active = None, [], [], []

        def close():
            roots, made = link_region(shingles, active, percent)
            if counter is not None:
                counter.add(made)
            pairs = [(names[i], names[r]) for i, r in enumerate(roots) if i != r]
            return pa.RecordBatch.from_arrays([pa.array([p[j] for p in pairs], pa.binary()) for j in (0, 1)], names=["x", "y"])

        for batch in batches:
            values, ends = batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).offsets.to_numpy()
            for i, (r, name, a) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if r != region and names:
                    yield close()
                    names, shingles, active = [], [], []
                region = r
                if names and names[-1] == name:  # rows come in order of their class
                    active[-1] |= a
                    continue
                names.append(name)
                shingles.append(values[ends[i] : ends[i + 1]].copy())
                active.append(a)
        if names:
            yield close()

    # By a hash of the region: a join by region before this would make a repartition by region itself drop out of the
    # plan, and adaptive execution may then split a region's rows or leave them where they were.
    return sets.repartition(F.xxhash64("region")).sortWithinPartitions("region", "class").mapInArrow(lean(run), LINKS)


def _cell(*parts) -> F.Column:
    return F.unhex(F.sha2(F.concat_ws("/", *[p.cast("string") if not isinstance(p, str) else F.hex(p) for p in parts]), 256))


def _labels(batches):
    """(region, for each pivot the smallest one that its ball is tied to by balls in common)."""
    for batch in batches:
        out = []
        for together in batch.column(1).to_pylist():
            groups = Groups(1 + max(max(ks) for ks in together))
            for ks in together:
                for k in ks:
                    groups.link(ks[0], k)
            out.append([groups.find(k) for k in range(len(groups.root))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["r", "label"])


def _split(sets: DataFrame, percent: int, pivots: int, depth: int, few: bool) -> tuple[DataFrame, DataFrame]:
    """(links with pivots, what is still to be compared: Voronoi cells, or the region where cells would not be smaller).

    few: whether the regions are few enough for a broadcast of a small row for each.
    """
    row_each = F.broadcast if few else (lambda df: df)
    chosen = [F.min_by(F.struct("class", "shingles"), F.xxhash64("class", F.lit(depth), F.lit(i))).alias(f"p{i}") for i in range(pivots)]
    some = sets.where("active").groupBy("region").agg(*chosen).select(F.col("region").alias("r"), F.posexplode(F.array(*[f"p{i}" for i in range(pivots)])).alias("k", "pivot"))
    # A row for each region, with its few pivots.
    some = cut(some.withColumn("name", F.col("pivot.class")).dropDuplicates(["r", "name"]).groupBy("r").agg(F.collect_list(F.struct("k", "name", F.col("pivot.shingles").alias("shingles"))).alias("pivots")))
    held = some.agg(F.sum(F.aggregate("pivots", F.lit(0), lambda n, p: n + F.size(p["shingles"])))).first()[0] or 0

    def measure(p):
        both = F.size(F.array_intersect("shingles", p["shingles"]))
        union = F.size("shingles") + F.size(p["shingles"]) - both
        return F.struct(p["k"].alias("k"), p["name"].alias("pivot"), (1 - both / union).alias("d"), (100 * both >= percent * union).alias("ball"), (100 * both >= (2 * percent - 100) * union).alias("ring"))

    measured = sets.join(F.broadcast(some) if held <= BROADCAST_SHINGLES else some, F.col("region") == F.col("r"))
    measured = measured.withColumn("to", F.transform("pivots", measure)).withColumn("balls", F.transform(F.filter("to", lambda t: t["ball"]), lambda t: t["k"]))
    measured = cut(measured.drop("pivots", "r"))
    # Pivots are one group if a document is in the balls of both; at most 2^pivots arrays a region.
    labels = measured.where(F.size("balls") > 0).groupBy("region").agg(F.collect_set("balls").alias("together")).mapInArrow(lean(_labels), "r binary, label array<int>")
    measured = measured.join(row_each(labels), F.col("region") == F.col("r")).drop("r")
    mine = F.transform("balls", lambda k: F.get("label", k))
    unsettled = F.exists("to", lambda t: t["ring"] & ~t["ball"] & ~F.array_contains(mine, F.get("label", t["k"])))
    home = F.array_min(F.transform("to", lambda t: F.struct(t["d"].alias("d"), t["k"].alias("k"))))
    reach = 2 * (100 - percent) / 100 + 1e-9
    # A row that came in inactive may be all that is left to compare with a row that settles here.
    placed = measured.withColumns({"home": home, "live": (F.col("active") & (F.size("balls") == 0)) | unsettled})
    placed = cut(placed.withColumn("within", F.transform(F.filter("to", lambda t: t["d"] <= F.col("home.d") + reach), lambda t: t["k"])).select("region", "class", "shingles", "live", F.col("home.k").alias("own"), "within", F.transform(F.filter("to", lambda t: t["ball"]), lambda t: t["pivot"]).alias("tied")))
    links = placed.select(F.col("class").alias("x"), F.explode("tied").alias("y")).where("x <> y")
    open_ones = placed.groupBy("region").agg(F.bool_or("live").alias("open"), (F.sum(F.size("within")) > 1.5 * F.count(F.lit(1))).alias("whole")).where("open").select(F.col("region").alias("r"), "whole")
    cells = placed.join(row_each(open_ones), F.col("region") == F.col("r"))
    cells = cells.withColumn("k", F.explode(F.when(F.col("whole"), F.array(F.lit(-1))).otherwise(F.col("within"))))
    cells = cells.select(_cell("region", F.col("k"), F.lit(depth)).alias("cell"), "class", "shingles", (F.col("live") & (F.col("whole") | (F.col("k") == F.col("own")))).alias("active"))
    return links, cut(_open(cells))


def _open(cells: DataFrame) -> DataFrame:
    """The rows of cells that have an active one."""
    wanted = cells.groupBy("cell").agg(F.bool_or("active").alias("open")).where("open").select(F.col("cell").alias("c"))
    return cells.join(wanted, F.col("cell") == F.col("c"), "left_semi").select(F.col("cell").alias("region"), "class", "shingles", "active")


def _blocks(sets: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Regions cut into blocks, a region for each two of them: every pair meets, no task holds more than two blocks."""
    parts = F.ceil(2 * F.col("total") / most).cast("int")
    own = F.pmod(F.xxhash64("class", F.lit("block")), parts).cast("int")
    dealt = sets.join(sizes.select(F.col("region").alias("r"), "total"), F.col("region") == F.col("r")).withColumns({"parts": parts, "own": own})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return _open(dealt.select(_cell("region", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "class", "shingles", "active"))


def join_regions(sets: DataFrame, *, percent: int, most: int, pivots: int = 8, depths: int = 4, counter=None) -> DataFrame:
    """LINKS that connect exactly the groups; regions of more than most shingles are cut before they are dealt to tasks."""
    found, rest = [], sets
    for depth in range(depths + 1):
        sizes = cut(rest.groupBy("region").agg(F.sum(F.size("shingles")).alias("total")))
        large = sizes.where(F.col("total") > most)
        n_large = large.limit(MOST_REGIONS + 1).count()
        if not n_large:
            found.append(_join_regions(rest, percent, counter))
            break
        found.append(_join_regions(rest.join(large, "region", "left_anti"), percent, counter))
        rest = rest.join(large, "region", "left_semi").select(*[c.split()[0] for c in SETS.split(", ")])
        if depth == depths:
            found.append(_join_regions(_blocks(rest, large, most), percent, counter))
            break
        links, rest = _split(rest, percent, pivots, depth, n_large <= MOST_REGIONS)
        found.append(links)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def regions(windows: DataFrame, rounds: int) -> DataFrame:
    """(class, regions array<binary>) of the classes whose windows (class, window) share a shingle with another's."""
    shingles = windows.select("class", F.explode("window").alias("shingle"))
    pivots = shingles.groupBy("shingle").agg(F.min("class").alias("region"), F.max("class").alias("last")).where("region <> last").select(F.col("shingle").alias("s"), "region")
    placed = cut(shingles.join(pivots, F.col("shingle") == F.col("s")).select("class", "region").distinct())
    # A pivot is in its own region, so each has a smallest one that it is in.
    smallest = cut(placed.groupBy("class").agg(F.min("region").alias("to")).select(F.col("class").alias("pivot"), "to"))
    for _ in range(rounds):
        placed = placed.join(smallest, F.col("region") == F.col("pivot")).select("class", F.col("to").alias("region")).distinct()
    return placed.groupBy("class").agg(F.collect_set("region").alias("regions"))


def jaccard_groups(
    docs: DataFrame,
    *,
    k: int = 5,
    percent: int = 80,
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = 2 << 20,
    most: int = 2_000_000,
    pivots: int = 8,
    depths: int = 4,
    rounds: int = 2,
    broadcast_rows: int = 200_000,
    keyed: bool = False,
    counter=None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link from percent similarity on.

    percent is above 50. most bounds the shingles that a task holds of a region; pivots and depths say how larger ones
    are cut. rounds: how often pivots hand over their regions. keyed adds text_hash, the xxhash64 of the row's text, and
    first: whether no other id and text of the group comes before the row's, ids that are null last. counter: a Spark
    accumulator that the tasks add the number of their Voronoi cells to.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    feats = cut(features(rows, k, percent, block_bytes))
    # Blocks that have a class give it the same window, as the shingles' counts are those of the corpus.
    windows = cut(feats.where(F.size("window") > 0).groupBy("class").agg(F.any_value("window").alias("window"), F.min(F.array_min("members")).alias("one")))
    placed = cut(regions(windows, rounds).join(windows.select(F.col("class").alias("c"), "one"), F.col("class") == F.col("c")).select("regions", "class", F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("hash")))

    def to_sets(batches):
        powers, known = Powers(), set()
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sets = shingle_sets(batch.column(2).cast(pa.binary()).to_pylist(), k, powers)
            same = []
            for i, (s, c) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)):
                if c not in known and len(s) and _class_of(s) == c:  # repeated rows give their set once a task
                    known.add(c)
                    same.append(i)
            chosen = [sets[i] for i in same]
            ends = np.cumsum([0, *map(len, chosen)])
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *chosen]).view(np.int64)))
            at = pa.array(same, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), values], names=["regions", "class", "shingles"])

    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash"))
    sets = rows.join(small_side(placed, broadcast_rows), same).select("regions", "class", "text").mapInArrow(lean(to_sets), "regions array<binary>, class binary, shingles array<long>")
    sets = cut(sets.select(F.explode("regions").alias("region"), "class", "shingles", F.lit(True).alias("active")))
    groups = components(join_regions(sets, percent=percent, most=most, pivots=pivots, depths=depths, counter=counter))
    labelled = feats.drop("window").join(groups.withColumnRenamed("node", "c"), F.col("class") == F.col("c"), "left").withColumn("group", F.coalesce("root", "class")).select("n_shingles", "group", "members")
    first = F.array_min(F.transform("members", lambda m: F.struct(m["doc_id"].isNull().alias("unknown"), m["doc_id"].alias("doc_id"), m["text_hash"].alias("text_hash"))))
    # Written, so that the join deals both sides itself and may split a large group's rows.
    least = cut(labelled.where("group IS NOT NULL").groupBy(F.col("group").alias("g")).agg(F.min(first).alias("best")))
    each = labelled.join(least, F.col("group") == F.col("g"), "left").select(F.explode("members").alias("m"), "n_shingles", "best")
    out = each.select("m.doc_id", "n_shingles", F.coalesce("best.doc_id", "m.doc_id").alias("component_id"), "m.text_hash", "best")
    if not keyed:
        return out.drop("text_hash", "best")
    leads = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return out.select("doc_id", "n_shingles", "component_id", "text_hash", (F.col("best").isNull() | leads).alias("first"))
