import math
import random
from collections import Counter

from assaykit.llm.quality_rules import GRIDS, PATH, apply_rules, at_most, choose, document_stats, repeated_words, text_stats, upper_bound

from .helpers import corpus, docs, prose, words


def slow_stats(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {j for i, g in enumerate(windows) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [t for _, t in corpus(8)] + ["a b c d e a b c d e", "a " * 50, "x\nx\n\n \nx \ny", "é#é $$ |<> a", "\x0b\x0c", " ".join(rng.choice("ab") for _ in range(400))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: tuple(r)[2:] for r in document_stats(docs(spark, rows)).collect()}
    assert got == {i: slow_stats(t) for i, t in rows}
    assert text_stats(None) == text_stats(b"") == (0, 0, 0, 0, 0)


def test_repeats_with_a_large_vocabulary():
    import numpy as np

    ids = np.concatenate([np.arange(200_000), np.arange(100, 110)])
    assert repeated_words(ids, 200_000) == 20


def test_upper_bound_is_exact():
    for k, n, level in ((0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)):
        p = upper_bound(k, n, level)
        assert math.isclose(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), level, rel_tol=1e-6)
    assert upper_bound(5, 5, 0.05) == 1.0 and math.isclose(upper_bound(0, 100, 0.05), 1 - 0.05 ** (1 / 100), rel_tol=1e-6)


def test_tails_of_large_samples():
    assert math.isclose(at_most(999_000, 10**8, 0.01), 0.5 * math.erfc(1000 / math.sqrt(2 * 10**8 * 0.01 * 0.99)), rel_tol=1e-3)
    assert at_most(10, 10, 0.5) == 1.0 and math.isclose(at_most(0, 7, 0.3), 0.7**7) and math.isclose(at_most(6, 7, 0.3), 1 - 0.3**7)


def test_search_stops_at_the_first_failure():
    assert choose(10_000, [0, 0, 900, 0, 0], 0.02, 0.01) == 2
    assert choose(10_000, [0] * len(PATH), 0.02, 0.01) == len(PATH) and choose(100, [0] * 5, 0.02, 0.01) == 0
    assert choose(228, [0], 0.02, 0.01) == 1 and choose(227, [0], 0.02, 0.01) == 0
    for s, grid in GRIDS.items():
        assert [c for name, c in PATH if name == s] == list(grid) == sorted(grid, reverse=True)


def brute_cutoffs(rows, good, share, level_of):
    """{stratum: {signal: cutoff}} by trying every step of the path on every row, tails summed term by term."""
    named = {"symbols_per_char": lambda n, c, s, d, r: s / max(c, 1), "repeated_lines_per_word": lambda n, c, s, d, r: d / max(n, 1), "repeated_words": lambda n, c, s, d, r: r / max(n, 1), "chars_per_word": lambda n, c, s, d, r: c / max(n, 1)}
    by = {}
    for i, t, lang, _ in rows:
        stats = slow_stats(t)
        if i in good and stats[0] >= 10 and 100 * stats[4] <= 20 * stats[0]:
            by.setdefault(lang, []).append({s: f(*stats) for s, f in named.items()})
    out = {}
    for lang, own in by.items():
        out[lang], cuts = {}, {}
        for s, c in PATH:
            cuts = {**cuts, s: c}
            k, n = sum(any(x[s] > c for s, c in cuts.items()) for x in own), len(own)
            if sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) > level_of(len(by)):
                break
            out[lang] = cuts
    return out, named


def test_verdicts_match_brute_force_cutoffs(spark):
    """With ties at cutoffs, a stratum that stops early, one with too few rows, and clashing column names."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        lang = ["en", "de", None][i % 3] if i < 1440 else "few"
        dirt = rng.choice([0, 2, 3]) if lang == "de" and i % 7 == 0 else int(rng.random() < 0.01)
        rows.append((i, " ".join([*prose(rng, 24).split(), *["###"] * dirt, *(["x" * 400] if i % 50 == 0 else [])]), lang, "s"))
    good = {i for i in range(1500) if i % 50}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    for name in ("stratum", "s", "n", "steps", "first_step", "kept", "base_failed", "n_words", "cut_repeated_words"):
        table = table.selectExpr("*", f"'clash' AS {name}")
    cuts, named = brute_cutoffs(rows, good, 0.05, lambda strata: 0.05 / strata)
    assert len({str(c) for c in cuts.values()}) > 2 and cuts["few"] == {}
    got = {r["doc_id"]: r for r in apply_rules(table, labels, max_false_rejection=0.05).collect()}
    for i, t, lang, _ in rows:
        stats = slow_stats(t)
        above = {s for s, c in cuts[lang].items() if named[s](*stats) > c}
        failed = stats[0] < 10 or 100 * stats[4] > 20 * stats[0]
        assert set(got[i]["rejected_by"]) == above and got[i]["kept"] == (not failed and not above), (i, t)


def test_junk_goes_and_good_texts_stay(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 40) if i % 10 else " ".join(w + "###" for w in prose(rng, 40).split()), rng.choice(["en", "de", None]), "s") for i in range(6000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    out = apply_rules(docs(spark, rows + [(7000, None)] + rows[:2]), labels, max_false_rejection=0.05).collect()
    assert len(out) == 6003
    good = [r for r in out if r["doc_id"] % 10 and r["doc_id"] < 6000]
    assert sum(not r["kept"] for r in good) <= 0.05 * len(good)
    assert not any(r["kept"] for r in out if r["doc_id"] % 10 == 0)
    assert not any(r["kept"] for r in out if r["base_failed"])


def test_no_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = apply_rules(docs(spark, [(1, "### " * 30), (2, prose(random.Random(3), 30)), (3, "few"), (None, None)]), labels).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got} == {1: (True, False), 2: (False, True), 3: (True, False), None: (True, False)}
    assert apply_rules(docs(spark, [(1, "a")]).limit(0), labels).count() == 0
