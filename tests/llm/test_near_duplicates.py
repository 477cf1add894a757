import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from leakscope.llm import neardup
from leakscope.llm.neardup import drop_near_duplicates, duplicate_report, near_duplicates, one_permutation, shingle_sets

SCHEMA = "doc_id long, text string, node string, k_id string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def got(df, window, percent=80):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in duplicate_report(df, window, percent).collect()}


def near_copies(seed):
    """Groups around the limit: some words of a base text changed."""
    random.seed(seed)
    rows = []
    for g in range(6):
        base = [f"w{random.randint(0, 10**6)}" for _ in range(150)]
        for _ in range(12):
            w = list(base)
            for at in random.sample(range(150), random.randint(0, 9)):
                w[at] = f"v{random.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 101 + 1000 * g, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [4000, 3])
def test_groups_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_copies(1)
    assert got(frame(spark, rows), 4) == brute.near_duplicates(rows, 4, 80)


def test_documents_with_five_words(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(df, 5) == brute.near_duplicates([(r.doc_id, r.text) for r in df.collect()], 5, 80)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "a b"), (8, "A  b"), (7, "a b c"), (6, "a b c d e"), (2, "a b c d e"), (1, "x " * 30000)]
    assert got(frame(spark, rows), 4) == {5: (0, 5), 4: (0, 4), 3: (0, 3), 9: (1, 8), 8: (1, 8), 7: (1, 7), 6: (2, 2), 2: (2, 2), 1: (1, 1)}
    twice = frame(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q"), (2, "r")])
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in duplicate_report(twice, 4).collect()), key=str)
    assert out == sorted([(1, None, False), (1, None, False), (None, None, True), (2, 2, True), (2, 2, True)], key=str)
    assert duplicate_report(frame(spark, []), 4).count() == 0


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = near_copies(2) + [(50_000, None), (50_001, ""), (None, "only one")]
    df = frame(spark, rows + rows[:5])  # repeated rows leave one
    kept = drop_near_duplicates(df, 5)
    want = brute.near_duplicates([(i, t) for i, t in rows if i is not None], 5, 80)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, root) in want.items() if i == root)
    assert near_duplicates(df, 5).count() == df.count()


def test_sketches_agree_like_the_sets():
    rng = np.random.default_rng(1)
    for size, share in ((400, 0.8), (9, 0.5)):
        agree = []
        for _ in range(150):
            both = round(size * share)
            a, b = (np.unique(rng.integers(0, 2**64 - 1, size - both, dtype=np.uint64)) for _ in range(2))
            common = rng.integers(0, 2**64 - 1, both, dtype=np.uint64)
            s = one_permutation([np.unique(np.concatenate((x, common))) for x in (a, b)])
            agree.append((s[0] == s[1]).mean() - both / (2 * size - both))
        assert abs(np.mean(agree)) < 0.03


def test_shingles_lower_ascii_only():
    a, b, c = shingle_sets(pa.array(["One Two É", "one two É", "one two é"]), 2)
    assert a.tolist() == b.tolist() and a.tolist() != c.tolist()


def test_short_texts_at_the_limit_lose_no_link(spark):
    """Pairs of 4 to 12 words whose similarity is at or around 0.8."""
    random.seed(4)
    word, rows = iter(range(10**6, 10**7)), []
    for _ in range(3000):
        w = [f"w{random.randint(0, 10**7)}" for _ in range(random.randint(4, 12))]
        other = w[:-1] if random.random() < 0.7 else w[1:] if random.random() < 0.5 else [*w, f"v{next(word)}"]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b c d e f w4507769 w9826643", "a b c d e f w4507769"])]
    assert got(frame(spark, rows), 4) == brute.near_duplicates(rows, 4, 80)


@pytest.mark.parametrize("block, few", [(4000, 24), (100, 3)])
def test_a_large_group_just_below_the_limit(spark, monkeypatch, block, few):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "FEW", few)
    random.seed(6)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(600):
        w = list(base)
        for at in random.sample(range(120), random.choice([2, 3, 3, 4, 4])):
            w[at] = f"v{random.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    want = brute.near_duplicates(rows, 4, 80)
    assert 5 < len({root for _, root in want.values()}) < 595
    assert got(frame(spark, rows), 4) == want


@pytest.mark.parametrize("few", [0, 100])
def test_links_of_a_cell_join_what_full_sets_join(monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    rng = np.random.default_rng(3)
    for parts in (1, 2):
        for _ in range(30):
            common = rng.integers(0, 10**6, 40, dtype=np.uint64)
            sets = [np.unique(np.concatenate((common[rng.random(40) < 0.93], rng.integers(10**7, 10**8, rng.integers(0, 5), dtype=np.uint64)))) for _ in range(14)]
            groups, mine = rng.integers(0, 9, 14), rng.integers(0, parts, 14)
            found = neardup.forest(mine, groups, sets, 80)
            near = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
            assert all(near(i, j) for i, j in found) and len(found) < 14

            def joined(links, groups=groups):
                label = groups.copy()
                for _ in range(14):
                    for i, j in links:
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
                return label.tolist()

            two = len(np.unique(mine)) == 2
            every = [(i, j) for i in range(14) for j in range(i) if near(i, j) and (not two or mine[i] != mine[j])]
            assert joined(found) == joined(every)
