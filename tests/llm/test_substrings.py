import hashlib
import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakscope.llm import passages
from leakscope.llm import phrases as phrase_module
from leakscope.llm.phrases import PassageAutomaton, phrase_dedup
from leakscope.llm.suffixes import suffix_array, suffix_dedup

SCHEMA = "doc_id long, text string, k_id string, found int, gone int, n_bytes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def suffixes(df, window, gram):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, window, gram).collect()}


def phrases(df, window, gram):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup(df, window, gram).collect()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(symbols):
    text = np.array(symbols, np.int64)
    assert suffix_array(text).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.fixture(params=[4000, 2], ids=["usual", "hot keys"])
def hot(request, monkeypatch):
    monkeypatch.setattr(passages, "HOT", request.param)


def texts(seed, unit, sizes):
    random.seed(seed)
    made = [(i, unit.join(random.choice(["a", "b", "é"]) for _ in range(random.randint(0, sizes)))) for i in range(60)]
    return made + [(100, None), (101, ""), (102, unit.join(["a", "b"]) * 150), (103, made[7][1] * 3), (104, made[7][1] * 3), (None, made[9][1]), (-5, "x" * 900 + unit + "y")]


def test_suffix_dedup_like_brute_force(spark, hot):
    rows = texts(1, "", 90)
    assert suffixes(frame(spark, rows), 12, 4) == brute.suffix_dedup(rows, 12)


def test_phrase_dedup_like_brute_force(spark, hot):
    rows = texts(2, " ", 60)
    assert phrases(frame(spark, rows), 10, 3) == brute.phrase_dedup(rows, 10)


def test_production_parameters(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert suffixes(df, 100, 40) == brute.suffix_dedup(rows, 100)
    assert phrases(df, 35, 8) == brute.phrase_dedup(rows, 35)


def test_repeated_rows_are_one_place(spark):
    text = " ".join(f"w{i}" for i in range(60))
    once = frame(spark, [(1, text), (1, text), (2, "short")])
    assert suffixes(once, 100, 40)[1][1] == 0 and suffix_dedup(once).count() == 3
    assert phrases(once, 35, 8)[1][1] == 0 and phrase_dedup(once).count() == 3
    twice = frame(spark, [(1, text), (1, text), (2, text)])
    assert suffixes(twice, 100, 40)[2][1] == len(text) and suffixes(twice, 100, 40)[1][1] == 0
    assert {v[1] for v in phrases(twice, 35, 8).values()} == {60}


def test_very_long_text_and_empty_table(spark):
    random.seed(4)
    long = " ".join(str(random.randint(0, 10**6)) for _ in range(400_000))
    df = frame(spark, [(1, long), (2, "zz " + long[1000:1400])])
    assert suffixes(df, 100, 40)[2][1:3] == (400, 1)
    assert 0 < phrases(df, 35, 8)[2][1] <= 70
    empty = frame(spark, [])
    assert suffix_dedup(empty).count() == phrase_dedup(empty).count() == 0


def test_automaton_finds_passages_in_any_document():
    a = PassageAutomaton([[b"x", b"y"], [b"y", b"z", b"y"]])
    assert a.found([b"q", b"x", b"y", b"z", b"y", b"y"]).tolist() == [False, True, True, True, True, False]
    assert not PassageAutomaton([]).found([b"x"]).any()


def test_segments_of_one_key_in_any_batches():
    import pyarrow as pa

    random.seed(8)
    at = {(random.randint(0, 9), random.randint(0, 30) << 32): (random.randint(0, 6), random.randint(0, 3)) for _ in range(200)}
    rows = sorted([(*v, *k) for k, v in at.items()] + [(*v, *k) for k, v in list(at.items())[:20]])  # some rows twice
    places = set(rows)
    for both in (False, True):
        want = set()
        for r in places:
            same = [x for x in places if x[:2] == r[:2]]
            if (len(same) > 1 if both else min(same) != r):
                want.add((True, r[0], *r[2:]))
            if r == min(same) and len({x[1] for x in places if x[0] == r[0]}) > 1:
                want.add((False, r[0], *r[2:]))
        for size in (1, 3, 50):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], ["key", "content", "k_id", "at"]) for i in range(0, len(rows), size)]
            got = [tuple(r.values()) for b in passages._judge(both)(iter(batches)) for r in b.to_pylist()]
            assert set(got) == want and len(got) == len(want)


def test_listings_that_differ_in_one_entry(spark):
    """Boilerplate after every entry gives many windows one key; what lies between the first and the last of them counts too."""
    from leakscope.llm.common import rolled, word_hashes

    words = [[f"k{i}x{j}" for j in range(8)] for i in range(3000)]

    def key(phrase):
        raw = np.frombuffer(" ".join(phrase).encode(), np.uint8)
        end = np.append(np.flatnonzero(raw == 32), len(raw))
        return rolled(word_hashes(raw, np.append(0, end[:-1] + 1), end), 8)[0]

    phrase = min(words, key=key)  # a gram that is the smallest wherever it stands
    entries = [[f"e{i}w{j}" for j in range(20)] for i in range(4)]
    other = entries[1][:7] + [f"o{j}" for j in range(13)]  # words 35 to 47 of its page
    page = lambda *own: " ".join(w for e in own for w in e + phrase)
    rows = [(1, page(*entries)), (2, page(entries[0], other, *entries[2:]))]
    assert phrases(frame(spark, rows), 35, 8) == brute.phrase_dedup(rows, 35)


def test_passages_with_more_words_than_characters(spark):
    """Two copies of a text with 1.2 million different words, and a document that shares a stretch of it."""
    text = " ".join(f"w{i:x}" for i in range(1_200_000))
    rows = [(1, text), (2, "before " + text), (3, "other " + " ".join(f"w{i:x}" for i in range(900_000, 900_100)) + " words"), (4, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_dedup(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (1_200_000, 1_200_000, sha("")), 2: (1_200_001, 1_200_000, sha("before")), 3: (102, 100, sha("other words")), 4: (3, 0, sha("w1 w2 w3"))}


def test_passages_in_pieces_and_several_automata(monkeypatch):
    monkeypatch.setattr(phrase_module, "PIECE_WORDS", 6)
    monkeypatch.setattr(phrase_module, "AUTOMATON_WORDS", 8)
    words = [f"w{i}".encode() for i in range(40)]
    confirmed = {tuple(words[:20]), tuple(words[25:31]), tuple(words[33:36])}
    assert all(len(p) in (3, 6) for x in confirmed for p in phrase_module.pieces(x))
    found = sum(a.found(words).astype(int) for a in phrase_module.automata(confirmed)) > 0
    assert found.tolist() == [i < 20 or 25 <= i < 31 or 33 <= i < 36 for i in range(40)]
    assert list(phrase_module.automata(set())) == [] and len(list(phrase_module.automata(confirmed))) > 2
