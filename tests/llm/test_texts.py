"""Decontamination, pseudonyms, quality, mixing."""
import random
import re
from collections import Counter
from datetime import date, timedelta

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakscope.llm import quality
from leakscope.llm.decontaminate import contamination_report, decontaminate
from leakscope.llm.mixing import mix_sources, source_rates
from leakscope.llm.pseudonyms import ANY, pseudonymise
from leakscope.llm.queries import DEMO_KEY, feistel_pseudonyms


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, found string, p string, score int")


# ---------------------------------------------------------------- decontamination

ITEM = "What is the Capital of the country, where twelve rivers meet?"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_windows_hits_and_offsets(spark):
    bench = items(spark, [(2, ITEM), (10, "short item"), (3, None), (4, "!!"), (2, "second part of two")])
    rows = [(1, f"Élan... {ITEM.upper()} end"), (2, "a SHORT--item, here"), (3, "shortitem short items"), (4, None), (5, ""), (6, "what is the capital of the country where twelve rivers")]
    out = {r.doc_id: r for r in contamination_report(docs_of(spark, rows), bench).collect()}
    assert (out[1].n_words, out[1].n_hit, out[1].n_items) == (13, 11, 1)
    assert [rows[0][1][s.start : s.end] for s in out[1].spans] == [ITEM.upper()[:-1]]
    assert (out[2].n_hit, out[2].contaminated) == (2, True)
    assert [out[i].n_hit for i in (3, 4, 5)] == [0, 0, 0] and out[4].n_words == 0
    assert out[6].n_hit == 10
    assert [r.doc_id for r in decontaminate(docs_of(spark, rows), bench).orderBy("doc_id").collect()] == [3, 4, 5]
    assert decontaminate(docs_of(spark, rows), bench).columns == ["doc_id", "text", "found", "p", "score"]


def test_empty_benchmark_and_documents(spark):
    none = items(spark, [])
    rows = [(1, "x y"), (1, "x y")]
    assert [r.n_hit for r in contamination_report(docs_of(spark, rows), none).collect()] == [0, 0]
    assert contamination_report(docs_of(spark, []), items(spark, [(1, "x")])).count() == 0


def test_very_long_text_is_scanned_to_its_end(spark):
    out = contamination_report(docs_of(spark, [(1, "word " * 300_000 + ITEM)]), items(spark, [(7, ITEM)])).first()
    assert (out.n_words, out.n_hit) == (300_011, 11)


# ---------------------------------------------------------------- pseudonyms

VALUES = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "+1 (017) 555-7713", "+1 212-555-0100", "192.168.1.20", "123-45-6789", "1985-03-04", "und.34@mail7.example.com", "a@b.org", "Évi_X9@mail.example.com",
          "иван.петров@mail.example.com", "李@b.org", "2099-12-31", "1921-06-23", "+91 98765 43210", "+44 20 7946 0958", "+4930123456", "+352-621-123456"]
INVALID = ["4111111111111112", "2024-02-30", "1899-12-31", "300.1.1.1", "01.2.3.4", "666-12-3456", "123-00-4567", "12345", "0000000000000000"]


def test_values_keep_format_validity_and_links(spark):
    rows = [(i, f"see {v}, or {v}!") for i, v in enumerate(VALUES)] + [(50 + i, f"no {v} here") for i, v in enumerate(INVALID)] + [(90, None), (91, ""), (92, VALUES[0])]
    df = docs_of(spark, rows)
    out = {r.doc_id: r for r in pseudonymise(df, "key", count="n").collect()}
    for i, v in enumerate(VALUES):
        new = brute.pseudonym(v, "key")
        assert out[i].text == f"see {new}, or {new}!" and out[i].n == 2 and new != v
        if "@" not in v and v.count(".") != 3:
            assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
    for i, v in enumerate(INVALID):
        assert out[50 + i].text == f"no {v} here" and out[50 + i].n == 0
    assert (out[90].text, out[90].n, out[91].text) == (None, 0, "") and out[92].text == brute.pseudonym(VALUES[0], "key")
    back = pseudonymise(pseudonymise(df, "key"), "key", back=True)
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert out[0].text != next(r.text for r in pseudonymise(df, "other").collect() if r.doc_id == 0)


def test_cards_beside_other_numbers(spark):
    card, amex = "4111 1111 1111 1111", "3782-822463-10005"
    rows = [f"card {card} 12/25", f"card {card} 123", f"ref 12 {card.replace(' ', '')}", f"{card.replace(' ', '')} 10.0.0.1", f"1234 {card}", f"{amex} 1985-03-04",
            f"4222222222222 1985-03-04 {amex}", f"{amex.replace('-', '')} 123-45-6789", f"{card} {card} 5", f"168 {card} +1 212-555-0100", f"{card} 12th", f"7 12345-67 {card} 1@b.org"]
    values = [card, card.replace(" ", ""), amex, amex.replace("-", ""), "4222222222222", "10.0.0.1", "1985-03-04", "123-45-6789", "+1 212-555-0100", "1@b.org"]
    either = re.compile("|".join(map(re.escape, values)))
    out = {r.doc_id: r for r in pseudonymise(docs_of(spark, list(enumerate(rows))), "key", count="n").collect()}
    for i, old in enumerate(rows):
        assert out[i].text == either.sub(lambda m: brute.pseudonym(m[0], "key"), old) and out[i].n == len(either.findall(old))


def test_long_run_of_numbers(spark):
    text = "12 345 " * 3000 + "4111 1111 1111 1111"
    assert not pseudonymise(docs_of(spark, [(1, text)]), "key").first().text.endswith("4111 1111 1111 1111")


def test_maps_are_bijections(spark):
    dates = [(date(1900, 1, 1) + timedelta(days=n)).isoformat() for n in range(73049)]
    assert dates[-1] == "2099-12-31"
    ips = [f"10.0.{a}.{b}" for a in range(5) for b in range(40)]
    df = docs_of(spark, list(enumerate(dates + ips)))
    moved = pseudonymise(df, "k").collect()
    assert len({r.text for r in moved}) == len(dates) + len(ips)
    assert {r.text for r in moved if r.doc_id < len(dates)} == set(dates)
    back = pseudonymise(spark.createDataFrame(moved, df.schema), "k", back=True).collect()
    assert {r.doc_id: r.text for r in back} == dict(enumerate(dates + ips))


def test_numbers_abroad_need_their_length(spark):
    rows = ["+91 98765 43210 and +44 20 7946 0958", "+49 1234", "+12", "x+4930123456", "+49 30 11111111111111111111", "+4930123456 1985-03-04", "+91 98765 43210 4111 1111 1111 1111"]
    out = {r.doc_id: r for r in pseudonymise(docs_of(spark, list(enumerate(rows))), "key", count="n").collect()}
    assert [out[i].n for i in range(7)] == [2, 0, 0, 0, 0, 2, 2] and out[0].text[:4] == "+91 " and " and +44 " in out[0].text
    assert [out[i].text for i in range(1, 5)] == rows[1:5]


def test_query_like_plain_version(spark, sf):
    pattern = ANY.replace(r"++@", r"+@").replace(r"\p{L}\p{N}", r"^\W_").replace(r"[^\W_._%+-]", r"[\w.%+-]")
    old = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for r in feistel_pseudonyms(spark, sf).collect():
        new = re.sub(pattern, lambda m: brute.pseudonym(m[0], DEMO_KEY), old[r.doc_id].text)
        assert r.text == new
        found += r.n_replaced
    assert found > 5


def test_stays_in_the_jvm(spark, sf):
    plan = feistel_pseudonyms(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


# ---------------------------------------------------------------- quality

def test_repeated_ids_are_learned_once(spark):
    docs = docs_of(spark, [(i, t) for i in range(30) for t in ([f"text {i}"] if i else [f"text {n}" for n in range(200)])])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    rows = [sorted(map(tuple, quality.training_rows(docs.repartition(n), labels).collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == len({r[0] for r in rows[0]})


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()


def test_flattened_trees_like_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)).astype(np.float32)
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.fit_forest(x, y, trees=12, depth=3)

    def walk(row):
        total = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))

    p = forest.predict(x)
    assert np.allclose(p, [walk(r) for r in x]) and ((p >= 0.5) == y).mean() > 0.95


def test_odd_rows_for_quality(spark):
    docs = docs_of(spark, [(1, None), (2, ""), (None, "text"), (3, "a b c"), (3, "a b c"), (4, "x" * 3_000_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_quality(docs, none).collect()] == [0.5] * 6
    one = spark.createDataFrame([(1, 1, 0), (3, 1, None), (3, None, 0), (None, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 for r in quality.score_quality(docs, one).collect())
    assert quality.score_quality(docs_of(spark, []), one).count() == 0
    folds = {r.doc_id: r.held_out for r in quality.score_quality(docs, none).collect()}
    import zlib
    assert folds == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1 for i in folds}


def test_features_don_t_depend_on_blocks():
    texts = pa.array(["One two  two\nline | x", None, "", "ÀÉ!! 99 $$", "a\n\nb\nb"])
    alone = np.concatenate([quality.features(texts.slice(i, 1)) for i in range(5)])
    assert np.allclose(alone, quality.features(texts)) and not alone[1].any() and not alone[2].any()


# ---------------------------------------------------------------- mixing

def mixed_rows(spark):
    random.seed(3)
    rows = [(i, f"t{i}", random.choice(["a", "a", "a", "b", None]), 7) for i in range(600)] + [(None, "n", "b", 7), (5, "t5", "b", 7), (5, "t5", "b", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")


def test_every_document_has_its_draw(spark):
    df = mixed_rows(spark)
    rates = {r.source: r.rate for r in source_rates(df).collect()}
    n = Counter(r.source for r in df.collect())
    assert all(abs(rates[s] - np.sqrt(n[s]) / sum(map(np.sqrt, n.values())) * 603 / n[s]) < 1e-12 for s in n)
    out = mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "copy", "copy_"]
    want = Counter()
    for r in df.collect():
        for c in range(1, brute.copies(r.doc_id, rates[r.source], 42) + 1):
            want[(r.doc_id, r.text, r.source, 7, c)] += 1
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == want and got == [tuple(r) for r in mix_sources(df).collect()]
    assert [r[0] for r in got] != sorted((r[0] for r in got), key=str)


def test_weights_and_size(spark):
    df = mixed_rows(spark)
    got = mix_sources(df, {"b": 1.0, None: 1.0}, size=4000).groupBy("source").count().collect()
    assert {r.source for r in got} == {"b", None} and all(abs(r["count"] - 2000) < 250 for r in got)
    assert mix_sources(df, {}).count() == 0 and mix_sources(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="rate over the limit"):
        mix_sources(df, {"b": 1.0}, size=10**6).count()


def test_rates_of_any_size(spark):
    """A source with one row beside a large one has a rate over 500 without that anybody asked for it."""
    rows = spark.range(1_200_000).selectExpr("id as doc_id", "if(id < 5, concat('few', id), 'many') as source")
    rates = {r.source: r.rate for r in source_rates(rows).collect()}
    assert rates["few1"] > 1000 and rates["many"] < 1
    got = {r.doc_id: r.n for r in mix_sources(rows).filter("source != 'many'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(got) == 5 and len(set(got.values())) > 1
    assert all(abs(n - rates["few1"]) < 5 * np.sqrt(rates["few1"]) for n in got.values())
    assert got == {r.doc_id: r.n for r in mix_sources(rows).filter("source != 'many'").groupBy("doc_id").agg(F.max("copy").alias("n")).collect()}
