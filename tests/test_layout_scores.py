"""Joins that move no text, error rows, cuts that are gone, scores kept between runs, the star of a scan's tables."""
import re
import uuid

import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from leakscope.operators.context import scan_in_context
from leakscope.operators.detect import scan
from leakscope.operators.fakefilter import filter_fake
from leakscope.operators.redact import redact_documents
from leakscope.operators.rollups import session_star
from leakscope.operators.scores import KeptScores, classified, with_scores
from leakscope.plans import scans as P
from leakscope.plans.state_queries import _never, _stored_star
from leakscope.sources.layout import bucketed_table, land_bucketed

CONTENTS = "repo string, branch string, path string, text string"


def exchanged(plan):
    """The lines of the plan that stand below an exchange."""
    lines, out = plan.split("\n"), []
    depth = lambda x: len(re.match(r"[ :+\-]*", x).group())
    for i, line in enumerate(lines):
        if " Exchange " in line or "- Exchange" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                out.append(below)
    return out


def repo_tables(spark, n=60):
    files = spark.range(n).select((F.col("id") % 3).cast("string").alias("repo"), F.lit("main").alias("branch"),
                                  F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit("blob").alias("type"), F.lit(5).cast("long").alias("size"))
    text = F.when(F.col("path") == "f7.py", None).otherwise(F.concat(F.lit("my pan ABCPE1"), F.lpad(F.regexp_extract("path", "f([0-9]+)", 1), 3, "0"), F.lit("F")))
    contents = files.filter("path <> 'f5.py'").select("repo", "branch", "path", text.alias("text"))
    extra = spark.createDataFrame([("9", "main", "f1.py", "pan ABCPE9999F")], CONTENTS)
    return files, contents.unionByName(extra)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_scan_moves_no_text(spark, tmp_path, no_broadcast):
    files, contents = repo_tables(spark)
    run = uuid.uuid4().hex
    listing, texts = (land_bucketed(df, f"{n}_{run}", str(tmp_path / n), buckets=4) for n, df in (("files", files), ("contents", contents)))
    out = P.scan_repo(listing, texts, colocated=True)
    below = exchanged(plan_of(out.findings))
    assert below and not any("text#" in line for line in below)
    plain = P.scan_repo(files, contents)
    rows = lambda r: sorted(map(tuple, r.findings.select("scan_id", "path", "value", "source_url", "source_key").collect()))
    assert rows(out) == rows(plain) and len(rows(out)) == 58
    again = bucketed_table(spark, f"again_{run}", str(tmp_path / "contents"), CONTENTS, buckets=4)
    assert not any("text#" in line for line in exchanged(plan_of(P.scan_repo(listing, again, colocated=True).findings)))
    assert P.scan_repo(listing, again, colocated=True).findings.count() == 58


def test_listed_sources_without_contents_are_errors(spark):
    files, contents = repo_tables(spark)
    out = P.scan_repo(files, contents)
    assert sorted((r.type, r.kind, r.target, r.path, r.message) for r in out.errors.collect()) == [
        ("error", "github", "1", "f7.py", "Scan failed: no content"), ("error", "github", "2", "f5.py", "Scan failed: no content")]
    assert out.stored().errors.count() == 2 and {r.total_sources_scanned for r in out.scanned.collect()} == {20}
    pastes = spark.createDataFrame([(k, f"u/{k}", "", "t", "text", 0, "0", "s") for k in ("a", "b")], "paste_id string, url string, raw_url string, title string, syntax string, size int, expire string, source string")
    result = P.scan_pastes(pastes, spark.createDataFrame([("a", "pan ABCPE1234F"), ("z", "pan ABCPE1234F")], "paste_id string, text string"))
    assert [(r.target, r.scan_id) for r in result.errors.collect()] == [("b", "pastes")] and result.findings.count() == 1


def test_names_of_files_leave_nothing_out(spark):
    df = spark.createDataFrame([("repo/package-lock.json", "my pan ABCPE1234F"), ("x.map", "write to a1@b.co")], "path string, text string")
    assert scan(df).count() == 2 and scan(df, screen=True).count() == 0
    assert {r.redactions for r in redact_documents(df).collect()} == {1}


# --- scores ------------------------------------------------------------------------------------------------------

def test_frequent_and_missing_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    scores = spark.createDataFrame([("hot", {"a": 0.5})] + [(str(i), {"a": i / 3000}) for i in range(8, 3000, 20)], "key string, scores map<string,double>")
    plain = rows.join(scores, rows["k"] == scores["key"], "left").select("id", F.col("scores")["a"])
    for frequent in (10, 10_000):
        got = with_scores(rows, scores, "k", frequent).select("id", F.col("_scores")["a"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    lacking = with_scores(rows, scores.filter("key <> 'hot'"), "k", 10)
    assert lacking.count() == 3000 and lacking.filter("_scores is not null").count() == 150


def test_each_text_is_classified_once_over_all_runs(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def scorer(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame[["t"]].assign(scores=[{"x": float(len(t))} for t in frame["t"]])

    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), (" ",)], "t string")
    kept = KeptScores(spark, str(tmp_path / "scores"), 4)
    assert classified(texts, "t", scorer, kept).count() == 2 and seen.value == 2
    assert classified(texts.unionByName(spark.createDataFrame([("ccc",)], "t string")), "t", scorer, kept).count() == 3 and seen.value == 3
    kept.add(kept.read(), "the same once more")
    assert kept.read().count() == 3
    assert sorted(r.scores["x"] for r in classified(texts, "t", _never, kept).collect()) == [1.0, 2.0, 3.0]


def test_context_scan_with_kept_scores(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{i}.txt", "call me, my aadhaar 2341 2341 2346 was leaked" if i % 2 else f"pan ABCPE{1000 + i}F was leaked") for i in range(40)], "doc_id long, path string, text string")

    def scorer(frames):
        for frame in frames:
            yield pd.DataFrame({"sentence": frame["sentence"], "scores": [{"Sensitive data being leaked, disclosed or exposed publicly": 0.9}] * len(frame)})

    kept = KeptScores(spark, str(tmp_path / "s"), 4)
    rows = lambda how: sorted(map(str, scan_in_context(docs, scorer=how, kept=kept).collect()))
    first = rows(scorer)
    assert rows(_never) == first and sorted(map(str, scan_in_context(docs, scorer=scorer).collect())) == first


def test_snippets_that_differ_behind_512_characters(spark):
    found = spark.createDataFrame([(i, "PAN", "x " * 400 + str(i), 0.65, "n") for i in range(6)], "id int, type string, snippet string, confidence double, annotation string")

    def scorer(frames):
        for frame in frames:
            yield frame.assign(scores=[{"test or dummy data": 0.9 if t.endswith(("1", "3")) else 0.1} for t in frame["snippet"]])

    assert sorted(r.id for r in filter_fake(found, scorer).filter("confidence < 0.6").collect()) == [1, 3]


# --- star --------------------------------------------------------------------------------------------------------

def test_star_reads_the_chosen_sessions_alone(spark, sf, tmp_path):
    _stored_star(spark, sf, str(tmp_path))
    plan = plan_of(session_star(spark, str(tmp_path), F.col("scan_type") == "github"))
    assert plan.count("dynamicpruning") >= 2 and "CartesianProduct" not in plan
    everything = session_star(spark, str(tmp_path))
    assert everything.agg(F.sum("findings")).first()[0] <= spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert everything.select("scan_type").distinct().count() == 3
