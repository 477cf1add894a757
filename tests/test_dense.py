"""Dump-like texts: thousands of matches in one text, wide rows through the joined context profile."""
from pyspark.sql import functions as F

from leakscope.operators.context import scan_in_context
from leakscope.operators.detect import lexical_scorer, scan
from leakscope.operators.redact import redact_documents


def test_dump(spark):
    n = 3000
    text = "".join(f"é+91 {9000000000 + i}, " for i in range(n))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    rows = scan(df, filename=None).orderBy("start").collect()
    assert len(rows) == n
    for r in rows[:: n // 50]:
        assert text[r.start:r.end] == r.value and r.value in r.snippet and len(r.snippet) <= 174
    out = redact_documents(df, mode="fixed").first()
    assert out.redactions == n and out.text == "é***REDACTED***, " * n


def test_joined_profile_equals_narrow_profile(spark):
    texts = ["My pan ABCPE1234F was leaked. Call 9876543210 or +91 9876543211!", "nothing", "sample ABCPE1234F\nmy mail a1@b.co"]
    docs = spark.createDataFrame([(i, {"k": "v"}, t) for i, t in enumerate(texts)], "doc_id long, metadata map<string,string>, text string")
    sentences = spark.createDataFrame([(s,) for s in [
        "My pan ABCPE1234F was leaked.", "Call 9876543210 or +91 9876543211!", "my mail a1@b.co", "sample ABCPE1234F"]], "sentence string")
    scores = sentences.select("sentence", lexical_scorer(F.col("sentence")).alias("scores"))
    cols = ["doc_id", "type", "value", "start", "end", "confidence", "risk", "annotation", "snippet"]
    narrow = sorted(map(tuple, scan(docs, "context", filename=None).select(*cols).collect()))
    joined = scan_in_context(docs, scores=scores, filename=None)
    assert narrow and sorted(map(tuple, joined.select(*cols).collect())) == narrow
    assert joined.filter(F.col("metadata")["k"] == "v").count() == len(narrow)
