"""Fill-in-middle over seekable frames."""
import hashlib
import random

import brute
import pytest
import zstandard
from pyspark.sql import functions as F

from leakscope.llm.fim import arranged, by_bytes, by_code_points, digest, fill_in_middle, frame_store, markers, rebuilt, restored, unframed

SCHEMA = "doc_id long, text string, n string, frames int, output string"
ODD = ["", "a", "é", "😀", "<P>", "x<S>y", "a<M", "<P", ">", "<<P", "P>S>M>", "áb\r\n\t c", "\u0000z"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, "y") for i, t in rows], SCHEMA)


def results(df, units):
    made = fill_in_middle(frame_store(df, units=units))
    text = unframed(restored(F.col("output"), F.col("form")))
    rows = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", unframed(F.col("output")).alias("out"), digest(F.col("output")).alias("sha"), text.alias("back"))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("units", [1, 3, 1 << 15])
def test_like_plain_version_and_back(spark, units):
    random.seed(units)
    alphabet = "ab é😀<>PSM\ń"
    rows = [(i, "".join(random.choices(alphabet, k=random.choice([1, 2, 7, 30, 90])))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(-5, "minus"), (None, "no id"), (None, None), (7, None), (3, "again"), (3, "again")]
    got = results(docs_of(spark, rows), units)
    wanted = []
    for i, t in rows:
        n, form, prefix, middle, out = brute.fill_in_middle(i, t)
        wanted.append((i, n, form, prefix, middle, out, hashlib.sha256(out.encode()).hexdigest(), t or ""))
    assert got == sorted(wanted, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_frames_between_cuts_are_taken_over_and_others_never_read():
    writer = zstandard.ZstdCompressor()
    text = "".join(chr(0x61 + i % 26) for i in range(1000))
    frames, ends = [writer.compress(text[i : i + 100].encode()) for i in range(0, 1000, 100)], list(range(100, 1001, 100))
    read = []
    seekable = by_code_points(frames, ends)
    whole = seekable.raw
    seekable.raw = lambda i: read.append(i) or whole(i)
    out = arranged(seekable, "psm", 250, 730, writer)
    assert set(read) == {2, 7}
    assert sum(f in frames for f in out) == 8
    back = rebuilt(by_bytes(out), "psm", writer)
    assert b"".join(map(zstandard.ZstdDecompressor().decompress, back)).decode() == text


def test_markers_across_frames_and_wrong_form():
    writer = zstandard.ZstdCompressor()
    cut = by_bytes([writer.compress(x) for x in (b"ab<", b"S", b">c<P><M", b">")])
    assert markers(cut) == {b"<S>": 2, b"<P>": 6, b"<M>": 9}
    with pytest.raises(ValueError):
        rebuilt(cut, "psm", writer)


def test_long_text_and_empty_table(spark):
    text = "wörd " * 400_000
    (row,) = results(docs_of(spark, [(11, text)]), 1 << 15)
    assert row[-1] == text and row[1] == len(text) and row[5] == brute.fill_in_middle(11, text)[4]
    assert results(docs_of(spark, []), 1 << 15) == []
    store = frame_store(docs_of(spark, [(11, text)])).first()
    assert len(store.frames) == -(-len(text) // (1 << 15)) and store.ends[-1] == len(text)
