"""Candidates for repeated windows: what the substring operators share.

A window (so many consecutive symbols of one document) is keyed by the smallest hash of the grams inside it, so equal windows
have equal keys wherever they stand. Consecutive windows with the same key form a segment. Only segments whose key occurs with
another content can hold a window that recurs in part; segments with equal contents recur as a whole. Both are found by one
shuffle of segment headers and one pass over them in order, whose memory does not depend on how often a key occurs.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import NO_ID, mix, rolled, signed, sliding_min

MAX_RUN = 64
#: Keys with more distinct segments than this are dealt out anew by longer stretches of their contents.
HOT = 4000
HEADERS = "key long, content long, k_id long, at long"
CANDIDATES = "whole boolean, key long, k_id long, at long"


def document_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """k_id: the id (null: before all others). k_part: 24 bits of a hash of the text, for rows that share an id."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("k_id"), F.pmod(F.xxhash64(text), F.lit(1 << 24)).cast("long").alias("k_part")]


#: A bit beside the number of windows: the segment may hold a window twice.
TWICE = 0x80


def packed(start: np.ndarray, n: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Start of a segment, number of its windows with TWICE, and k_part in one long, which sorts by start."""
    return (start.astype(np.int64) << 32) | (n.astype(np.int64) << 24) | part.astype(np.int64)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, (at >> 24) & 0x7F, at & 0xFFFFFF


def segments(h: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start within the row, number of windows (with TWICE), key and content hash of every segment. h: a hash per symbol
    of many rows; bounds: where rows begin, and the end."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams = rolled(h, gram)
    lowest = sliding_min(grams, window - gram + 1)
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(lowest)]
    valid = np.arange(len(lowest)) + window <= bounds[row + 1]
    i = np.flatnonzero(valid)
    if not len(i):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.ones(len(i), bool)
    new[1:] = (lowest[i[1:]] != lowest[i[:-1]]) | (row[i[1:]] != row[i[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i)))
    since = np.arange(len(i)) - np.repeat(first, length)
    first = np.flatnonzero(since % MAX_RUN == 0)
    n = np.diff(np.append(first, len(i)))
    start = i[first]
    whole = rolled(h, window)
    content = mix(whole[start] * np.uint64(3) + whole[start + n - 1] * np.uint64(5) + n.astype(np.uint64))
    for j in range(window, MAX_RUN - 1, window):  # windows between, so that every symbol is in one
        content = mix(content * np.uint64(3) + whole[start + np.minimum(j, n - 1)])
    # a window can only come again inside its segment if the gram that gives the key does
    reach = n + window - gram
    ends = np.cumsum(reach)
    at = np.arange(ends[-1]) + np.repeat(start - (ends - reach), reach)
    times = np.add.reduceat(grams[at] == np.repeat(lowest[start], reach), ends - reach, dtype=np.int32)
    return row[start], start - bounds[row[start]], n | np.where(times > 1, TWICE, 0), lowest[start], content


#: Marks a header whose segment is known to recur as a whole; its key only deals it out.
KNOWN = -(2**63)


def headers_batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], both: bool) -> pa.RecordBatch:
    """The headers (key, content, k_id, at) of a batch of documents. Segments that recur within the batch are settled here: the
    first goes on, the others (and the first, if `both`) are marked KNOWN and dealt out by their place, so a passage that very
    many documents share doesn't pile up on one key."""
    key, content, k_id, at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
    key, content = signed(key), signed(content)
    order = np.lexsort((at, k_id, content, key))
    key, content, k_id, at = key[order], content[order], k_id[order], at[order]
    same = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    once = np.concatenate(([True], ~(same & (k_id[1:] == k_id[:-1]) & (at[1:] == at[:-1])))) if len(key) else np.zeros(0, bool)
    key, content, k_id, at = key[once], content[once], k_id[once], at[once]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
    known = again.copy()
    if both:
        known[:-1] |= again[1:]
    place = signed(mix(k_id[known].view(np.uint64) ^ mix(at[known].view(np.uint64))))
    columns = [np.concatenate(x) for x in ((key[~again], place), (content[~again], np.zeros(len(place), np.int64)), (k_id[~again], k_id[known]), (at[~again], at[known] | KNOWN))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "content", "k_id", "at"])


def _judge(both: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks over headers in the order of key, content, k_id, at. Emits every segment whose content stands elsewhere
    (`both`) or earlier as whole, and the first segment of every content whose key has several contents as a candidate."""
    names = ("key", "content", "k_id", "at")

    def out(rows: list[np.ndarray], pick: np.ndarray, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(pick.sum()), whole)), *[pa.array(rows[j][pick]) for j in (0, 2, 3)]], ["whole", "key", "k_id", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_again = None, False  # the last row, not emitted yet, and whether it equals the one before
        first, first_many = None, False  # the first row of the last content, not judged yet, and whether its key is known to have more
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            known = new[3] < 0
            if known.any():
                yield out([*new[:3], new[3] & ~KNOWN], known, True)
                new = [x[~known] for x in new]
                if known.all():
                    continue
            rows = new if last is None else [np.concatenate((x, y)) for x, y in zip(last, new, strict=True)]
            once = np.ones(len(rows[0]), bool)  # a repeated row of the documents is no other place
            once[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)
            rows = [x[once] for x in rows]
            again = np.zeros(len(rows[0]), bool)
            again[1:] = (rows[0][1:] == rows[0][:-1]) & (rows[1][1:] == rows[1][:-1])
            again[0] = last_again if last is not None else False
            whole = again.copy()
            if both:
                whole[:-1] |= again[1:]
            whole[-1] = False
            yield out(rows, whole, True)
            starts = np.flatnonzero(~again)
            starts = starts[starts > 0] if last is not None else starts
            heads = [x[starts] for x in rows] if first is None else [np.concatenate((f, x[starts])) for f, x in zip(first, rows, strict=True)]
            many = np.zeros(len(heads[0]), bool)
            if len(many):
                same = heads[0][1:] == heads[0][:-1]
                many[1:] |= same
                many[:-1] |= same
                many[0] |= first_many and first is not None
                many |= (heads[3] & (TWICE << 24)) != 0
                pick = many.copy()
                pick[-1] = False
                yield out(heads, pick, False)
                first, first_many = [x[-1:] for x in heads], bool(many[-1])
            last, last_again = [x[-1:] for x in rows], bool(again[-1])
        if last is not None:
            if last_again:
                yield out(last, np.ones(1, bool), True)
            if first_many:
                yield out(first, np.ones(1, bool), False)

    return run


def judged(headers: DataFrame, both: bool) -> DataFrame:
    """Whole segments and candidates of the headers. One key goes to one task, which streams over its rows: a document has
    many segments, so even a passage that every document holds is a small part of all headers."""
    ordered = headers.repartition("key").sortWithinPartitions("key", "content", "k_id", "at")
    return ordered.mapInArrow(_judge(both), CANDIDATES)


def by_document(candidates: DataFrame) -> DataFrame:
    """The candidates of every document, with a mark on those of hot keys."""
    own = candidates.filter("not whole")
    hot = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.lit(True).alias("hot"))
    marked = own.join(hot, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    part = F.col("at").bitwiseAND(F.lit(0xFFFFFF))
    return marked.groupBy("k_id", part.alias("k_part")).agg(F.collect_list(F.struct("at", "key", "hot")).alias("found"))


def stretches(candidates: DataFrame, extra: int) -> DataFrame:
    """What whole segments cover: k_id, k_part, lo, hi. extra: symbols of a window after its first."""
    at = F.col("at")
    lo, n = F.shiftright(at, 32), F.shiftright(at, 24).bitwiseAND(F.lit(0x7F))
    return candidates.filter("whole").select("k_id", at.bitwiseAND(F.lit(0xFFFFFF)).alias("k_part"), lo.alias("lo"), (lo + n + extra).alias("hi"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the stretches cover; touching stretches are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > reach[:-1]))
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of true values."""
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
