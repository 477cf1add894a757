"""Suffix-array dedup of repeated byte strings.

Every window of 100 bytes that stands twice lies in a candidate stretch (see `passages`). Stretches are dealt out by content,
so equal windows meet in one shard, and every shard orders the suffixes of its stretches by the difference-cover algorithm.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import blocks, flat, mix, rolled, signed, stored
from leakscope.llm.passages import HEADERS, by_document, document_key, headers_batch, judged, merged, packed, runs, segments, stretches, unpacked

WINDOW, GRAM = 100, 40
#: Bytes of stretches whose suffixes are ordered at once; a key's stretches stay together.
SHARD_BYTES = 1 << 20
#: Stretches of a hot key are cut into pieces of so many windows, dealt out by the bytes that all of these share.
PIECE = 4
STRETCHES = "shard long, bytes binary, k_id long, k_part long, lo long"
COVERED = "k_id long, k_part long, lo long, hi long"


# ---------------------------------------------------------------- suffix order

def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of non-negative integers, by the difference cover {1, 2} modulo 3: sort the triples at
    sampled places, recurse on their names, sort the other suffixes by their first symbol and the rank behind it, merge."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(text[i:])), np.int64)
    base = int(text.max()) + 2
    t = np.concatenate((text.astype(np.int64) + 1, np.zeros(3, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a place behind the end separates the two classes
    sample = np.concatenate((one, two))
    triple = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    order = np.argsort(name, kind="stable") if len(names) == len(sample) else suffix_array(name)
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    width = len(rank) + 1
    key0 = t[zero] * width + rank[zero + 1]
    by = np.argsort(key0, kind="stable")
    zero, key0 = zero[by], key0[by]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[one] * width + rank[one + 1], key0)
    pair = lambda p: (t[p] * base + t[p + 1]) * width + rank[p + 2]
    before += np.searchsorted(pair(two), pair(zero))
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zero))
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sample
    return out


def repeated(contents: list[bytes], order: np.ndarray, window: int) -> list[np.ndarray]:
    """For every content the flags of its windows that also start earlier. order: lo and document rank of each content's
    first window, as rows that sort like (document, place)."""
    size = np.array([len(c) for c in contents])
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.empty(int((size + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(contents), np.uint8)
    text[~inside] = 256 + np.arange(len(contents))  # ends differ, so no match goes beyond one
    n = size - window + 1
    owner = np.repeat(np.arange(len(contents)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = begin[owner] + offset
    is_window = np.full(len(text), -1)
    is_window[place] = np.arange(len(place))
    sa = is_window[suffix_array(text)]
    sa = sa[sa >= 0]  # windows in the order of their suffixes
    same = np.ones(len(sa) - 1, bool)
    for k in range(0, window, 20):  # adjacent prefixes
        at = np.flatnonzero(same)
        for j in range(k, min(k + 20, window)):
            same[at] &= text[place[sa[at]] + j] == text[place[sa[at + 1]] + j]
    group = np.concatenate(([0], np.cumsum(~same)))
    rank = np.empty(len(place), np.int64)
    rank[np.lexsort((order[owner, 1] + offset, order[owner, 0]))] = np.arange(len(place))
    first = np.full(group[-1] + 1, len(place))
    np.minimum.at(first, group, rank[sa])
    later = np.empty(len(place), bool)
    later[sa] = rank[sa] != first[group]
    return np.split(later, np.cumsum(n)[:-1])


# ---------------------------------------------------------------- stages

def _headers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_id, part = (batch.column(c).to_numpy() for c in ("k_id", "k_part"))
            buf, off = flat(batch.column("text"))
            parts = []
            for lo, hi in blocks(off):
                row, start, n, key, content = segments(buf[off[lo] : off[hi]].astype(np.uint64), off[lo : hi + 1] - off[lo], window, gram)
                parts.append((key, content, k_id[lo + row], packed(start, n, part[lo + row])))
            yield headers_batch(parts, both=False)

    return run


def _pieces(raw: bytes, key: int, window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """Shard, begin and number of windows of the pieces of a hot stretch. Windows are cut by their distance to the gram that
    gives the key, so equal windows fall into pieces with the same shared bytes."""
    h = rolled(np.frombuffer(raw, np.uint8).astype(np.uint64), gram)
    n = len(raw) - window + 1
    anchors = np.flatnonzero(signed(h) == key)
    start = np.arange(n)
    anchor = anchors[np.searchsorted(anchors, start + window - gram, side="right") - 1]
    piece = (anchor - start) // PIECE
    cut = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (anchor[1:] != anchor[:-1]))))
    for a, b in zip(cut, np.append(cut[1:], n), strict=True):
        core = int(anchor[a] - piece[a] * PIECE)  # the last window that the piece can hold starts here
        shard = hashlib.blake2b(raw[max(core, 0) : core - PIECE + 1 + window], digest_size=8).digest()
        yield int.from_bytes(shard, "little", signed=True), int(a), int(b - a)


def _cut(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text"), batch.column("found")
            out: dict[str, list] = {"shard": [], "bytes": [], "k_id": [], "k_part": [], "lo": []}
            for i, (k_id, part) in enumerate(zip(batch.column("k_id").to_pylist(), batch.column("k_part").to_pylist(), strict=True)):
                raw = texts[i].as_py().encode()
                f = found[i].values
                start, n, _ = unpacked(f.field("at").to_numpy())
                for s, m, key, hot in zip(start.tolist(), n.tolist(), f.field("key").to_pylist(), f.field("hot").to_pylist(), strict=True):
                    stretch = raw[s : s + m + window - 1]
                    for shard, a, b in _pieces(stretch, key, window, gram) if hot else ((key, 0, m),):
                        for name, x in zip(out, (shard, stretch[a : a + b + window - 1], k_id, part, s + a), strict=True):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("bytes", pa.binary()), ("k_id", pa.int64()), ("k_part", pa.int64()), ("lo", pa.int64())]))

    return run


def _ordered(window: int):
    """Takes stretches in the order of shard, bytes, k_id, lo. A stretch with the bytes of the one before is covered as a
    whole; the different ones of a few shards are put in suffix order together."""
    def flush(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        if held:
            flags = repeated([h[0] for h in held], np.array([[h[1], h[3]] for h in held]), window)
            for (_, k_id, part, lo), f in zip(held, flags, strict=True):
                rows += [(k_id, part, lo + int(a), lo + int(b) + window - 1) for a, b in zip(*runs(f), strict=True)]
        return _covered(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard, last, place, whole = [], 0, None, None, None, []
        for batch in batches:
            for s, raw, k_id, part, lo in zip(*(batch.column(c).to_pylist() for c in ("shard", "bytes", "k_id", "k_part", "lo")), strict=True):
                if s == shard and raw == last:
                    if place != (k_id, part, lo):  # else a repeated row of the documents
                        whole.append((k_id, part, lo, lo + len(raw)))
                    place = k_id, part, lo
                    continue
                if s != shard and size > SHARD_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append((raw, k_id, part, lo))
                shard, last, place, size = s, raw, (k_id, part, lo), size + len(raw)
            yield _covered(whole)
            whole = []
        yield flush(held)

    return run


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k_id", "k_part", "lo", "hi"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, gone = batch.column("text"), batch.column("gone")
        out = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for i in range(batch.num_rows):
            raw = (texts[i].as_py() or "").encode()
            lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if gone[i].is_valid:
                lo, hi = merged(*(gone[i].values.field(c).to_numpy() for c in ("lo", "hi")))
            kept, at = hashlib.sha256(), 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            for name, x in zip(list(out)[1:], (len(raw), int((hi - lo).sum()), len(lo), kept.hexdigest()), strict=True):
                out[name].append(x)
        yield pa.RecordBatch.from_pydict(out)


def repeated_stretches(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k_id, k_part, lo, hi (bytes): stretches that cover exactly the windows which also start earlier; they may overlap."""
    docs = documents.select(*document_key(), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(judged(docs.mapInArrow(_headers(window, gram), HEADERS), both=False), "segments")  # read three times
    keyed = by_document(found).join(docs, ["k_id", "k_part"])
    cut = keyed.select("k_id", "k_part", "text", "found").mapInArrow(_cut(window, gram), STRETCHES)
    ordered = cut.repartition("shard").sortWithinPartitions("shard", "bytes", "k_id", "lo").mapInArrow(_ordered(window), COVERED)
    return stretches(found, window - 1).unionAll(ordered)


def suffix_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256. A byte goes if a string of `window` bytes over
    it also starts earlier (in a document with a smaller id, or earlier in the same).

    Null texts are empty. Texts shorter than a window lose nothing. A null id comes before all others. Rows that share id and
    text count once as a source and each get their row; rows that share an id alone are ordered by the place in the text.
    """
    gone = repeated_stretches(documents, window, gram).groupBy("k_id", "k_part").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(), F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.join(gone, ["k_id", "k_part"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
