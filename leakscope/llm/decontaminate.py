"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""
from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import fresh

WINDOW = 10
#: Items are gathered into one automaton; beyond so many bytes of text the caller has to split them.
MAX_BENCHMARK_BYTES = 64 << 20

#: Bytes that are no part of a word become a blank, A-Z become a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
SCHEMA = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>"


def normalised(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lowered, runs of 0-9, a-z and everything beyond ASCII, in UTF-8."""
    return text.encode().translate(_NORMAL).split() if text else []


def item_windows(text: str | None, window: int) -> list[str]:
    """Every `window` consecutive words of an item, or all its words if there are fewer; none without words."""
    words = normalised(text)
    return [b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))] if words else []


class Scanner:
    """The items' windows, and an automaton over them that every task compiles once."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        of = defaultdict(set)
        for item_id, text in items:
            for w in item_windows(text, window):
                of[w].add(item_id)
        self.patterns = [(f" {w} ", w.count(" ") + 1, tuple(sorted(ids))) for w, ids in of.items()]
        self._automaton = None

    def __getstate__(self):
        return {"patterns": self.patterns, "_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None and self.patterns:
            a = ahocorasick.Automaton()
            for i, (pattern, _, _) in enumerate(self.patterns):
                a.add_word(pattern, i)
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[dict]]:
        """Number of words, number of hit words, items found, and the hit stretches as character offsets of the text."""
        words = normalised(text)
        if not words or not self.patterns:
            return len(words), 0, [], []
        joined = f" {b' '.join(words).decode()} "
        found = list(self.automaton.iter(joined))
        if not found:
            return len(words), 0, [], []
        ends = np.cumsum([len(w.decode()) + 1 for w in words])  # where the blank after each word stands
        last = np.searchsorted(ends, [end for end, _ in found])
        hit, ids = np.zeros(len(words), bool), set()
        for end, (_, i) in zip(last, found, strict=True):
            _, n, items = self.patterns[i]
            hit[end - n + 1 : end + 1] = True
            ids.update(items)
        return len(words), int(hit.sum()), sorted(ids), _spans(text, hit)


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Maximal runs of hit words as character offsets of the original text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(_NORMAL, np.uint8)[raw] != 32
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    runs = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [
        {"start": int(chars[start[a]]), "end": int(chars[end[b - 1]])}
        for a, b in zip(np.flatnonzero(runs == 1), np.flatnonzero(runs == -1), strict=True)
    ]


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[tuple[str, str]]:
    """The items, gathered to the driver after their size has been checked against MAX_BENCHMARK_BYTES. A null item_id
    is named by the empty string; rows that share an item_id are one item."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 24), F.lit(0))).first()[0]
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {size} bytes, over {MAX_BENCHMARK_BYTES}; scan it in several parts")
    return [(r.i, r.t) for r in rows.collect()]


def contamination(text: Column, items: list[tuple[str, str]], window: int = WINDOW) -> Column:
    """A struct of n_words, n_hit, item_ids and spans for every text."""
    scanner = Scanner(items, window)

    @F.arrow_udf(SCHEMA)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [scanner.scan(t.as_py()) for t in texts]
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())),
                          ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        return pa.array([dict(zip(("n_words", "n_hit", "item_ids", "spans"), r, strict=True)) for r in rows], kind)

    return scan(text)


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The documents in which no window of a benchmark item occurs, with all their columns.

    A null or empty text is clean. Without items every document stays.
    """
    name = fresh(documents, "found")
    found = documents.withColumn(name, contamination(F.col(text), benchmark_items(benchmark), window))
    return found.filter(F.col(name)["n_hit"] == 0).drop(name)


def contamination_report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256,
    contaminated, and the hit stretches of the original text. Documents are read once, in one narrow stage.

    Null and empty texts have no words and no hits. Repeated rows each get their row. Extra columns are not looked at.
    """
    found = contamination(F.col("text"), benchmark_items(benchmark), window)
    rows = documents.select("doc_id", found.alias("f"))
    return rows.select(
        "doc_id", "f.n_words", "f.n_hit", F.size("f.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("f.item_ids", ","), 256).alias("items_sha256"), (F.col("f.n_hit") > 0).alias("contaminated"),
        F.col("f.spans").alias("spans"),
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
