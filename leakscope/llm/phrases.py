"""Repeated-phrase dedup: recurring passages are confirmed, compiled to sharded Aho-Corasick automata, and every document is
streamed through the automaton of its shard to find all occurrences."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import SPACES, blocks, flat, rolled, stored, word_hashes, words
from leakscope.llm.passages import HEADERS, by_document, document_key, headers_batch, judged, merged, packed, runs, segments, stretches, unpacked

WINDOW, GRAM = 35, 8
#: Words of stretches whose windows are compared at once; a key's stretches stay together.
SHARD_WORDS = 1 << 19
#: Stretches of a hot key are cut into single windows, dealt out by their words.
STRETCHES = "shard long, words string, k_id long, k_part long, lo long"
COVERED = "k_id long, k_part long, lo long, hi long"
#: Bytes of text whose passages are compiled to one automaton.
AUTOMATON_BYTES = 16 << 20


def _headers(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_id, part = (batch.column(c).to_numpy() for c in ("k_id", "k_part"))
            buf, off = flat(batch.column("text"))
            parts = []
            for lo, hi in blocks(off):
                b = buf[off[lo] : off[hi]]
                start, end, at = words(b, off[lo : hi + 1] - off[lo], ~SPACES)
                row, first, n, key, content = segments(word_hashes(b, start, end), at, window, gram)
                parts.append((key, content, k_id[lo + row], packed(first, n, part[lo + row])))
            yield headers_batch(parts, both=True)

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text"), batch.column("found")
            out: dict[str, list] = {"shard": [], "words": [], "k_id": [], "k_part": [], "lo": []}
            for i, (k_id, part) in enumerate(zip(batch.column("k_id").to_pylist(), batch.column("k_part").to_pylist(), strict=True)):
                own = texts[i].as_py().encode().split()
                f = found[i].values
                start, n, _ = unpacked(f.field("at").to_numpy())
                for s, m, key, hot in zip(start.tolist(), n.tolist(), f.field("key").to_pylist(), f.field("hot").to_pylist(), strict=True):
                    for a, b in [(s + k, 1) for k in range(m)] if hot else [(s, m)]:
                        joined = b" ".join(own[a : a + b + window - 1])
                        shard = int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "little", signed=True) if hot else key
                        for name, x in zip(out, (shard, joined, k_id, part, a), strict=True):
                            out[name].append(x)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("words", pa.string()), ("k_id", pa.int64()), ("k_part", pa.int64()), ("lo", pa.int64())]))

    return run


def recurring(stretches_: list[bytes], window: int) -> list[np.ndarray]:
    """For every stretch the flags of its windows whose words stand elsewhere among the stretches."""
    names: dict[bytes, int] = {}
    split = [s.split() for s in stretches_]
    ids = np.array([names.setdefault(w, len(names)) for s in split for w in s], np.int64)
    size = np.array([len(s) for s in split])
    begin, n = np.cumsum(size) - size, size - window + 1
    place = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    h = rolled(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), window)[place]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    for j in range(window):  # equal hashes are confirmed word by word
        at = np.flatnonzero(same)
        same[at] = ids[place[order[at]] + j] == ids[place[order[at + 1]] + j]
    flags = np.zeros(len(place), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    return np.split(flags, np.cumsum(n)[:-1])


def _confirmed(window: int):
    """Takes stretches in the order of shard, words, k_id, lo. Equal ones are covered as a whole; the different ones of a few
    shards are compared together."""
    def flush(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        if held:
            for (_, k_id, part, lo), f in zip(held, recurring([h[0] for h in held], window), strict=True):
                rows += [(k_id, part, lo + int(a), lo + int(b) + window - 1) for a, b in zip(*runs(f), strict=True)]
        return _covered(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard, last, place, whole = [], 0, None, None, None, []
        for batch in batches:
            for s, text, k_id, part, lo in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "k_id", "k_part", "lo")), strict=True):
                raw = text.encode()
                n = raw.count(b" ") + 1
                if s == shard and raw == last:
                    if place != (k_id, part, lo):  # else a repeated row of the documents
                        first = held[-1]
                        whole += [(k_id, part, lo, lo + n), (*first[1:], first[3] + n)]
                    place = k_id, part, lo
                    continue
                if s != shard and size > SHARD_WORDS:
                    yield flush(held)
                    held, size = [], 0
                held.append((raw, k_id, part, lo))
                shard, last, place, size = s, raw, (k_id, part, lo), size + n
            yield _covered(whole)
            whole = []
        yield flush(held)

    return run


def _covered(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*set(rows), strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k_id", "k_part", "lo", "hi"])


def confirmed_passages(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k_id, k_part, lo, hi (words): passages in which every window recurs somewhere; they may overlap."""
    docs = documents.select(*document_key(), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(judged(docs.mapInArrow(_headers(window, gram), HEADERS), both=True), "segments")  # read three times
    keyed = by_document(found).join(docs, ["k_id", "k_part"])
    cut = keyed.select("k_id", "k_part", "text", "found").mapInArrow(_cut(window), STRETCHES)
    own = cut.repartition("shard").sortWithinPartitions("shard", "words", "k_id", "lo").mapInArrow(_confirmed(window), COVERED)
    return stretches(found, window - 1).unionAll(own)


#: An automaton has at most so many different words; there are 1,112,031 characters for them. Longer passages are cut to pieces.
AUTOMATON_WORDS, PIECE_WORDS = 1_000_000, 1 << 18


def pieces(passage: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    """The passage, or pieces of PIECE_WORDS that cover it. Every window of a piece recurs as well, so its other places count too."""
    last = len(passage) - PIECE_WORDS
    if last <= 0:
        return [passage]
    return [passage[i : i + PIECE_WORDS] for i in [*range(0, last, PIECE_WORDS), last]]


def automata(passages: set[tuple[bytes, ...]]) -> Iterator[PassageAutomaton]:
    """The passages in as many automata as their different words need, one at a time."""
    group: list[tuple[bytes, ...]] = []
    known: set[bytes] = set()
    for piece in (x for p in passages for x in pieces(p)):
        if group and len(known) + len(piece) > AUTOMATON_WORDS and len(known.union(piece)) > AUTOMATON_WORDS:
            yield PassageAutomaton(group)
            group, known = [], set()
        group.append(piece)
        known.update(piece)
    if group:
        yield PassageAutomaton(group)


class PassageAutomaton:
    """An automaton over words: every word of a passage is written as one character, all other words as a blank."""

    def __init__(self, passages: list[tuple[bytes, ...]]):
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for p in passages:
            for w in p:
                if w not in self.codes:
                    n = len(self.codes) + 33
                    self.codes[w] = chr(n if n < 0xD800 else n + 0x800)
            self.automaton.add_word(self.written(p), len(p))
        if passages:
            self.automaton.make_automaton()
        self.empty = not passages

    def written(self, own: Sequence[bytes]) -> str:
        return "".join(map(self.codes.get, own, [" "] * len(own)))

    def found(self, own: list[bytes]) -> np.ndarray:
        """Flags of the words that lie in any occurrence of a passage."""
        edges = np.zeros(len(own) + 1, np.int64)
        if not self.empty:
            for end, n in self.automaton.iter(self.written(own)):
                edges[end - n + 1] += 1
                edges[end + 1] -= 1
        return np.cumsum(edges[:-1]) > 0


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every few MB of documents are a shard: their confirmed passages become an automaton, then all of them pass it."""
    for batch in batches:
        texts, gone = batch.column("text"), batch.column("gone")
        _, off = flat(texts)
        for lo, hi in blocks(off, AUTOMATON_BYTES):
            split = [(t.as_py() or "").encode().split() for t in texts[lo:hi]]
            passages = set()
            for own, g in zip(split, gone[lo:hi], strict=True):
                if g.is_valid:
                    for a, b in zip(*merged(*(g.values.field(c).to_numpy() for c in ("lo", "hi"))), strict=True):
                        passages.add(tuple(own[a:b]))
            gone_ = [np.zeros(len(own), bool) for own in split]
            for automaton in automata(passages):
                for own, flags in zip(split, gone_, strict=True):
                    flags |= automaton.found(own)
            out = {"doc_id": batch.column("doc_id")[lo:hi], "n_words": [], "n_removed": [], "kept_sha256": []}
            for own, flags in zip(split, gone_, strict=True):
                kept = own if not flags.any() else [own[i] for i in np.flatnonzero(~flags)]
                for name, x in zip(list(out)[1:], (len(own), int(flags.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    out[name].append(x)
            yield pa.RecordBatch.from_pydict(out)


def phrase_dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256. A word goes if a window of `window` words over it stands
    anywhere else, in the same document or another.

    Null texts have no words. Texts shorter than a window lose nothing. Rows that share id and text are one document (each gets
    its row, and they are no repetition of each other); rows that share an id alone are different documents.
    """
    gone = confirmed_passages(documents, window, gram).groupBy("k_id", "k_part").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *document_key(), F.coalesce("text", F.lit("")).alias("text"))
    joined = docs.join(gone, ["k_id", "k_part"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(_streamed, "doc_id long, n_words long, n_removed long, kept_sha256 string")
