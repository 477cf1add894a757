"""Cost-balanced packing of tokenised documents into sequences of a fixed length.

Attention runs within a document, so a piece of n tokens costs n * linear + n * n. Within a block of documents, descending by length,
each goes to the cheapest sequence that still has room for it; what fits nowhere whole is cut. All sequences but one are filled
to the end. Blocks are packed where the documents are read: no token crosses a shuffle but the rest of each task, which is
shorter than a sequence.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.common import stored

CAPACITY = 4096
END = 2
#: The cost of a token beside attention, in units of what one earlier token costs it: six times the width of a model.
LINEAR = 6 * 1024
#: Tokens that are packed together, by one task at a time.
BLOCK_TOKENS = 1 << 21
#: Rests of tasks that meet in one group.
GROUP_TOKENS = 1 << 20
_LATER = 1 << 62


# ---------------------------------------------------------------- tokens

class Words:
    """Ids by word, asked from the tokenizer once. For tokenizers that lower letters, split at white space and drop it, a text's ids
    are those of its words in a row; only where a text may hold special tokens its letters stay as they are. A table that has grown
    beyond `limit` bytes starts anew."""

    ENTRY = 180  # bytes that an entry takes beside its word and ids
    MARK = "\x01"  # between words that are looked up together; words that hold it are looked up alone

    def __init__(self, path: str, limit: int = 300 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._tokenizer, self._limit = Tokenizer.from_file(path), limit
        mark = self._encoded(self.MARK)
        self._mark = int(mark[0]) if len(mark) == 1 else None
        self._empty()

    def __len__(self) -> int:
        return len(self._slot)

    def _empty(self) -> None:
        self._slot: dict[str, int] = {}
        self._start, self._flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self._held = 0

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, new: list[str]) -> None:
        alone = [w for w in new if self._mark is None or self.MARK in w or "<|" in w]
        apart = set(alone)
        together = [w for w in new if w not in apart]
        found = [self._encoded(w) for w in alone]
        sizes = [len(ids) for ids in found]
        if together:
            ids = self._encoded(f" {self.MARK} ".join(together))
            marks = np.flatnonzero(ids == self._mark)
            if len(marks) != len(together) - 1:
                raise ValueError("the tokenizer doesn't keep words apart")
            ends = np.append(marks, len(ids)) - np.arange(len(together))
            found.append(np.delete(ids, marks))
            sizes += np.diff(ends, prepend=0).tolist()
        self._slot.update(zip([*alone, *together], range(len(self._slot), len(self._slot) + len(new)), strict=True))
        self._start = np.concatenate([self._start, self._start[-1] + np.cumsum(np.array(sizes, np.int64))])
        self._flat = np.concatenate([self._flat, *found])
        self._held += sum(map(len, new)) + self.ENTRY * len(new) + 4 * sum(sizes)

    def _together(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, all words of the array looked up at once."""
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self._held > self._limit:
            self._empty()
        if new := [w for w in distinct if w not in self._slot]:
            self._learn(new)
        slots = np.fromiter(map(self._slot.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        size = self._start[slots + 1] - self._start[slots]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(before[-1]) + np.repeat(self._start[slots] - before[:-1], size)
        return np.split(self._flat[at], before[words.offsets.to_numpy()[1:-1] - words.offsets[0].as_py()])

    def ids(self, texts: pa.Array, stretch: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each whole text; a null is empty. Short texts are looked up together, long ones a stretch at a time."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + stretch, side="right")) - 1)
            if size[hi] - size[lo] <= stretch:
                yield from self._together(texts.slice(lo, hi - lo))
            else:
                parts = _stretches(texts[lo].as_py().encode(), stretch)
                yield np.concatenate([self._together(pa.array([part.decode()], pa.large_string()))[0] for part in parts])
            lo = hi


def worker_words(path: str) -> Words:
    """The table of this Python worker: a task goes on with the words that earlier tasks have looked up."""
    import tokenizers

    tables = tokenizers.__dict__.setdefault("_tables_of_words", {})
    if path not in tables:
        tables[path] = Words(path)
    return tables[path]


def _stretches(raw: bytes, least: int) -> Iterator[bytes]:
    """The bytes in pieces of at least so many, cut at white space."""
    at = 0
    while at < len(raw):
        end = at + least
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        yield raw[at:end]
        at = end


# ---------------------------------------------------------------- packing

class Piece(NamedTuple):
    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


def set_aside(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces without n tokens, and these n tokens, taken from the ends of the longest, so that they are few pieces. pieces: descending."""
    kept, rest = [], []
    for piece in pieces:
        if n == 0:
            kept.append(piece)
        elif piece.size <= n:
            rest.append(piece)
            n -= piece.size
        else:
            head, tail = piece.cut(piece.size - n)
            kept.append(head)
            rest.append(tail)
            n = 0
    return kept, rest


def descending(pieces: Iterable[Piece]) -> list[Piece]:
    return sorted(pieces, key=lambda p: p.size, reverse=True)  # stable: ties stay as they came


def balanced(pieces: list[Piece], room: list[int], linear: int) -> Iterator[tuple[Piece, int, int]]:
    """(piece, sequence, offset) for all tokens; `room` holds the tokens of each sequence and is as much as the pieces need.

    The longest come first; each goes to the cheapest sequence with room for all of it, else as much as fits to the cheapest
    with any room, and the remainder is placed in the same way. Ties go to the first sequence.
    """
    free, cost = np.array(room, np.int64), np.zeros(len(room), np.int64)
    most = np.iinfo(np.int64).max
    for piece in descending(pieces):
        while piece.size:
            fits = free >= piece.size
            s = int(np.where(fits if fits.any() else free > 0, cost, most).argmin())
            head, piece = piece.cut(min(piece.size, int(free[s])))
            yield head, s, room[s] - int(free[s])
            free[s] -= head.size
            cost[s] += head.size * (linear + head.size)


def packed(blocks: Iterable[list[Piece]], capacity: int, linear: int, last: bool) -> Iterator[list[tuple[Piece, int | None, int | None]]]:
    """For each block its pieces with sequence (counted on over the blocks) and offset. What doesn't fill a sequence goes with the
    next block; the rest of the last one comes without a place, or in a shorter sequence if it is the `last` round."""
    rest, first = [], 0
    for block in blocks:
        pieces = descending([*rest, *block])
        full, over = divmod(sum(p.size for p in pieces), capacity)
        pieces, rest = set_aside(pieces, over)
        yield [(p, first + s, at) for p, s, at in balanced(pieces, [capacity] * full, linear)]
        first += full
    if rest and last:
        yield [(p, first, at) for p, _, at in balanced(rest, [sum(p.size for p in rest)], linear)]
    elif rest:
        yield [(p, None, None) for p in rest]


def _in_blocks(pieces: Iterable[Piece], tokens: int) -> Iterator[list[Piece]]:
    block, n = [], 0
    for piece in pieces:
        block.append(piece)
        n += piece.size
        if n >= tokens:
            yield block
            block, n = [], 0
    if block:
        yield block


def _batch(rows: list[tuple[Piece, int | None, int | None]], head: int, task: int, kind: pa.DataType) -> pa.RecordBatch:
    long = pa.int64()
    columns = {
        "doc_id": pa.array([p.doc_id for p, _, _ in rows], kind), "start": pa.array([p.start for p, _, _ in rows], long),
        "length": pa.array([p.size for p, _, _ in rows], long), "ids": pa.array([p.ids for p, _, _ in rows], pa.binary()),
        "doc_tokens": pa.array([p.doc_tokens for p, _, _ in rows], long),
        "sequence_id": pa.array([None if s is None else head + s for _, s, _ in rows], long),
        "offset": pa.array([at for _, _, at in rows], long), "task": pa.array([task] * len(rows), long),
    }
    return pa.RecordBatch.from_pydict(columns)


def _packer(tokenizer: str, end: int, capacity: int, linear: int, block_tokens: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, kind = worker_words(tokenizer), TaskContext.get().partitionId(), None

        def documents() -> Iterator[Piece]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                for doc_id, ids in zip(batch.column(0), words.ids(batch.column(1)), strict=True):
                    yield Piece(doc_id.as_py(), 0, np.append(ids, np.uint32(end)).astype("<u4").tobytes(), len(ids) + 1)

        for rows in packed(_in_blocks(documents(), block_tokens), capacity, linear, last=False):
            for i in range(0, len(rows), 5000):
                yield _batch(rows[i : i + 5000], task << 32, task, kind)

    return pack


def _group_packer(capacity: int, linear: int) -> Callable:
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = [("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")]
        rows = table.sort_by(order).to_pylist()
        pieces = [Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]) for r in rows]
        out = [x for block in packed([pieces], capacity, linear, last=True) for x in block]
        return pa.Table.from_batches([_batch(out, _LATER + (key[0].as_py() << 32), 0, table.schema.field("doc_id").type)])

    return pack


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, linear: int = LINEAR,
                   doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """All tokens of all documents in sequences of `capacity` tokens: one row per piece with doc_id, start (the document's ids
    before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, and its offset there, gapless from 0.

    tokenizer: path of a tokenizers file, the same on every machine, of a kind that drops white space (a word's ids don't depend on
    its neighbours). Every document is closed by the id `end`. A null or empty text is that id alone. Repeated rows and ids are
    documents of their own; other columns are not looked at; an empty table has no sequences. A text of any length is packed whole.

    Each task packs what it reads, a block of about block_tokens (or one longer document) at a time. The rests of tasks are packed
    in groups of about group_tokens, so only one sequence per group is shorter than `capacity`. The pieces are written once to the
    shared folder between the two rounds. Which documents meet depends on how the input is dealt out.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, task long"
    first = stored(rows.mapInArrow(_packer(tokenizer, end, capacity, linear, block_tokens), schema), "pieces")
    rest = first.filter(F.col("sequence_id").isNull())
    groups = -(-(rest.agg(F.sum("length")).first()[0] or 0) // group_tokens) or 1
    later = rest.withColumn("group", F.col("task") % groups).groupBy("group").applyInArrow(_group_packer(capacity, linear), schema)
    return first.filter(F.col("sequence_id").isNotNull()).unionByName(later).drop("task")


def sequences(pieces: DataFrame, linear: int = LINEAR) -> DataFrame:
    """Every sequence with its tokens, pieces and cost."""
    cost: Column = F.col("length") * (F.col("length") + linear)
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(cost).alias("cost"))
