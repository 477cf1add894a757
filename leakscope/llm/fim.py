"""Fill-in-middle transformation over seekable compressed texts.

A text is kept as independent zstandard frames with the number of code points up to the end of each. A cut needs only the frame
it falls into; frames between cuts are taken over as they are, and digests stream over the frames one after another.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a frame. Only single frames are decompressed at a time.
FRAME_UNITS = 1 << 15
PLAIN_PERCENT, SPM_PERCENT = 10, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_FRAMES = pa.list_(pa.binary())


class Seekable:
    """Frames with the position at the end of each; positions count what `size` makes of a stretch of bytes."""

    def __init__(self, frames: list[bytes], ends: list[int], offset: Callable[[bytes, int], int]):
        self.frames, self.ends, self.offset = frames, ends, offset
        self._reader, self._last = zstandard.ZstdDecompressor(), (-1, b"")

    def raw(self, i: int) -> bytes:
        """One decompressed frame; the last one asked for is kept."""
        if self._last[0] != i:
            self._last = (i, self._reader.decompress(self.frames[i]))
        return self._last[1]

    def stretch(self, lo: int, hi: int) -> Iterator[tuple[bool, bytes]]:
        """The positions from lo up to hi: (True, a whole frame as stored) or (False, a part of a decompressed frame)."""
        before = 0
        for i, end in enumerate(self.ends):
            if before >= lo and end <= hi:
                yield True, self.frames[i]
            elif end > lo and before < hi:
                raw = self.raw(i)
                yield False, raw[self.offset(raw, max(lo - before, 0)) : self.offset(raw, hi - before) if hi < end else len(raw)]
            before = end


def _code_points(raw: bytes, n: int) -> int:
    """The byte offset of the n-th code point."""
    return len(raw.decode()[:n].encode())


def by_code_points(frames: list[bytes], ends: list[int]) -> Seekable:
    return Seekable(frames, ends, _code_points)


def by_bytes(frames: list[bytes]) -> Seekable:
    """Positions are bytes; sizes are read from the frames' headers."""
    ends, total = [], 0
    for frame in frames:
        total += zstandard.frame_content_size(frame)
        ends.append(total)
    return Seekable(frames, ends, lambda raw, n: n)


class Joined:
    """A new list of frames out of whole frames and loose bytes; loose bytes that follow each other share a frame."""

    def __init__(self, writer: zstandard.ZstdCompressor):
        self.frames: list[bytes] = []
        self._writer, self._loose = writer, []

    def add(self, raw: bytes) -> None:
        if raw:
            self._loose.append(raw)

    def stretch(self, pieces: Iterator[tuple[bool, bytes]]) -> None:
        for whole, data in pieces:
            if whole:
                self._close()
                self.frames.append(data)
            else:
                self.add(data)

    def _close(self) -> None:
        if self._loose:
            self.frames.append(self._writer.compress(b"".join(self._loose)))
            self._loose = []

    def done(self) -> list[bytes]:
        self._close()
        return self.frames


def markers(seekable: Seekable) -> dict[bytes, int]:
    """The first place of each marker in bytes, also where it lies across frames."""
    found, tail, before = {}, b"", 0
    for i in range(len(seekable.frames)):
        raw = tail + seekable.raw(i)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if mark not in found and (at := raw.find(mark)) >= 0:
                found[mark] = before - len(tail) + at
        before += len(raw) - len(tail)
        tail = raw[-2:]
    return found


def arranged(text: Seekable, form: str, lo: int, hi: int, writer: zstandard.ZstdCompressor) -> list[bytes]:
    """The frames of the output: the text cut at lo and hi, its parts in the order of the form behind their markers."""
    n = text.ends[-1] if text.ends else 0
    if form == "plain":
        return text.frames
    prefix, suffix = (PREFIX, (0, lo)), (SUFFIX, (hi, n))
    out = Joined(writer)
    for mark, place in [*((prefix, suffix) if form == "psm" else (suffix, prefix)), (MIDDLE, (lo, hi))]:
        out.add(mark)
        out.stretch(text.stretch(*place))
    return out.done()


def rebuilt(output: Seekable, form: str, writer: zstandard.ZstdCompressor) -> list[bytes]:
    """The frames of the text that an output of this form was made of."""
    if form == "plain":
        return output.frames
    at, n, out = markers(output), output.ends[-1], Joined(writer)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if set(at) != {PREFIX, SUFFIX, MIDDLE} or not at[first] == 0 < at[second] < at[MIDDLE]:
        raise ValueError(f"not an output of form {form}")
    end = {first: at[second], second: at[MIDDLE], MIDDLE: n}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        out.stretch(output.stretch(at[mark] + len(mark), end[mark]))
    return out.done()


# ---------------------------------------------------------------- columns

def framed(text: Column, units: int = FRAME_UNITS) -> Column:
    """A struct of `ends` (code points up to the end of each frame) and `frames`. Null and empty texts have no frames."""

    @F.arrow_udf("ends array<long>, frames array<binary>")
    def frames(texts: pa.Array) -> pa.Array:
        writer, ends, data = zstandard.ZstdCompressor(), [], []
        for value in texts:
            s = value.as_py() or ""
            ends.append([min(i + units, len(s)) for i in range(0, len(s), units)])
            data.append([writer.compress(s[i : i + units].encode()) for i in range(0, len(s), units)])
        return pa.StructArray.from_arrays([pa.array(ends, pa.list_(pa.int64())), pa.array(data, _FRAMES)], ["ends", "frames"])

    return frames(text)


def digest(frames: Column) -> Column:
    """The lowercase hex sha256 of what the frames hold."""

    @F.arrow_udf("string")
    def sha256(rows: pa.Array) -> pa.Array:
        reader, out = zstandard.ZstdDecompressor(), []
        for row in rows:
            h = hashlib.sha256()
            for frame in row.as_py():
                h.update(reader.decompress(frame))
            out.append(h.hexdigest())
        return pa.array(out, pa.string())

    return sha256(frames)


def unframed(frames: Column) -> Column:
    """The text that the frames hold."""

    @F.arrow_udf("string")
    def text(rows: pa.Array) -> pa.Array:
        reader = zstandard.ZstdDecompressor()
        return pa.array([b"".join(map(reader.decompress, row.as_py())).decode() for row in rows], pa.string())

    return text(frames)


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of `seed:` and the id; a null id counts as no digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


# ---------------------------------------------------------------- frames of documents

def frame_store(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", units: int = FRAME_UNITS) -> DataFrame:
    """One row per document: doc_id, n (code points), ends, frames. To be written as a table and read by the others."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), framed(F.col(text), units).alias("f"))
    n = F.when(F.size("f.ends") > 0, F.element_at("f.ends", -1)).otherwise(0).cast("long")
    return rows.select("doc_id", n.alias("n"), "f.ends", "f.frames")


def fill_in_middle(store: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of the store: doc_id, n, form, prefix_chars, middle_chars (code points, null if plain), and `output`,
    the transformed text as frames (`unframed` makes it a string).

    Cuts and form are drawn from seed and id alone, so a repeated run gives the same rows and rows that share an id and a length
    are cut alike. Empty texts, texts that hold a marker, and plain_percent of the others stay plain; spm_percent of the rest put
    the suffix first. One narrow stage; no text is decompressed whole.
    """
    h = draws(F.col("doc_id"), seed)
    cut = [F.pmod(x, F.col("n") + 1) for x in h[:2]]
    wish = F.when((F.col("n") == 0) | (h[2] % 100 >= 100 - plain_percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")

    @F.arrow_udf("form string, output array<binary>")
    def arrange(frames: pa.Array, ends: pa.Array, wishes: pa.Array, los: pa.Array, his: pa.Array) -> pa.Array:
        writer, forms, outputs = zstandard.ZstdCompressor(), [], []
        for data, end, form, lo, hi in zip(frames, ends, wishes, los, his, strict=True):
            text, form = by_code_points(data.as_py(), end.as_py()), form.as_py()
            if form != "plain" and markers(text):
                form = "plain"
            forms.append(form)
            outputs.append(arranged(text, form, lo.as_py(), hi.as_py(), writer))
        return pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(outputs, _FRAMES)], ["form", "output"])

    placed = store.select("doc_id", "n", "ends", "frames", F.least(*cut).alias("lo"), F.greatest(*cut).alias("hi"), wish.alias("wish"))
    made = placed.withColumn("o", arrange("frames", "ends", "wish", "lo", "hi"))
    cut_up = F.col("o.form") != "plain"
    return made.select(
        "doc_id", "n", F.col("o.form").alias("form"), F.when(cut_up, F.col("lo")).alias("prefix_chars"),
        F.when(cut_up, F.col("hi") - F.col("lo")).alias("middle_chars"), F.col("o.output").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The original text as frames, rebuilt from an output and its form alone. Another form than the output's is an error."""

    @F.arrow_udf("array<binary>")
    def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        writer = zstandard.ZstdCompressor()
        return pa.array([rebuilt(by_bytes(o.as_py()), f.as_py(), writer) for o, f in zip(outputs, forms, strict=True)], _FRAMES)

    return restore(output, form)
