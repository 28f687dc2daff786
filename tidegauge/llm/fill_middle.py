"""Fill-in-middle forms of texts kept as seekable compressed frames."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import shared_path, text_of
from tidegauge.llm.encoding import slices

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
#: Code points of a frame.
UNITS = 1 << 16
FRAME_SCHEMA = "id string, special boolean, ends array<bigint>, frames array<binary>"


class Frames:
    """A text as independent zstandard frames. ``ends`` counts the code points up to each frame's end."""

    _packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends = frames, ends

    @classmethod
    def of(cls, pieces: Iterable[str], units: int = UNITS) -> Frames:
        """Of a text that comes in pieces; all frames but the last have ``units`` code points."""
        frames, sizes, held, count = [], [], [], 0
        for piece in pieces:
            at = 0
            while at < len(piece):
                held.append(piece[at : at + units - count])
                count, at = count + len(held[-1]), at + len(held[-1])
                if count == units:
                    frames.append(cls._packer.compress("".join(held).encode()))
                    sizes.append(units)
                    held, count = [], 0
        if count:
            frames.append(cls._packer.compress("".join(held).encode()))
            sizes.append(count)
        return cls(frames, list(accumulate(sizes)))

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def read(self, start: int, stop: int) -> Iterator[str]:
        """The code points from ``start`` to ``stop``, frame by frame; only frames that hold some are decompressed."""
        at = bisect_right(self.ends, start)
        while start < stop and at < len(self.frames):
            begin = self.ends[at - 1] if at else 0
            text = self._unpacker.decompress(self.frames[at]).decode()
            yield text[start - begin : stop - begin]
            start, at = self.ends[at], at + 1

    def find(self, mark: str, start: int) -> int:
        """Place of the first ``mark`` from ``start`` on, -1 if there is none; a mark may lie across frames."""
        tail, at = "", start
        for piece in self.read(start, self.units):
            found = (tail + piece).find(mark)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = (tail + piece)[-(len(mark) - 1) :]
        return -1


def cuts(doc_id: object, n: int, special: bool) -> tuple[str, int, int]:
    """Form of a document, and the code points before its middle and before its suffix."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    form = "plain" if not n or special or h3 % 100 >= PLAIN_FROM else "spm" if h4 % 100 < SPM_BELOW else "psm"
    return form, min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))


def transformed(text: Frames, form: str, first: int, second: int) -> Iterator[str]:
    """The output in pieces: each segment is read from the frames it lies in."""
    n = text.units
    parts = {PREFIX: (0, first), SUFFIX: (second, n), MIDDLE: (first, second)}
    orders = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
    if form == "plain":
        return text.read(0, n)
    return chain.from_iterable(chain([mark], text.read(*parts[mark])) for mark in orders[form])


def restored(output: Frames, form: str) -> Iterator[str]:
    """The text that an output and its form stand for, in pieces. The marks are found in the output itself."""
    n = output.units
    if form == "plain":
        return output.read(0, n)
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at, places = 0, []
    for mark in order:
        at = output.find(mark, at)
        if at < 0:
            raise ValueError(f"no {mark} in an output of form {form}")
        places.append(at)
        at += len(mark)
    spans = {mark: (a + len(mark), b) for mark, (a, b) in zip(order, pairwise([*places, n]))}
    return chain.from_iterable(output.read(*spans[mark]) for mark in (PREFIX, MIDDLE, SUFFIX))


def digest(pieces: Iterable[str]) -> str:
    sha = hashlib.sha256()
    for piece in pieces:
        sha.update(piece.encode())
    return sha.hexdigest()


def _store(units: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            special, ends, frames = [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                found = Frames.of([text], units)
                special.append(any(mark in text for mark in SENTINELS))
                ends.append(found.ends)
                frames.append(found.frames)
            yield pa.record_batch({"id": batch.column("id"), "special": pa.array(special, pa.bool_()), "ends": pa.array(ends, pa.list_(pa.int64())),
                                   "frames": pa.array(frames, pa.list_(pa.binary()))})
    return run


def stored_frames(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS) -> DataFrame:
    """Write the texts as frames below ``folder`` on shared storage and give that table: id, special, ends, frames.

    One row per input row; ``special`` says that the text holds a sentinel. A null text is empty and has no frame.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    rows.mapInArrow(_store(units), FRAME_SCHEMA).write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.schema(FRAME_SCHEMA).parquet(folder)


def _transform(units: int, with_output: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output_sha256": [], "restored_sha256": [], "output": []}
            for doc_id, special, ends, frames in zip(*(batch.column(k) for k in ("id", "special", "ends", "frames"))):
                text = Frames(frames.as_py(), ends.as_py())
                form, first, second = cuts(doc_id.as_py(), text.units, special.as_py())
                output = Frames.of(transformed(text, form, first, second), units)
                out["n"].append(text.units)
                out["form"].append(form)
                out["prefix_chars"].append(None if form == "plain" else first)
                out["middle_chars"].append(None if form == "plain" else second - first)
                out["output_sha256"].append(digest(output.read(0, output.units)))
                out["restored_sha256"].append(digest(restored(output, form)))
                out["output"].append("".join(output.read(0, output.units)) if with_output else None)
            kinds = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
            columns = {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items() if with_output or k != "output"}
            yield pa.record_batch({"id": batch.column("id"), **columns})
    return run


def fill_in_middle(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", units: int = UNITS,
                   with_output: bool = False) -> DataFrame:
    """One row per input row: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (, output).

    Texts are stored as independent frames of ``units`` code points with running counts of these. A
    document's cuts come from its id; the frames that hold a segment are decompressed to write it, in
    order, into the frames of the output, and both digests stream over frames: of the output, and of
    the text rebuilt from the output and its form alone. No row is shuffled.

    ``folder`` on shared storage keeps the frames; by default a new one below the checkpoint folder.
    A null text is empty, and its form is plain, as for texts that hold a sentinel. A null id is cut
    as if it were the empty string. Repeated rows and repeated ids each give a row; an
    empty table gives an empty result. A very long text is in its task once, when it is stored; from then on as frames,
    one of them unpacked at a time, but for ``with_output``. Other columns are not read, whatever their names.
    """
    frames = stored_frames(docs, folder or shared_path(docs.sparkSession, "frames"), id_col, text_col, units)
    schema = "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    out = frames.mapInArrow(_transform(units, with_output), schema + (", output string" if with_output else ""))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
