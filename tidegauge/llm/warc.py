"""WARC archives: one gzip member a record, written by tasks and read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, checkpointed, numbered, staged

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 * 1024 * 1024
#: Most tasks that read ranges; beyond it a task reads some ranges one after another.
MOST_READERS = 100_000
WINDOW, STEP = 1 << 20, 1 << 15
DATE = "2024-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path; Hadoop writes local paths with one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(page: object, row: int) -> str:
    return f"<urn:x-page:{'' if page is None else quote(str(page), safe='')}:{row}>"


def record(page: object, row: int, url: str | None, payload: bytes, digest: str, refers_to: tuple | None) -> bytes:
    """One record. A revisit keeps the HTTP head, with the payload's length, and names the response it repeats."""
    own = _record_id(page, row)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else own[1:-1]}", f"WARC-Payload-Digest: sha1:{base32(digest)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {_record_id(*refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        name, file, size, count = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                file = file or system.open_output_stream(f"{inner}/{name}", compression=None)
                refers_to = None if r["keep_row"] is None else (r["keep_id"], r["keep_row"])
                data = _member(record(r["id"], r["row"], r["url"], r["payload"], r["digest"], refers_to))
                file.write(data)
                size, count = size + len(data), count + 1
        if file:
            file.close()
            yield pa.record_batch({"path": [f"{folder}/{name}"], "size": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})
    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit_bytes: int = 0) -> DataFrame:
    """Write one record per row below ``folder`` on shared storage; the manifest: path, size, records.

    Of records with equal payloads of at least ``min_revisit_bytes`` the one with the smallest id
    is a response and the others revisit it. Every task attempt writes a file of its own name and
    only the manifest of the attempt that counts names it, so lost or repeated tasks do no harm.

    A null payload is empty. A null id ranks last. Of repeated rows with the smallest id one is the response.
    """
    rows = staged(numbered(pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ), "row").withColumn("digest", F.sha1("payload")))
    size = F.octet_length("payload")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    shared = checkpointed(
        rows.where(size >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
        .select(F.col("digest").alias("of_digest"), F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    )
    again = (F.col("digest") == F.col("of_digest")) & (size >= min_revisit_bytes) & (F.col("row") != F.col("keep_row"))
    told = rows.join(broadcast_if_small(shared, 128), again, "left").drop("of_digest")
    return checkpointed(told.mapInArrow(_write(folder), "path string, size bigint, records bigint"))


class _Window:
    """Random access that keeps one stretch of the file."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes from ``offset``, fewer at the end of the file."""
        length = min(length, self.size - offset)
        if offset < self.base or offset + length > self.base + len(self.data):
            self.file.seek(offset)
            self.base, self.data = offset, self.file.read(max(length, WINDOW))
        return self.data[offset - self.base : offset - self.base + length]


def _decoded(window: _Window, offset: int) -> tuple[bytes, int] | None:
    """Record and end of the member at ``offset``; None if no whole member with a WARC head begins there."""
    unpacker, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not unpacker.eof:
            data = window.at(at, STEP)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            at += len(data)
            if not b"WARC/1.".startswith(parts[0][:7]) if len(parts[0]) < 7 else not parts[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpacker.unused_data)


def members(window: _Window, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Records of members that begin in [start, end), wherever they end."""
    position = start
    while position < end:
        data = window.at(position, min(STEP, end - position) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found < 0:
            position += max(len(data) - len(MAGIC) + 1, 1)
            continue
        offset = position + found
        whole = _decoded(window, offset)
        if whole is None:
            position = offset + 1
            continue
        yield offset, whole[0]
        position = whole[1]


def parsed(data: bytes) -> dict:
    """Fields of a record; the digest of a stored payload is computed and held against the head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and base32(hashlib.sha1(payload).hexdigest()) != digest:
        raise ValueError(f"Payload digest of {fields['WARC-Record-ID']} doesn't match")
    length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1]) if revisit else len(payload)

    def page(uri: str | None) -> str | None:
        return unquote(uri.split(":")[2]) or None if uri else None

    return {"id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload}


def _read(columns: list[str], types: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, inner = opened(r["path"])
                out, held = [], 0
                with system.open_input_file(inner) as file:
                    for _, data in members(_Window(file, r["size"]), r["start"], min(r["start"] + r["length"], r["size"])):
                        out.append(parsed(data))
                        held += len(data) if "payload" in columns else 256
                        if held > 8_000_000:
                            yield pa.record_batch({c: pa.array([x[c] for x in out], types[c]) for c in columns})
                            out, held = [], 0
                yield pa.record_batch({c: pa.array([x[c] for x in out], types[c]) for c in columns})
    return run


def read_warc(files: DataFrame, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record of the files (path, size): id, url, payload_bytes, payload_digest, record_type, refers_to (, payload).

    Files are cut into byte ranges. A task looks for gzip magic in its range, takes a
    candidate as a member only if it decodes from there to its end and begins with a WARC head, and
    owns the records that begin inside. HTML in UTF-8 can't hold the magic bytes, and
    compressed data that hold them by chance don't decode.
    """
    step = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / range_bytes) - 1, F.lit(0)))).alias("k")
    ranges = files.where("size > 0").select("path", "size", step).select(
        "path", "size", (F.col("k") * range_bytes).cast("bigint").alias("start"), F.lit(range_bytes).cast("bigint").alias("length")
    )
    types = {"id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.string(), "payload": pa.binary()}
    columns = [c for c in types if c != "payload" or with_payload]
    names = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    # With a number, so that these few rows aren't put back into one task: a task per range, up to ``MOST_READERS``.
    readers = min(max(ranges.count(), 1), MOST_READERS)
    return ranges.repartition(readers, "path", "start").mapInArrow(_read(columns, types), ", ".join(f"{c} {names[types[c]]}" for c in columns))


def warc_round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                    min_revisit_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` and read them back: id, payload_bytes, payload_digest, record_type, refers_to.

    One row per input row, null ids as null. An empty table writes no file and gives an empty result. Other columns are not read.
    """
    files = write_warc(pages, folder, id_col, url_col, html_col, min_revisit_bytes)
    kind = pages.schema[id_col].dataType
    return read_warc(files, range_bytes=range_bytes).select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
