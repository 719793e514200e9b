"""WARC archives: one gzip member for each record, written by tasks, and read back over byte ranges."""

from __future__ import annotations

import hashlib
import os
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from hedgerow.llm.shared import new_folder, salted_join, written

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Warc:
    """``least``: payloads of fewer bytes are never revisits. ``file``: bytes after which a task begins a new archive.

    ``split``: bytes of one reading range; ``read``: bytes read at a time.
    """

    least: int = 100
    file: int = 256 << 20
    split: int = 16 << 20
    read: int = 1 << 20


def _store(uri: str):
    """The file system of a path or URI that all tasks reach, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _clean(value) -> str:
    """A header value in one line."""
    return "".join(c if c > " " and c != "\x7f" else "%" + format(ord(c), "02X") for c in value or "")


def record(key: int, url: str, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record as a gzip member; a revisit has no block, its payload is the one it refers to."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{key}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Length: {len(payload)}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode()) + deflate.compress(payload) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def write(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", body: str = "html", how: Warc = Warc()) -> DataFrame:
    """Write every row of ``pages`` as a record below ``folder`` and return (path, size) of the archives.

    Of rows with equal payloads of at least ``how.least`` bytes the one with the smallest id is a response, the others
    revisit it. A null body is an empty payload. Rows with a null id get none and are left out; of rows with equal ids
    and payloads each is a record of the same type. A task writes under a name of its own and renames at its end, so
    that a repeated task leaves no half files and replaces what it wrote before.
    """
    rows = pages.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url") if url in pages.columns else F.lit("").alias("url"),
        F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= how.least
    first = rows.where(large).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(
        "first < last").select("digest", "first")
    typed = salted_join(rows, first, ["digest"], "left").withColumn(
        "refers", F.when(large & (F.col("first") < F.col("id")), F.col("first")))
    limit = how.file

    def save(batches):
        store, top = _store(folder)
        context = TaskContext.get()
        name, number, size, out, temporary = f"part-{context.partitionId():05d}", 0, 0, None, ""
        done = []

        def close():
            out.close()
            path = f"{top}/{name}-{number:03d}.warc.gz"
            store.move(temporary, path)
            done.append((f"{folder}/{os.path.basename(path)}", size))

        for batch in batches:
            for key, address, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(top, recursive=True)
                    temporary, size = f"{top}/_{name}-{number:03d}-{context.taskAttemptId()}", 0
                    out = store.open_output_stream(temporary)
                member = record(key, address, payload, digest, refers)
                out.write(member)
                size += len(member)
                if size >= limit:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())],
                                         ["path", "size"])

    return written(typed.select("id", "url", "payload", "digest", "refers").mapInArrow(save, "path string, size long"), "archives")


class _Tape:
    """Bytes of a file from a position on, read as they are needed; what lies before ``at`` can be dropped."""

    def __init__(self, file, at: int, step: int):
        self.file, self.base, self.step, self.held, self.ended = file, at, step, b"", False
        file.seek(at)

    def more(self) -> bool:
        got = b"" if self.ended else self.file.read(self.step)
        self.ended = not got
        self.held += got
        return bool(got)

    def find(self, what: bytes, at: int) -> int:
        """Position of ``what`` from ``at`` on, or -1."""
        while (k := self.held.find(what, at - self.base)) < 0:
            at = max(at, self.base + len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return self.base + k

    def drop(self, at: int) -> None:
        if at - self.base > self.step:
            self.held, self.base = self.held[at - self.base:], at

    def at(self, position: int, size: int) -> bytes:
        while position - self.base >= len(self.held):
            if not self.more():
                return b""
        return self.held[position - self.base: position - self.base + size]


def _header(data: bytes) -> dict[str, str] | None:
    """Fields of a record header, or None if the bytes do not start with a whole one."""
    head, end, _ = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        return None
    fields = dict(line.partition(": ")[::2] for line in lines[1:])
    return fields if "WARC-Type" in fields and fields.get("Content-Length", "").isdigit() else None


def _candidate(tape: _Tape, at: int, most: int = 64 << 10) -> bool:
    """Whether a gzip member with a record header starts at ``at``: bytes that only look like one fail here.

    A header is read to its end, or to the member's, however long it is; only at most ``most`` bytes are decoded at a time.
    """
    inflate, parts, tail, position, begun = zlib.decompressobj(31), [], b"", at, False
    try:
        while not inflate.eof:
            chunk = inflate.unconsumed_tail or tape.at(position, 2048)
            if not chunk:
                break
            if not inflate.unconsumed_tail:
                position += len(chunk)
            got = inflate.decompress(chunk, most)
            parts.append(got)
            if not begun:
                start = b"".join(parts)[:5]
                if not b"WARC/".startswith(start):
                    return False
                begun = len(start) == 5
            if b"\r\n\r\n" in tail + got:
                break
            tail = (tail + got)[-3:]
    except zlib.error:
        return False
    return _header(b"".join(parts)) is not None


def members(file, start: int, end: int, how: Warc):
    """(position, fields, block) of the records that start in bytes ``start`` to ``end``, wherever they end.

    Where one record ends the next one or the file's end must be, also across ``end``: no record written is passed over.
    """
    tape, at, known = _Tape(file, start, how.read), start, start == 0
    while at < end:
        if not known:
            at = tape.find(MAGIC, at)
            if at < 0 or at >= end:
                return
        tape.drop(at)
        if not _candidate(tape, at):
            if known:
                raise ValueError(f"no record starts at {at}, where one should")
            at += 1
            continue
        inflate, parts, position = zlib.decompressobj(31), [], at
        while not inflate.eof:
            chunk = tape.at(position, 16384)
            if not chunk:
                raise ValueError(f"the record at {at} is cut short")
            position += len(chunk)
            parts.append(inflate.decompress(chunk))
        position -= len(inflate.unused_data)
        data = b"".join(parts)
        fields = _header(data)
        begin = data.index(b"\r\n\r\n") + 4
        yield at, fields, data[begin: begin + int(fields["Content-Length"])]
        at, known = position, True
    tape.drop(at)
    if known and tape.at(at, 1) and not _candidate(tape, at):
        raise ValueError(f"no record starts at {at}, where one should")


def read(spark: SparkSession, archives: DataFrame, how: Warc = Warc()) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, path, position) of all records.

    Each archive is cut into ranges of ``how.split`` bytes. A task looks for gzip magic from its range's start, takes a
    hit only if a record header can be decoded there, and reads every record that starts inside its range to its end,
    so each record is read once; one that is cut short or damaged raises, and so do bytes between
    records. Digest and length of a response are computed from its payload, those of a revisit are
    its header's. No archives give no rows.
    """
    ranges = archives.where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(how.split).cast("long"))).alias("start"))

    def scan(batches):
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, inside = _store(path)
                with store.open_input_file(inside) as file:
                    rows, held = [], 0
                    for position, fields, block in members(file, start, min(size, start + how.split), how):
                        response = fields["WARC-Type"] == "response"
                        key = lambda name: int(fields[name].rpartition(":")[2].rstrip(">")) if name in fields else None
                        digest = hashlib.sha256(block).hexdigest()
                        if response and "sha256:" + digest != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{path} at {position}: the payload is not what its digest says")
                        rows.append((key("WARC-Record-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], key("WARC-Refers-To"),
                                     len(block) if response else int(fields["X-Payload-Length"]),
                                     digest if response else fields["WARC-Payload-Digest"].rpartition(":")[2],
                                     block if response else None, path, position))
                        held += len(block)
                        if held > 8 << 20:
                            yield as_batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield as_batch(rows)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
                        ("path", pa.string()), ("position", pa.int64())])

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start").mapInArrow(
        scan, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
              "payload binary, path string, position long")


def round_trip(pages: DataFrame, how: Warc = Warc(), folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives in the shared folder (or ``folder``) and return the records read back from them."""
    spark = pages.sparkSession
    return read(spark, write(pages, folder or new_folder(spark, "warc"), how=how), how)
