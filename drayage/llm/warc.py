"""WARC archives: one gzip member per record, written by tasks and read back as streams.

Writing: records of equal payloads are found by digest and length; the one with the largest id is
the response and carries the payload, the others revisit it. Every task writes one archive to a
file of its own attempt and renames it when it is whole, so a task that is run again, or twice,
leaves whole archives only; the table of archives names those that count.

Reading: an archive is read in blocks of ``BLOCK`` bytes through an incremental zlib decompressor,
one member after the other. Headers are read up to the empty line, the content by the length they
state, and payload digests are computed while reading and compared with the headers. A record that
is cut off, longer or shorter than stated, or whose digest differs raises ``WarcError``.

Archives go to the shared folder through the file system its address names; no record is held
longer than it is being read or written.

Defined cases: a null payload is empty; a null id sorts before all others and reads back as null;
rows that repeat the id and payload of the response are responses too; payloads shorter than
``min_revisit_bytes`` are all responses; an empty table writes no archive and reads back empty.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drayage.llm.common import stage
from drayage.session import scratch_dir

BLOCK = 1 << 16
MAX_HEADER = 1 << 20
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_LEVEL = 4


class WarcError(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], content: bytes) -> bytes:
    """A whole record as one gzip member."""
    head = VERSION + b"\r\n" + b"".join(
        f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(content)))])
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + content + b"\r\n\r\n") + packer.flush()


class _Members:
    """The decompressed bytes of one gzip member after the other."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.raw, self.held, self.unzip = file, b"", b"", None

    def next_member(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(BLOCK)
        if not self.raw:
            return False
        self.unzip, self.held = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        """Decompresses on; False at the end of the member."""
        while not self.unzip.eof:
            raw = self.raw or self.file.read(BLOCK)
            out = self.unzip.decompress(raw, BLOCK)
            # At the end of a member the rest belongs to the next one.
            self.raw = self.unzip.unused_data if self.unzip.eof else self.unzip.unconsumed_tail
            if out:
                self.held += out
                return True
            if not raw and not self.unzip.eof:
                raise WarcError("the archive ends inside a member")
        return False


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], int, str]]:
    """Headers, payload length and payload digest of every record, verified."""
    members = _Members(file)
    while members.next_member():
        while (end := members.held.find(b"\r\n\r\n")) < 0:
            if len(members.held) > MAX_HEADER or not members.more():
                raise WarcError("a record without the end of its headers")
        lines = members.held[:end].split(b"\r\n")
        if lines[0] != VERSION:
            raise WarcError(f"not a record: {lines[0][:20]!r}")
        headers = dict(line.decode().split(": ", 1) for line in lines[1:])
        left = length = int(headers["Content-Length"])
        members.held = members.held[end + 4:]
        sha = hashlib.sha1()
        while left:
            if not members.held and not members.more():
                raise WarcError("a record shorter than its Content-Length")
            part, members.held = members.held[:left], members.held[left:]
            sha.update(part)
            left -= len(part)
        while members.more():
            if len(members.held) > 4:
                break
        if members.held != b"\r\n\r\n":
            raise WarcError("a record longer than its Content-Length")
        found = base64.b32encode(sha.digest()).decode()
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "revisit":
            yield headers, int(headers["X-Payload-Length"]), stated
        elif found != stated:
            raise WarcError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
        else:
            yield headers, length, found


def with_roles(rows: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """Adds ``digest``, ``n_bytes``, ``record_type`` and ``refers_to`` to rows of (id, url, payload).

    Only ids, digests and lengths meet by payload; the payloads themselves are dealt by id, so equal
    ones are spread over all tasks. The first of every group is staged, which lets Spark split the join
    where one payload has very many rows.
    """
    marked = rows.withColumn("digest", F.sha1("payload")).withColumn(
        "n_bytes", F.octet_length("payload").cast("long"))
    short = marked.select("id", "digest", "n_bytes")
    first = stage(short.groupBy("digest", "n_bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("rows"))
                  .filter((F.col("rows") > 1) & (F.col("n_bytes") >= min_revisit_bytes)).drop("rows"), "warc-first")
    revisits = stage(
        short.join(first, ["digest", "n_bytes"]).filter(~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("of_id"), F.col("digest").alias("of_digest"), "first").distinct(), "warc-revisits")
    revisit = F.col("of_digest").isNotNull()
    return marked.join(
        revisits, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left").select(
        "id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def _record(page: dict) -> bytes:
    payload = page["payload"] or b""
    name = "null" if page["id"] is None else str(page["id"])
    headers = [
        ("WARC-Type", page["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", _DATE), ("WARC-Target-URI", " ".join((page["url"] or "").split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Page-Id", name)]
    if page["record_type"] == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(page["refers_to"])),
                    ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, str(page['refers_to']))}>"),
                    ("X-Payload-Length", str(len(payload)))]
        return record_bytes(headers, b"")
    return record_bytes([*headers, ("Content-Type", "text/html; charset=utf-8")], payload)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes one archive per task below ``folder``; returns rows of (archive, records)."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, out, store = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            for page in batch.to_pylist():
                if out is None:
                    store, path = fs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    final = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{final}.open", compression=None)
                out.write(_record(page))
                n += 1
        if out is not None:
            out.close()
            store.move(f"{final}.open", final)
            name = final.rsplit("/", 1)[1]
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder.rstrip('/')}/{name}"], "records": [n]})

    written = with_roles(rows, min_revisit_bytes).mapInArrow(write, "archive string, records long")
    return stage(written, "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the named archives; a task reads whole archives, block by block."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, record_id string, archive string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, stated in zip(*(batch.column(c).to_pylist() for c in ("archive", "records")), strict=True):
                store, path = fs.FileSystem.from_uri(archive)
                rows, n = [], 0
                with store.open_input_stream(path, compression=None) as file:
                    for headers, length, digest in read_records(file):
                        page, to = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                        rows.append((None if page == "null" else int(page), headers.get("WARC-Target-URI", ""), length,
                                     digest, headers["WARC-Type"], None if to in (None, "null") else int(to),
                                     headers["WARC-Record-ID"], archive))
                        n += 1
                        if len(rows) == 5_000:
                            yield _rows(rows)
                            rows = []
                if n != stated:
                    raise WarcError(f"{archive} has {n} records, {stated} were written")
                if rows:
                    yield _rows(rows)

    # By number: rows this short would all be merged into one task otherwise.
    return archives.repartition(max(1, archives.count())).mapInArrow(read, schema)


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "archive"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def archive_folder(df: DataFrame) -> str:
    folder = scratch_dir(df.sparkSession, "warc")
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
