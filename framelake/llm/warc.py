"""WARC archives: writing, the monolithic gzip normaliser, and reading.

Archives are first written the simple way, as one gzip stream a file. The normaliser inflates such a stream once and
writes every record as a gzip member of its own, with a sidecar index of the members' offsets, so that a record, or a
range of records, can be read without what stands before it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.scratch import Scratch
from framelake.llm.spread import salted

ARCHIVE = 256 << 20  # bytes before compression after which a task begins another archive
RANGE = 8 << 20  # compressed bytes that one task reads at least
_STEP = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:framelake:page:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC 1.1 record with its HTTP response; a revisit has the HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _write_archives(folder: str) -> Callable:
    """Each task writes archives of its own name; only those of the attempt that succeeds get into the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int]] = []
        out = packer = None
        size = records = 0

        def close() -> None:
            out.write(packer.flush())
            out.close()
            done.append((name, records))

        for batch in batches:
            for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, size, records = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, wbits=31), 0, 0
                raw = record_bytes(page_id, url, payload, first, revisit)
                out.write(packer.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= ARCHIVE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["name", "records"])

    return run


class _Stream:
    """Bytes inflated on demand from a file of any number of gzip members."""

    def __init__(self, file):
        self.file, self.inflater, self.buffer, self.ended = file, zlib.decompressobj(31), bytearray(), False

    def fill(self) -> bool:
        while not self.ended:
            raw = self.inflater.unused_data if self.inflater.eof else b""
            if self.inflater.eof:
                raw = raw or self.file.read(_STEP)
                if not raw:
                    self.ended = True
                    return False
                self.inflater = zlib.decompressobj(31)
            else:
                raw = self.file.read(_STEP)
                if not raw:
                    raise EOFError("the gzip stream is cut off")
            if more := self.inflater.decompress(raw):
                self.buffer += more
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with ``mark``; None at the end of the stream."""
        at = 0
        while (k := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                if self.buffer.strip():
                    raise EOFError("a record is cut off")
                return None
        out = bytes(self.buffer[: k + len(mark)])
        del self.buffer[: k + len(mark)]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.buffer and not self.fill():
                raise EOFError("a record is cut off")
            piece = bytes(self.buffer[:size])
            del self.buffer[: len(piece)]
            size -= len(piece)
            yield piece


def _header(raw: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", raw)
    return m[1].decode("utf-8", "replace") if m else None


def normalise(source, target, index) -> list[tuple[int, int]]:
    """Rewrites the archive in file ``source`` record by record to ``target``, a gzip member each, and a line of JSON for
    each record to ``index``. Memory is bounded by the buffers, whatever a record's size. Returns offsets and lengths."""
    stream, offset, members = _Stream(source), 0, []
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        packer, size = zlib.compressobj(6, wbits=31), 0
        if part := packer.compress(head):
            size += target.write(part)
        for piece in stream.pieces(int(_header(head, "Content-Length")) + 4):
            if part := packer.compress(piece):
                size += target.write(part)
        size += target.write(packer.flush())
        index.write(json.dumps({"id": _header(head, "WARC-Record-ID"), "type": _header(head, "WARC-Type"), "offset": offset, "length": size}).encode() + b"\n")
        members.append((offset, size))
        offset += size
    return members


def _normalise_all(source: str, target: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(source)
        to, top = pafs.FileSystem.from_uri(target)
        to.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                fresh = f"{uuid.uuid4().hex}.warc.gz"
                with store.open_input_stream(f"{root}/{name}", compression=None) as a, to.open_output_stream(f"{top}/{fresh}", compression=None) as b, to.open_output_stream(f"{top}/{fresh}.index", compression=None) as c:
                    members = normalise(a, b, c)
                start = 0
                for k, (offset, size) in enumerate(members):
                    if offset + size - start >= RANGE or k == len(members) - 1:
                        rows.append((fresh, start, offset + size))
                        start = offset + size
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["name", "start", "stop"])

    return run


def read_records(file, size: int) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of the records in the next ``size`` bytes of a normalised archive."""

    class Part:
        left = size

        def read(self, n: int) -> bytes:
            raw = file.read(min(n, self.left))
            self.left -= len(raw)
            return raw

    stream = _Stream(Part())
    while (head := stream.until(b"\r\n\r\n")) is not None:
        block = b"".join(stream.pieces(int(_header(head, "Content-Length"))))
        b"".join(stream.pieces(4))
        yield head, block


def _page(head: bytes, name: str) -> int | None:
    m = re.search(rf"<{_ID}(-?\d+)>", _header(head, name) or "")
    return int(m[1]) if m else None


def _read_all(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                with store.open_input_file(f"{root}/{name}") as file:
                    file.seek(start)
                    for head, block in read_records(file, stop - start):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = _header(head, "WARC-Type"), (_header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                        size = int(_header(http, "Content-Length"))
                        if kind == "response":
                            if payload_digest(payload) != digest or len(payload) != size:
                                raise ValueError(f"the payload of a record in {name} is damaged")
                        rows.append((_page(head, "WARC-Record-ID"), size, digest, kind, _page(head, "WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return run


def archive_pages(pages: DataFrame, owner: str = "op4", folder: str | None = None) -> DataFrame:
    """Writes a WARC record for every row of ``pages`` (page_id, url, html; others are ignored), normalises the archives
    and reads them back.

    Of records with equal payloads (html in UTF-8; null is empty), the one with the smallest page_id is a response and
    the others revisit it. Returns page_id, payload_bytes, payload_digest, record_type and refers_to as the archives
    have them, a row for each row. Rows that share the smallest page_id and the payload are responses all. A row
    without page_id revisits a row that has one; where no row has one, all are responses. An empty table makes no archive.
    The archives and their indexes are put into ``folder`` (a URI) and stay there; without it they go to the shared folder,
    for as long as the operator's other tables. Either has to be one that pyarrow's file systems reach.

    Who is response and who revisits is told from digests and page_ids; a payload that very many pages share is dealt out
    over tasks by page_id.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, owner)
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k")
    firsts = scratch.table("firsts", firsts)
    rows, firsts = salted(rows, firsts, {"key": "k"}, "n", pages.count(), F.xxhash64("page_id", "url"))
    firsts = firsts.withColumnRenamed("_salt", "s")
    joined = rows.join(firsts, (F.col("key") == F.col("k")) & (F.col("_salt") == F.col("s")), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    plain, split = scratch.folder("plain"), folder.rstrip("/") if folder else scratch.folder("members")
    written = scratch.table("written", joined.select("page_id", "url", "payload", "first", revisit.alias("revisit")).mapInArrow(_write_archives(plain), "name string, records long"))
    tasks = max(1, min(written.count(), 10_000))
    ranges = scratch.table("ranges", written.select("name").repartition(tasks).mapInArrow(_normalise_all(plain, split), "name string, start long, stop long"))
    scratch.drop("plain", "written", "firsts")
    tasks = max(1, min(ranges.count(), 10_000))
    return ranges.repartition(tasks).mapInArrow(_read_all(split), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


_DIGITS = ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::int // {1 << s}) % 32) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

#: The same in DuckDB's SQL, for a table pages without repeated or null page_id.
SQL = f"""
with hashed as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
firsts as (select *, min(page_id) over (partition by h) as first from hashed)
select page_id, payload_bytes, concat({_DIGITS}) as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from firsts
"""
