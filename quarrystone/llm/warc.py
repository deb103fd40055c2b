"""WARC archives: a writer of deduplicated records and a reader that salvages.

The reader checks every record (gzip member, version line, headers, length,
closing line ends, SHA-1 payload digest). Where a check fails it searches for
the next gzip member or version line at which a valid record begins, goes on
there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.shared import partitions, saved, shared_dir
from quarrystone.sources.tables import table

MEMBER = b"\x1f\x8b\x08"
HERE = re.compile(rb"WARC/1\.[01]\r?\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_LENGTH = re.compile(rb"(?i)\r\ncontent-length: *(\d+)")
PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


def record(kind: str, record_id: str, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has the HTTP header but not the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", date),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20]+", "%20", url) if url else None),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", refers_to),
        ("WARC-Profile", REVISIT if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 32 << 20, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row into gzipped archives; returns a row per archive: path, records, bytes.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the
    greatest id are responses, the others revisits of it. Null html is an
    empty payload. Rows with a null id are always responses. Each task writes
    files of its own name, of about ``roll_bytes``; only the files of the
    attempt that succeeded are in the result, so a lost executor leaves at
    worst a file that no one reads. An empty table gives no archives.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.unhex(F.sha1("payload")))
    # Written: adaptive execution splits a hot payload only in a join of two tables that are both shuffled for it.
    keepers = saved(rows.groupBy("key").agg(F.max("id").alias("keeper")), "keepers")
    revisit = (F.octet_length("payload") >= min_bytes) & (F.col("id") < F.col("keeper"))
    marked = rows.join(keepers, "key").select("id", "url", "payload", "key", F.when(revisit, F.col("keeper")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        out, path, n = None, "", 0

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for row, url, payload, key, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(base, recursive=True)
                    out, path, n = system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
                name = f"<urn:x-page:{row}>" if row is not None else f"<urn:uuid:{uuid.uuid4()}>"
                other = f"<urn:x-page:{refers_to}>" if refers_to is not None else None
                raw = record("revisit" if other else "response", name, url, date, payload, base64.b32encode(key).decode(), other)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(raw) + packer.flush())
                n += 1
                if out.tell() >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return saved(marked.mapInArrow(write, "path string, records long, bytes long"), "archives")


# ---------------------------------------------------------------- reading


class Archive:
    """The bytes of an archive, read block by block.

    A search remembers what it found last: as later ones begin further on, all
    searches for one mark together pass over the archive once.
    """

    BLOCK = 1 << 20

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.start, self.block = 0, b""
        self.last: dict[bytes, tuple[int, int]] = {}

    @classmethod
    def of(cls, data: bytes) -> Archive:
        return cls(lambda at, n: data[at : at + n], len(data))

    def bytes(self, at: int, end: int) -> bytes:
        """What stands from ``at`` to ``end``, or to the archive's end."""
        end = min(end, self.size)
        if at >= end:
            return b""
        if at < self.start or end > self.start + len(self.block):
            if end - at > self.BLOCK // 2:
                return self.read(at, end - at)
            self.start, self.block = at, self.read(at, min(self.BLOCK, self.size - at))
        return self.block[at - self.start : end - self.start]

    def find(self, mark: bytes, at: int) -> int:
        """The next place of ``mark`` from ``at`` on, or the archive's size."""
        asked, found = self.last.get(mark, (0, -1))
        if asked <= at <= found:
            return found
        place, step = at, 1 << 10
        while place < self.size:
            if (i := self.bytes(place, place + step + len(mark) - 1).find(mark)) >= 0:
                break
            place, step = place + step, min(2 * step, self.BLOCK // 2)
        found = place + i if place < self.size else self.size
        self.last[mark] = at, found
        return found

    def version(self, at: int) -> int:
        """The next version line at a line's beginning, or the archive's size."""
        while (at := self.find(b"WARC/1.", at)) < self.size:
            if (at == 0 or self.bytes(at - 1, at) == b"\n") and HERE.match(self.bytes(at, at + 10)):
                return at
            at += 1
        return self.size


class Broken(Exception):
    """A record that fails a check."""


def parsed(data: Archive, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at`` of plain bytes."""
    start = HERE.match(data.bytes(at, at + 10))
    if not start:
        raise Broken("no version line")
    stop = data.find(b"\r\n\r\n", at + start.end() - 2)
    if stop >= data.size:
        raise Broken("headers without end")
    if data.version(at + 1) < stop:
        raise Broken("a version line among headers")
    headers = {}
    for line in data.bytes(at + start.end(), stop).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line and not colon:
            raise Broken("header without colon")
        if line:
            headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no content length")
    end = stop + 4 + int(length)
    if data.bytes(end, end + 4) != b"\r\n\r\n":
        raise Broken("length and closing line ends disagree")
    block = data.bytes(stop + 4, end)
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and digest_of(payload_of(headers, block)) != digest[5:].upper():
        raise Broken("payload digest differs")
    if http := HTTP_LENGTH.search(block.partition(b"\r\n\r\n")[0]) if headers.get("content-type", "").startswith("application/http") else None:
        headers["http-content-length"] = http[1].decode()
    return headers, block, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP header, where it has one."""
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


ENDLESS = "gzip member without end"


def member(data: Archive, at: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``at``; of a broken one what can be unpacked, where reading stopped, and why."""
    unpack, out, fed, flaw, step = zlib.decompressobj(31), [], at, None, 1 << 14
    while not unpack.eof:
        if fed >= data.size:
            flaw = flaw or ENDLESS
            break
        part = data.bytes(fed, fed + step)
        try:
            out.append(unpack.decompress(part))
        except zlib.error:
            if flaw:  # the first byte that cannot be read
                break
            flaw = "gzip member fails its check"
            # What the failing part holds is lost with the error: again to its beginning, then byte by byte.
            unpack, step = zlib.decompressobj(31), 1
            out = [unpack.decompress(data.bytes(i, min(i + (1 << 14), fed))) for i in range(at, fed, 1 << 14)]
            continue
        fed += len(part)
    return b"".join(out), fed - len(unpack.unused_data), flaw


Found = tuple[int, int, str | None, dict[str, str] | None, bytes | None]


def plain(data: Archive) -> Iterator[Found]:
    """Start, end and either headers and block of each valid record of plain bytes, or the reason of each gap."""
    at, gap, why = 0, None, ""
    while at < data.size:
        try:
            headers, block, end = parsed(data, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = data.version(at + 1)
            continue
        if gap is not None:
            yield gap, at, why, None, None
            gap = None
        yield at, end, None, headers, block
        at = end
    if gap is not None:
        yield gap, data.size, why, None, None


def salvage(archive: bytes | Archive) -> Iterator[Found]:
    """Start, end and either headers and block of each valid record, or the reason of each gap.

    A member of which only some records are valid gives these, and its gaps
    with their places in the unpacked content. A broken or cut member gives the
    valid records of what can be unpacked, and is itself a gap. Of an archive
    one block and one member's content are held at a time.
    """
    data = archive if isinstance(archive, Archive) else Archive.of(archive)
    at, gap, why = 0, None, ""
    while at < data.size:
        flaw = None
        try:
            if data.bytes(at, at + len(MEMBER)) == MEMBER:
                content, end, flaw = member(data, at)
                inner = list(plain(Archive.of(content)))
                if (flaw or inner) and all(reason for _, _, reason, _, _ in inner):
                    raise Broken(flaw or inner[0][2])
                found = [(reason and f"{reason} (bytes {a} to {b} of the unpacked member)", headers, block) for a, b, reason, headers, block in inner]
            else:
                headers, block, end = parsed(data, at)
                found = [(None, headers, block)]
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = beginning(data, at + 1)
            continue
        if gap is not None:
            yield gap, at, why, None, None
            gap = None
        for reason, headers, block in found:
            yield at, end, reason, headers, block
        if flaw:
            gap, why = at, flaw
            at = beginning(data, at + 1)
        else:
            at = end
    if gap is not None:
        yield gap, data.size, why, None, None


def beginning(data: Archive, at: int) -> int:
    """The next place from ``at`` on at which a member or record may begin."""
    return min(data.find(MEMBER, at), data.version(at))


READ = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
READ_SQL = "path string, start long, end long, gap string, record_type string, record_id string, headers map<string,string>, payload binary"


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps of the archives named in column ``path``.

    A row per record (gap null; payload without the HTTP header, which for a
    revisit is empty) or per gap (its reason in ``gap``, other columns null),
    with the bytes ``start`` to ``end`` of the archive. Archives are plain or
    gzipped; an empty one gives no rows. Null paths are skipped.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    archive = Archive(lambda at, n, f=f: f.read_at(n, at), f.size())
                    rows: list[tuple] = []
                    size = 0
                    for start, end, gap, headers, block in salvage(archive):
                        payload = payload_of(headers, block) if headers is not None else None
                        rows.append((path, start, end, gap, headers and headers.get("warc-type"), headers and headers.get("warc-record-id"), headers and list(headers.items()), payload))
                        size += len(payload or b"") + 500
                        if size > 16 << 20:
                            yield arrow(rows)
                            rows, size = [], 0
                    yield arrow(rows)

    def arrow(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(READ)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, READ, strict=True)], schema=READ)

    paths = archives.select("path").where("path IS NOT NULL")
    return paths.repartition(partitions(archives.sparkSession)).mapInArrow(read, READ_SQL)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), folder)).where("gap IS NULL")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, name, headers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                headers = dict(headers)
                own, other = PAGE.fullmatch(name), PAGE.fullmatch(headers.get("warc-refers-to", ""))
                full = kind == "response"
                size = len(payload) if full else int(headers["http-content-length"])
                digest = digest_of(payload) if full else headers["warc-payload-digest"].removeprefix("sha1:")
                rows.append((own and int(own[1]), size, digest, kind, other and int(other[1])))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.select("record_type", "record_id", "headers", "payload").mapInArrow(summary, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS keeper,
             array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest
      FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM d
"""
