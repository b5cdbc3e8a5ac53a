"""WARC archives: a gzip member per record, written by Spark's own committer and read by a sequential reader.

Equal payloads (by SHA-1 and SHA-256) of at least ``least_bytes`` are stored once: the row with the largest id (null counts
least) is a response, the others are revisit records that refer to it.

Archives are files of Spark's text writer, so they can lie wherever Spark writes and a lost task leaves nothing behind. A
file is a row of that writer, with as many records as fit into ``file_bytes`` or one that is larger; the separator after
the row is an empty gzip member, which decompresses to nothing. So a file is a sequence of gzip members, one for each record,
that any gzip or WARC reader takes.

The reader goes through a file's bytes without copying them. It inflates member by member in small steps and frames and
digests each record as its bytes appear; a payload is only put together where it is asked for. It raises on a bad digest or
a cut record. Null payloads are empty; a very long one has a file of its own, up to the 2 GB of a row; urls are
of any length, as headers end where their member does, at last; null urls give records without a target; repeated rows are records of their own; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import new_path, release, staged

#: An empty gzip member.
SEPARATOR = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
STEP = 1 << 16
#: What ends a header, and what ends a record.
BLANK, END = b"\r\n\r\n", b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry a fixed date, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
Batches = Iterator[pa.RecordBatch]


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def base32_sha1(raw: bytes) -> str:
    return _base32(hashlib.sha1(raw))


def record(kind: str, page: str | None, url: str | None, payload: bytes | memoryview, refers_to: str | None, digest: str, size: int) -> bytes:
    """A gzip member with one record; a revisit's block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = payload if kind == "response" else b""
    block = hashlib.sha1(http)
    block.update(body)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if " " < c else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{_base32(block)}")]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>")]
        head += [("X-Refers-To-Page", refers_to or "")]
    if page is not None:
        head.append(("X-Page", page))
    head.append(("Content-Length", str(len(http) + len(body))))
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([pack.compress(raw.encode() + http), pack.compress(body), pack.compress(END), pack.flush()])


class CutRecord(ValueError):
    """The archive ends inside a record or breaks its framing."""


class BadDigest(ValueError):
    """A block or payload doesn't match its digest."""


def _members(raw: bytes | memoryview) -> Iterator[Iterator[bytes]]:
    """For each gzip member, its decompressed parts."""
    view, at = memoryview(raw), 0
    while at < len(view):
        unpack = zlib.decompressobj(31)
        used = 0

        def parts() -> Iterator[bytes]:
            nonlocal used
            start = at
            while not unpack.eof:
                if start >= len(view):
                    raise CutRecord("the archive ends inside a gzip member")
                step = view[start : start + STEP]
                start += len(step)
                out = unpack.decompress(step, STEP)
                yield out
                while unpack.unconsumed_tail and not unpack.eof:
                    yield unpack.decompress(unpack.unconsumed_tail, STEP)
                used = start - at - len(unpack.unused_data)

        yield parts()
        if not used:
            raise CutRecord("a member was not read to its end")
        at += used


class _Parts:
    """A member's parts as a stream."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.ready = parts, bytearray()

    def head(self) -> bytes | None:
        """Up to the first blank line; None at the member's end."""
        at = 0
        while (end := self.ready.find(BLANK, at)) < 0:
            at = max(len(self.ready) - len(BLANK) + 1, 0)
            part = next(self.parts, None)
            if part is None and not self.ready:
                return None
            if part is None:
                raise CutRecord("a header does not end")
            self.ready += part
        out = bytes(self.ready[:end])
        del self.ready[: end + len(BLANK)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n > 0:
            part = bytes(self.ready) if self.ready else next(self.parts, None)
            self.ready.clear()
            if part is None:
                raise CutRecord(f"{n} bytes are missing")
            if len(part) > n:
                self.ready += part[n:]
                part = part[:n]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])


def read_records(raw: bytes | memoryview, payloads: bool = True) -> Iterator[tuple[dict[str, str], int, bytes | None]]:
    """(header, length of the payload by its HTTP header, payload of a response or None) of each record, in order; framing and digests are verified."""
    for parts in _members(raw):
        stream = _Parts(parts)
        if (head := stream.head()) is None:
            continue
        if not head.startswith(b"WARC/"):
            raise CutRecord("no WARC header")
        fields = _fields(head)
        http = stream.head() or b""
        block, own, kept, size = hashlib.sha1(http + BLANK), hashlib.sha1(), [], int(fields["Content-Length"]) - len(http) - len(BLANK)
        if size < 0:
            raise CutRecord(fields["WARC-Record-ID"])
        for part in stream.take(size):
            block.update(part)
            own.update(part)
            if payloads:
                kept.append(part)
        if b"".join(stream.take(len(END))) != END or stream.ready or next(parts, b""):
            raise CutRecord(fields["WARC-Record-ID"])
        response = fields["WARC-Type"] == "response"
        if fields["WARC-Block-Digest"] != f"sha1:{_base32(block)}" or response and fields["WARC-Payload-Digest"] != f"sha1:{_base32(own)}":
            raise BadDigest(fields["WARC-Record-ID"])
        told = next(int(v) for k, v in _fields(http).items() if k.lower() == "content-length")
        if response and told != size:
            raise CutRecord(fields["WARC-Record-ID"])
        yield fields, told, b"".join(kept) if response and payloads else None


def _pack(file_bytes: int) -> Callable[[Batches], Batches]:
    """A row per file: records until they have ``file_bytes``."""

    def run(batches: Batches) -> Batches:
        out, size = [], 0
        for batch in batches:
            names = zip(*(batch[c].to_pylist() for c in ("_kind", "_page", "_url", "_to", "_d1", "_size")))
            for (kind, page, url, to, sha1, n), html in zip(names, batch["_html"]):
                payload = memoryview(html.as_buffer()) if html.is_valid else b""
                one = record(kind, page, url, payload, to, base64.b32encode(bytes.fromhex(sha1)).decode(), n)
                if out and size + len(one) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])
                    out, size = [], 0
                out.append(one)
                size += len(one)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, file_bytes: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write pages as WARC archives under ``path``, of at most ``file_bytes`` (compressed) or one record."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_html"), F.sha1(payload.cast("binary")).alias("_d1"), F.sha2(payload, 256).alias("_d2"), F.octet_length(payload).cast("long").alias("_size"), F.monotonically_increasing_id().alias("_row")
    )
    rows = staged(rows, "payloads")
    me = F.struct(F.col("_id").isNotNull().alias("some"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    owners = rows.filter(F.col("_size") >= least_bytes).groupBy("_d1", "_d2").agg(F.max(me).alias("_owner"), F.count(F.lit(1)).alias("_many")).filter("_many > 1")
    owners = staged(owners.drop("_many"), "payload-owners")
    again = F.col("_owner").isNotNull() & (F.col("_owner.row") != F.col("_row"))
    rows = rows.join(owners, ["_d1", "_d2"], "left").withColumn("_kind", F.when(again, F.lit("revisit")).otherwise(F.lit("response")))
    rows = rows.select("_kind", F.col("_id").cast("string").alias("_page"), "_url", F.when(~again | F.col("_owner").isNull(), F.col("_html")).alias("_html"), F.col("_owner.id").cast("string").alias("_to"), "_d1", "_size")
    packed = rows.mapInArrow(_pack(file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    release(owners)


def _unpack(payloads: bool) -> Callable[[Batches], Batches]:
    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for raw in batch["content"]:
                out, size = [], 0
                for fields, n, payload in read_records(memoryview(raw.as_buffer()), payloads):
                    out.append((fields.get("X-Page"), n, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], (fields.get("X-Refers-To-Page") or None), fields.get("WARC-Target-URI"), payload))
                    size += len(payload or b"")
                    if size > 16 << 20:
                        yield _batch(out, names)
                        out, size = [], 0
                yield _batch(out, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names)


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row per record: page, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits, and if not asked for)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_unpack(payloads), "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")


def round_trip(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages written as archives and read back: id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes=least_bytes, id_col=id_col, url_col=url_col, payload_col=payload_col)
    kind = pages.schema[id_col].dataType
    out = read_archives(pages.sparkSession, path, payloads=False)
    return out.select(F.col("page").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
