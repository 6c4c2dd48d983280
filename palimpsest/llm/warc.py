"""WARC 1.1 archives: a writer, and a PySpark Python data source.

Archives hold one gzip member per record. A page becomes a ``response`` record (HTTP headers and payload) or, where
another record has the same payload, a ``revisit`` record (HTTP headers only, with ``WARC-Refers-To``). The HTTP
headers' Content-Length is that of the full payload in both.

The data source plans one partition per file, or per group of small files. Files may be compressed by record, or plain
(their first bytes tell). It takes equality and IN filters on ``record_type``, ``record_id``, ``target_uri`` and
``payload_digest``, parses a record's headers first, and inflates the rest of a record that it does not want only as far as
finding the next one needs, without keeping or decoding it. Column pruning is by the ``payload`` option: "false" leaves
payloads undecoded and null. HTTP headers are looked for inside the block only, and in its first ``HTTP_HEAD`` bytes; a
block without their end is payload as a whole. ``payload_bytes`` is what the block has after the HTTP headers, and in
revisits what the headers declare (null without a valid Content-Length).

Defined results: a null payload is empty; of equal payloads the smallest id is the response, and rows of that same id
are responses too; rows without an id never are referred to, and are responses where nothing else is; other columns are
dropped; an empty table makes no archive, and reading it gives an empty result. A file that ends inside a record, is
broken in its compression or has a record without a valid Content-Length fails the read and is named; with the option
``broken`` set to "skip" its whole records before that place are given instead.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from . import common
from .files import Atomic, store

#: Parts over which each payload's pages are dealt, so that a payload of a third of all pages is no single task's.
SALTS = 32
#: Bytes that a record's own headers have at most.
WARC_HEAD = 1 << 20
#: Bytes of a block in which the end of HTTP headers is looked for.
HTTP_HEAD = 1 << 16
#: Small archives are read together up to this size.
GROUP_BYTES = 32 << 20

ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, refers_to string,"
    " payload_bytes long, content_type string, payload binary"
)
MANIFEST = "file string, n_records long, n_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + gz.flush()


def _with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, folder: str) -> DataFrame:
    """id, url, payload, and ``original``, the smallest id of its payload. Pages move once, over salted digests."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("original"), F.count("*").alias("n"))
    shared = common.cut(groups.filter("n > 1").select("digest", "original"), folder, "shared")
    shared = shared.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    return salted.join(shared, ["digest", "salt"], "left").select("id", "url", "payload", "original")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page; the manifest, a row for each archive, is the result."""
    common.tune(pages.sparkSession)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        name, count, size = f"part-{TaskContext.get().partitionId():08d}.warc.gz", 0, 0
        with Atomic(f"{folder}/{name}") as out:
            while first is not None:
                for page_id, url, payload, original in zip(*(c.to_pylist() for c in first.columns), strict=True):
                    data = record(page_id, url, payload, None if original is None or original == page_id else original)
                    out.write(data)
                    count, size = count + 1, size + len(data)
                first = next((b for b in batches if b.num_rows), None)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [count], "n_bytes": [size]})

    rows = _with_originals(pages, id_col, url_col, html_col, min_bytes, folder + "-plan")
    return common.cut(rows.mapInArrow(archive, MANIFEST), folder, "manifest")


class BrokenArchive(ValueError):
    """A file that does not go on as WARC records do."""


class _Bytes:
    """The uncompressed bytes of an archive, as far as they are asked for."""

    CHUNK = 1 << 18

    def __init__(self, file):
        self.file, self.have, self.inflate = file, b"", None
        self.raw = file.read(self.CHUNK)
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _next(self) -> bytes:
        """Some more bytes; none at the end of the file."""
        if not self.packed:
            out, self.raw = self.raw, b""
            return out or self.file.read(self.CHUNK)
        while True:
            self.raw = self.raw or self.file.read(self.CHUNK)
            if self.inflate is None:
                if not self.raw:
                    return b""
                self.inflate = zlib.decompressobj(31)
            elif not self.raw:
                raise BrokenArchive("it ends inside a gzip member")
            try:
                out = self.inflate.decompress(self.raw, self.CHUNK)
            except zlib.error as e:
                raise BrokenArchive(str(e)) from e
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if out:
                return out

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes are at hand."""
        parts, size = [self.have], len(self.have)
        while size < n and (more := self._next()):
            parts.append(more)
            size += len(more)
        self.have = b"".join(parts)
        return size >= n

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise BrokenArchive("it ends inside a record")
        out, self.have = self.have[:n], self.have[n:]
        return out

    def skip(self, n: int) -> None:
        while n > len(self.have):
            n, self.have = n - len(self.have), self._next()
            if not self.have:
                raise BrokenArchive("it ends inside a record")
        self.have = self.have[n:]

    def head(self) -> bytes | None:
        """A record's headers; None at the end of the file."""
        while True:
            self.have = self.have.lstrip(b"\r\n")
            if (at := self.have.find(b"\r\n\r\n", 0, WARC_HEAD)) >= 0:
                out, self.have = self.have[:at], self.have[at + 4 :]
                return out
            if len(self.have) >= WARC_HEAD:
                raise BrokenArchive(f"a record's headers do not end within {WARC_HEAD} bytes")
            if not self.fill(len(self.have) + 1):
                if self.have.strip():
                    raise BrokenArchive("it ends inside a record's headers")
                return None

    def http(self, block: int) -> bytes | None:
        """The HTTP headers with their end at the beginning of a block of that many bytes; None if it has none."""
        limit = min(block, HTTP_HEAD)
        if not self.fill(limit):
            raise BrokenArchive("it ends inside a record")
        at = self.have.find(b"\r\n\r\n", 0, limit)
        return None if at < 0 else self.take(at + 4)


def _size(value: str | None) -> int | None:
    return int(value) if value is not None and value.isascii() and value.isdigit() else None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    #: Columns that a record's own headers decide.
    PUSHED = {"record_type", "record_id", "target_uri", "payload_digest"}

    def __init__(self, folder: str, payload: bool, skip_broken: bool = False):
        self.folder, self.payload, self.skip_broken, self.wanted = folder, payload, skip_broken, {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in self.PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs as pafs

        fs, path = store(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        groups, size = [[]], 0
        for f in sorted((f for f in found if f.path.endswith((".warc", ".warc.gz"))), key=lambda f: f.path):
            if groups[-1] and size + f.size > GROUP_BYTES:
                groups, size = [*groups, []], 0
            groups[-1].append(f"{self.folder}/{f.path.rpartition('/')[2]}")
            size += f.size
        return [_Files(g) for g in groups]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for uri in partition.files:
            fs, path = store(uri)
            with fs.open_input_file(path) as file:
                try:
                    yield from self._records(_Bytes(file))
                except BrokenArchive as e:
                    if not self.skip_broken:
                        raise BrokenArchive(f"{uri}: {e}") from e

    def _records(self, data: _Bytes) -> Iterator[tuple]:
        while (head := data.head()) is not None:
            h = _fields(head)
            length = _size(h.get("content-length"))
            if length is None:
                raise BrokenArchive("a record has no valid Content-Length")
            plain = lambda k: h[k].strip("<>") if k in h else None
            own = {"record_type": h.get("warc-type"), "record_id": plain("warc-record-id"), "target_uri": h.get("warc-target-uri"), "payload_digest": h["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in h else None}
            if any(own[k] not in v for k, v in self.wanted.items()):
                data.skip(length)
                continue
            n, kind, body, left = length, h.get("content-type"), None, length
            if (kind or "").startswith("application/http") and (http := data.http(length)) is not None:
                inner = _fields(http)
                left -= len(http)
                n, kind = left, inner.get("content-type")
                if own["record_type"] == "revisit":
                    n = _size(inner.get("content-length"))
            if self.payload and own["record_type"] != "revisit":
                body = data.take(left)
            else:
                data.skip(left)
            yield own["record_id"], own["record_type"], own["target_uri"], own["payload_digest"], plain("warc-refers-to"), n, kind, body


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("path", folder).option("payload", "false").load()``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("broken", "fail").lower() == "skip")


def read(spark: SparkSession, folder: str, payload: bool = True, broken: str = "fail") -> DataFrame:
    """The records of all archives in a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).option("broken", broken).load()


def page_records(records: DataFrame, id_name: str = "page_id") -> DataFrame:
    """Per record that ``write`` made: page id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(ID) + 1}), '') AS bigint)")
    return records.select(number("record_id").alias(id_name), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
