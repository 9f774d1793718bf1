"""Web archives with a two-level capture index.

Writing: each task appends its pages as records to an archive of its own in a
folder all executors share; each record is a gzip member, so it can be read by
its offset and length. Of equal payloads of at least ``least_bytes`` bytes, the
page with the largest ID is written whole, the others as revisits of it.

Indexing: captures are range-sorted by key (host labels reversed, then the rest of
the address, then the page ID). Each range becomes an index file of compressed
blocks of lines, followed by a sparse directory with the first key, offset and
length of every block.

Reading: a key goes to the file of its range (their first keys are broadcast, one
per file), the directory tells the block by binary search, the block is read by
its range and searched, and so is the record in its archive.

A task that is run again writes new files under new names; only files named in the
table of a finished write are ever read, so lost executors cost time only.

Defined results: a null payload is empty; a null address has an empty key; pages
of equal ID and payload are equal records, and each is found; where several pages
hold the largest ID of a payload, each is written whole; a null ID is smaller than
all and its revisits refer to the largest; an empty table gives no archive. Only
the named columns are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, scratch_path, ship

LEAST_BYTES = 1000
#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 1 << 30
#: Lines of an index block.
BLOCK_LINES = 1000
LEVEL = 4
#: Payload digests that occur more than once may be broadcast up to this number (some 50 bytes each).
BROADCAST_DIGESTS = 200_000
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper half of a record's UUID; the lower half is the page ID.
_SPACE = 0x7C1E9A52D3B04F6A
_END = b"\r\n"

ENTRY = "key string, page_id bigint, archive string, offset bigint, length bigint"
RECORD = (
    "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, "
    "refers_to bigint, payload binary"
)


def filesystem(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return files.LocalFileSystem(), path
    return files.FileSystem.from_uri(path)


def search_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, rest of the address, page ID."""
    rest = (url or "").strip().partition("#")[0]
    if "://" in rest:
        rest = rest.partition("://")[2]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    name = ",".join(reversed(host.split("."))) if host else ""
    return f"{name}){slash}{path} {'-' if page_id is None else page_id}".replace("\n", "%0A").replace("\t", "%09")


def record_id(page_id: int | None) -> str:
    low = 1 << 63 if page_id is None else page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=_SPACE << 64 | low)}>"


def page_of(record: str) -> int | None:
    low = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    return None if low == 1 << 63 else low - (low >> 63 << 64)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # White space and control characters cannot stand in a header.
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + 2 * _END + block + 2 * _END


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = data.partition(2 * _END)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(2 * _END)
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_digest": digest,
        "payload_bytes": size,
        "refers_to": page_of(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _squeeze(data: bytes) -> bytes:
    """One gzip member."""
    worker = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return worker.compress(data) + worker.flush()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, keeper in zip(*batch.columns, strict=True):
                    page_id, url, keeper = page_id.as_py(), url.as_py(), keeper.as_py()
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    revisit = keeper is not None and keeper != page_id
                    data = _squeeze(build_record(page_id, url, payload, keeper, revisit))
                    out.write(data)
                    rows.append((search_key(url, page_id), page_id, name, offset, len(data)))
                    offset += len(data)
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield _batch(rows, ["key", "page_id", "archive", "offset", "length"], kinds)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, *, row_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write a record for each page; returns the table of captures ``(key, page_id, archive, offset, length)``."""
    ship(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(row_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"),
                        F.when(F.octet_length(payload) >= least_bytes, F.sha1(payload)).alias("digest"))
    repeated = cut(
        rows.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "keeper")
    )
    few = repeated.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    return cut(rows.select("page_id", "url", "html", "keeper").mapInArrow(_write(folder), ENTRY))


def _index(folder: str):
    """Write the lines of a range as one index file; returns its first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        out, name, offset = None, f"captures-{uuid.uuid4().hex}.idx", 0

        def block(ready: list[str]) -> None:
            nonlocal out, offset
            if out is None:
                system.create_dir(root, recursive=True)
                out = system.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(ready).encode(), LEVEL)
            out.write(data)
            directory.append((ready[0].split("\t")[0], offset, len(data)))
            offset += len(data)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "archive", "offset", "length")]
            for row in zip(*columns, strict=True):
                lines.append("\t".join(map(str, row)))
                if len(lines) >= BLOCK_LINES:
                    block(lines)
                    lines = []
        if lines:
            block(lines)
        rows = []
        if out is not None:
            tail = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            rows.append((name, directory[0][0]))
        yield _batch(rows, ["file", "first_key"], [pa.string(), pa.string()])

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the two-level index; returns ``(file, first_key)``, one row per range."""
    ordered = captures.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return cut(ordered.mapInArrow(_index(folder), "file string, first_key string"))


class IndexFile:
    """One index file, read by ranges."""

    def __init__(self, system: files.FileSystem, path: str):
        self.source = system.open_input_file(path)
        size = self.source.size()
        tail = int.from_bytes(self._range(size - 8, 8), "little")
        self.directory = json.loads(zlib.decompress(self._range(size - 8 - tail, tail)))
        self.firsts = [d[0] for d in self.directory]
        self.held, self.keys, self.lines = -1, [], []

    def _range(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _open(self, number: int) -> None:
        if number != self.held:
            _, offset, length = self.directory[number]
            self.lines = zlib.decompress(self._range(offset, length)).decode().split("\n")
            self.keys = [line.split("\t", 1)[0] for line in self.lines]
            self.held = number

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Archive, offset and length of all captures of a key."""
        found = []
        number = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while number < len(self.directory) and self.firsts[number] <= key:
            self._open(number)
            at = bisect.bisect_left(self.keys, key)
            while at < len(self.keys) and self.keys[at] == key:
                archive, offset, length = self.lines[at].split("\t")[1:]
                found.append((archive, int(offset), int(length)))
                at += 1
            if at < len(self.keys):
                break
            number += 1
        return found


def _read(archives: str, index: str, shared, keep_payload: bool):
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(archives)
        opened: dict[str, pa.NativeFile] = {}
        number, current = -1, None
        for batch in batches:
            rows, size = [], 0
            for part, key in zip(batch.column("part").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if part != number:
                    folder, base = filesystem(index)
                    number, current = part, IndexFile(folder, f"{base}/{shared.value[part]}")
                for archive, offset, length in current.find(key):
                    if archive not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        opened[archive] = system.open_input_file(f"{root}/{archive}")
                    opened[archive].seek(offset)
                    record = parse_record(zlib.decompress(opened[archive].read(length), 31))
                    if not keep_payload:
                        record["payload"] = None
                    size += len(record["payload"] or b"")
                    rows.append(tuple(record[n] for n in names))
                    if size > 8 << 20:
                        yield _batch(rows, names, kinds)
                        rows, size = [], 0
            yield _batch(rows, names, kinds)

    return run


def _route(shared):
    """The index file of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = shared.value
        for batch in batches:
            keys = [search_key(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            # Equal keys may run over the end of a file: begin with the first that can hold one.
            rows = []
            for key in keys:
                part = max(0, bisect.bisect_left(firsts, key) - 1)
                while part < len(firsts) and firsts[part] <= key:
                    rows.append((part, key))
                    part += 1
            yield _batch(rows, ["part", "key"], [pa.int32(), pa.string()])

    return run


def look_up(
    wanted: DataFrame, archives: str, index: str, ranges: DataFrame, *, row_id: str = "page_id", url: str = "url",
    keep_payload: bool = True,
) -> DataFrame:
    """Records of all captures of the pages in ``wanted``, through the index; repeated requests count once."""
    spark = wanted.sparkSession
    ship(spark)
    # One row per index file.
    listed = sorted((r["first_key"], r["file"]) for r in ranges.collect())
    if not listed:
        return spark.createDataFrame([], RECORD)
    sc = spark.sparkContext
    firsts, names = sc.broadcast([f for f, _ in listed]), sc.broadcast([n for _, n in listed])
    asked = wanted.select(F.col(url).alias("url"), F.col(row_id).cast("bigint").alias("page_id"))
    keys = asked.mapInArrow(_route(firsts), "part int, key string").distinct()
    dealt = keys.repartitionById(len(listed), F.col("part")).sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_read(archives, index, names, keep_payload), RECORD)


def round_trip(
    pages: DataFrame, *, row_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None,
    keep_payload: bool = True,
) -> DataFrame:
    """Write all pages, index them, and read every record back by its key."""
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archives", row_id=row_id, url=url, html=html)
    ranges = write_index(captures, f"{folder}/index")
    return look_up(pages, f"{folder}/archives", f"{folder}/index", ranges, row_id=row_id, url=url, keep_payload=keep_payload)
