"""WARC archives with revisit records, and a two-level capture index over them.

Each record is a gzip member of its own, so a record can be read by its range. The index sorts lines by reversed-host
URL key and page into compressed blocks; a sparse directory, sorted too, keeps the first key and page and the range of each block.
A look-up binary-searches the directory, then the block, and then reads the records' ranges in order of archive and
offset, near ones together.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import common

#: Bytes after which a task begins another archive.
FILE_BYTES = 32_000_000
BLOCK_LINES = 2000
#: Ranges of an archive that are no further apart are read at once, up to so many bytes.
NEAR_BYTES, READ_BYTES = 65_536, 4_000_000
#: Records that are read, parsed and returned together.
BATCH_RECORDS = 512
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ID = re.compile(r"<urn:page:(-?\d+)>")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.a.example.com/x?y becomes com,example,a)/x?y. No URL: empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    default = {"http": 80, "https": 443}.get(parts.scheme)
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, n_bytes: int, digest: str, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record; without a payload it revisits the record refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def parse(content: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (None for a revisit) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    own, other = _ID.fullmatch(fields["WARC-Record-ID"]), _ID.fullmatch(fields.get("WARC-Refers-To", ""))
    out = {"page_id": int(own[1]) if own else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": int(other[1]) if other else None, "payload_bytes": n_bytes}
    if fields["WARC-Type"] == "response":
        if len(payload) != n_bytes:
            raise ValueError("a payload is cut short")
        return out | {"payload": payload, "payload_digest": payload_digest(payload)}
    return out | {"payload": None, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}


def write_archives(pages: DataFrame, folder: str, dedup_bytes: int = 0) -> DataFrame:
    """Write a record for every row and return the capture lines: key, page_id, path, offset, length.

    Of rows with equal payloads of at least dedup_bytes bytes, that with the largest page_id is the response and the
    others revisit it; rows that repeat the response's page_id are responses too. Null html is an empty payload; a
    null page_id is a response unless a row with an id holds its payload; a null url has an empty key. Other columns are
    ignored; an empty table writes nothing. Files are named by attempt, and only those of committed attempts are in the result.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html")).withColumn("n_bytes", F.octet_length("html"))
    same = rows.filter(F.col("n_bytes") >= dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n"))
    # stored and merged at every size, so that a payload with very many pages can be split between tasks
    first = common.stored(same.filter("n > 1").select("digest", "response"), "payloads").hint("merge")
    joined = rows.join(first, "digest", "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    ready = joined.select("page_id", "url", "digest", "n_bytes", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, F.col("response")).alias("refers_to"))

    def write(batches):
        held: list[bytes] = []
        lines: list[tuple] = []
        size, path = 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"

        def close():
            nonlocal held, lines, size, path
            common.write_file(path, b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), kinds, strict=True)], names=names)
            held, lines, size, path = [], [], 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
            return out

        for batch in common.slices(batches, 128):
            for page, url, digest, n_bytes, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = base64.b32encode(bytes.fromhex(digest)).decode()
                member = gzip.compress(record(page, url, n_bytes, coded, None if html is None else html.encode(), refers_to), 4, mtime=0)
                lines.append((url_key(url), page, path, size, len(member)))
                held.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    names, kinds = ["key", "page_id", "path", "offset", "length"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return ready.mapInArrow(write, "key string, page_id long, path string, offset long, length long")


def build_index(lines: DataFrame, folder: str) -> DataFrame:
    """Sort capture lines by key and page into compressed blocks and return the directory: first_key, first_page, path, offset, length, n_lines."""

    def write(batches):
        path, held, size = f"{folder}/{uuid.uuid4().hex}.idx", [], 0
        entries: list[tuple] = []
        waiting: list[tuple] = []

        def close():
            nonlocal waiting, size
            block = zlib.compress("\n".join(map(json.dumps, waiting)).encode(), 6)
            entries.append((waiting[0][0], waiting[0][1], path, size, len(block), len(waiting)))
            held.append(block)
            size += len(block)
            waiting = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                if len(waiting) >= BLOCK_LINES:
                    close()
        if waiting:
            close()
        if held:
            common.write_file(path, b"".join(held))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries, strict=True), kinds, strict=True)], names=names)

    names, kinds = ["first_key", "first_page", "path", "offset", "length", "n_lines"], [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    ordered = lines.repartitionByRange(common.task_count(lines.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(write, "first_key string, first_page long, path string, offset long, length long, n_lines long")


class _Ranges:
    """Ranges of files, with some files kept open."""

    def __init__(self, most: int = 64):
        self.open, self.most = {}, most

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, at = common.file_at(path)
            self.open[path] = system.open_input_file(at)
        return self.open[path].read_at(length, offset)


def block_lines(files: _Ranges, path: str, offset: int, length: int) -> list[list]:
    """The block's capture lines in order of key and page: key, page_id, path, offset, length."""
    return [json.loads(x) for x in zlib.decompress(files.read(path, offset, length)).decode().split("\n")]


def _place(key: str, page: int | None) -> tuple:
    """Orders lines as Spark does: by key, then page, null pages first."""
    return key, page is not None, page or 0


class Index:
    """The stored directory and its blocks; of the directory only the part for the keys in question is held."""

    def __init__(self, paths: list[str]):
        self.paths, self.files = paths, _Ranges()
        self.entries: list[tuple] = []
        self.starts: list[tuple] = []
        self.cached: tuple | None = None

    def open(self, low: str, high: str) -> None:
        """Hold the directory's entries for the keys from low to high, and the one before them."""
        entries, before = [], None
        for uri in self.paths:
            system, path = common.file_at(uri)
            with system.open_input_file(path) as source:
                parquet = pq.ParquetFile(source)
                for n in range(parquet.num_row_groups):
                    stats = parquet.metadata.row_group(n).column(0).statistics
                    if stats is not None and stats.has_min_max and stats.min > high:
                        continue
                    rows = parquet.read_row_group(n, ["first_key", "first_page", "path", "offset", "length"]).to_pydict()
                    for row in zip(*rows.values(), strict=True):
                        if row[0] < low:
                            before = row if before is None or _place(*row[:2]) > _place(*before[:2]) else before
                        elif row[0] <= high:
                            entries.append(row)
        self.entries = sorted([*entries, *([before] if before else [])], key=lambda e: _place(*e[:2]))
        self.starts = [_place(*e[:2]) for e in self.entries]

    def _lines(self, at: int) -> list[list]:
        if self.cached is None or self.cached[0] != self.entries[at]:
            self.cached = (self.entries[at], block_lines(self.files, *self.entries[at][2:]))
        return self.cached[1]

    def captures(self, key: str, page: int | None = None, every: bool = False) -> Iterator[tuple[str, int, int]]:
        """Path, offset and length of the key's captures of a page (every: of all its pages)."""
        first = (key,) if every else _place(key, page)
        at = max(0, bisect.bisect_left(self.starts, first) - 1)
        while at < len(self.entries):
            lines = self._lines(at)
            k = bisect.bisect_left(lines, first, key=lambda x: _place(*x[:2]))
            while k < len(lines):
                if lines[k][0] != key or not (every or lines[k][1] == page):
                    return
                yield tuple(lines[k][2:])
                k += 1
            at += 1


def read_records(files: _Ranges, captures: list[tuple[str, int, int]]) -> Iterator[dict]:
    """The records at the ranges, in order of archive and offset; near ranges are read at once."""
    captures = sorted(captures)
    low = 0
    while low < len(captures):
        path, start, _ = captures[low]
        high, stop = low, start
        while high < len(captures) and captures[high][0] == path and captures[high][1] - stop <= NEAR_BYTES and (high == low or captures[high][1] + captures[high][2] - start <= READ_BYTES):
            stop = max(stop, captures[high][1] + captures[high][2])
            high += 1
        content = memoryview(files.read(path, start, stop - start))
        for _, offset, length in captures[low:high]:
            yield parse(gzip.decompress(content[offset - start : offset - start + length]))
        low = high


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_KINDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def _record_rows(files: _Ranges, captures: list[tuple[str, int, int]], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(captures), BATCH_RECORDS):
        found = list(read_records(files, captures[low : low + BATCH_RECORDS]))
        yield pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and not with_payload else f[n] for f in found], t) for n, t in _KINDS.items()], names=list(_KINDS))


def read_archives(directory: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record, block after block."""

    def read(batches):
        files = _Ranges()
        for batch in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _record_rows(files, [tuple(x[2:]) for x in block_lines(files, path, offset, length)], with_payload)

    blocks = directory.select("path", "offset", "length").repartition(common.task_count(directory.sparkSession), "path", "offset")
    return blocks.mapInArrow(read, _RECORD)


def look_up(directory: DataFrame, wanted: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the wanted pages (page_id, url): for each distinct pair all its records, however often it is asked for.

    Look-ups are sorted like the index, so a task searches neighbouring blocks, and a URL with very many pages is
    dealt to several tasks. directory is the stored one, whose files the tasks search.
    """
    paths = directory.inputFiles()

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page_id"])

    def read(batches):
        index, last = Index(paths), None
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if not pairs:
                continue
            index.open(pairs[0][0], pairs[-1][0])
            waiting: list[tuple[str, int, int]] = []
            for pair in pairs:
                if pair != last:
                    waiting += index.captures(*pair)
                last = pair
                if len(waiting) >= BATCH_RECORDS * 4:
                    yield from _record_rows(index.files, waiting, with_payload)
                    waiting = []
            yield from _record_rows(index.files, waiting, with_payload)

    lookups = wanted.select("page_id", "url").mapInArrow(keys, "key string, page_id long")
    lookups = lookups.repartitionByRange(common.task_count(wanted.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return lookups.mapInArrow(read, _RECORD)


def find(directory: DataFrame, url: str) -> list[dict]:
    """The records captured for a URL."""
    key = url_key(url)
    index = Index(directory.inputFiles())
    index.open(key, key)
    return list(read_records(index.files, list(index.captures(key, every=True))))


def archive(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """Write archives and index into the shared folder; the result is the stored directory, sorted."""
    spark = pages.sparkSession
    lines = common.stored(write_archives(pages, common.fresh_dir(spark, "warc"), dedup_bytes), "captures")
    entries = common.stored(build_index(lines, common.fresh_dir(spark, "warc-index")), "index-blocks")
    return common.stored(entries.orderBy("first_key", "first_page"), "directory")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, and every page looked up in them. Nulls, long payloads, ties, repeated rows, empty tables and extra columns: as write_archives states."""
    pages = common.table(spark, sf_dir, "pages")
    return look_up(archive(pages), pages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
