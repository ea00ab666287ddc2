"""WARC files as a chunked record table.

read() turns WARC files (plain or gzip, any number of members) into rows of
record_id, chunk_no, start, chunk, digest and last: a record's block is never held
whole. Each task streams one file through a small buffer, emits a row for every CHUNK
bytes of a block, and carries one SHA-1 state a record, so `digest` is the hash of the
block up to the end of that chunk and the last row's digest is that of the block.
write() makes one gzip file (a member for every record) a task; the files of failed or
repeated attempts are never part of the result, which lists what the job committed.

Defined results: a null page or payload counts as an empty block; a record with an empty
block has one row, chunk 0 of 0 bytes. A null url or page_id gives a record without that
header, read back as null. Control characters in header values are percent-encoded.
Rows equal in page_id, url and payload give records of the same record_id, each with its
own rows. A block that ends before its Content-Length has `complete` false in its last
row; bytes between records that start no record are skipped. `valid` in the last row
tells whether the declared block digest agrees (null if none is declared). Damage ends no
job: after a gzip member that can't be read, or bytes after a member that start none,
reading goes on at the next member; the record it cut has `complete` false, and damage
outside of any record gives a row of no bytes without record_id, `complete` false. A
header beyond HEADER_BYTES gives such a row too, and what follows is skipped up to the
next record. A Content-Length that isn't ASCII digits counts as 0. An empty table gives
no files and no rows. Other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import mapped, scratch_path

CHUNK = 1 << 16
BLOCK = 1 << 18
HEADER_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
MEMBER = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


def inflated(blocks: Iterable[bytes]) -> Iterator[bytes | None]:
    """The bytes of a plain or gzip stream, in pieces of at most BLOCK bytes when gzip; None where damaged bytes were left out."""
    blocks = iter(blocks)
    head = b""
    for block in blocks:
        head += block
        if len(head) >= 2:
            break
    if head[:2] != MEMBER[:2]:
        yield head
        yield from blocks
        return
    unpack, data, lost, begun = zlib.decompressobj(31), head, False, True
    while True:
        while data:
            if unpack is None:  # between members: padding, a member, or bytes to skip
                data = data.lstrip(b"\0") if not lost else data
                at = 0 if MEMBER.startswith(data[: len(MEMBER)]) else data.find(MEMBER)
                if data and not lost and at != 0:
                    lost = True
                    yield None
                if len(data) < len(MEMBER) or at < 0:
                    data = data[-(len(MEMBER) - 1) :]
                    break
                unpack, data, lost, begun = zlib.decompressobj(31), data[at:], False, False
            try:
                piece = unpack.decompress(data, BLOCK)
            except zlib.error:
                if not lost:
                    yield None
                # a member that fails at once starts at bytes that only look like one
                unpack, data, lost = None, (data if begun else data[1:]), True
                continue
            begun = True
            if piece:
                yield piece
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, None
        more = next(blocks, None)
        if more is None:
            return
        data += more


class Stream:
    """Lines and byte runs of an iterator of blocks, through one small buffer."""

    def __init__(self, blocks: Iterable[bytes | None]):
        self.blocks, self.data, self.at, self.gap = iter(blocks), b"", 0, False

    def more(self) -> bool:
        """Read on; False at the end, and at a gap until it is passed."""
        block = None if self.gap else next(self.blocks, b"")
        if block is None:
            self.gap = True
        elif block:
            self.data, self.at = self.data[self.at :] + block, 0
            return True
        return False

    def passed(self) -> bool:
        """Whether there was a gap; what was left before it is dropped."""
        had, self.gap = self.gap, False
        if had:
            self.at = len(self.data)
        return had

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the stream or at a gap; ValueError for one beyond HEADER_BYTES, of which that much is dropped."""
        low = 0
        while (stop := self.data.find(b"\n", self.at + low)) < 0:
            low = len(self.data) - self.at
            if low > HEADER_BYTES:
                self.at = len(self.data)
                raise ValueError(f"a header line of more than {HEADER_BYTES} bytes")
            if not self.more():
                rest, self.at = self.data[self.at :], len(self.data)
                return rest or None
        out, self.at = self.data[self.at : stop], stop + 1
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the stream or at a gap."""
        while len(self.data) - self.at < n and self.more():
            pass
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def _headers(stream: Stream) -> dict[str, str] | None:
    """The next record's header; ValueError if it is too long."""
    while True:
        try:
            line = stream.line()
        except ValueError:  # bytes between records
            continue
        if line is None:
            return None
        if line.startswith(b"WARC/"):
            break
    out: dict[str, str] = {}
    size, name = 0, ""
    while line := stream.line():
        size += len(line)
        if size > HEADER_BYTES:
            raise ValueError(f"a record header of more than {HEADER_BYTES} bytes")
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and name:
            out[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


_DAMAGE = ({}, 0, 0, b"", hashlib.sha1().hexdigest(), True, False, None)


def records(blocks: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple]:
    """(headers, chunk_no, start, chunk, digest, last, complete, valid) of every chunk of every record."""
    stream = Stream(inflated(blocks))
    while True:
        try:
            head = _headers(stream)
        except ValueError:
            yield _DAMAGE
            continue
        if head is None:
            if not stream.passed():
                return
            yield _DAMAGE
            continue
        length = head.get("content-length", "0")
        left = int(length) if length.isascii() and length.isdigit() else 0
        state, number, start = hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(chunk, left))
            state.update(data)
            left -= len(data)
            short = (len(data) == 0 and left > 0) or (stream.gap and left == 0 and length == "0" and "content-length" not in head)
            if left == 0 or short:
                declared = head.get("warc-block-digest")
                valid = None if declared is None else declared == f"sha1:{base64.b32encode(state.digest()).decode()}"
                yield head, number, start, data, state.hexdigest(), True, not short, valid
                if short:
                    stream.passed()
                break
            yield head, number, start, data, state.hexdigest(), False, True, None
            number, start = number + 1, start + len(data)


CHUNKS = "file string, record_id string, type string, uri string, page_id string, chunk_no long, start long, chunk binary, digest string, last boolean, complete boolean, valid boolean"
_KINDS = pa.schema([("file", pa.string()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.string()), ("chunk_no", pa.int64()), ("start", pa.int64()), ("chunk", pa.binary()), ("digest", pa.string()), ("last", pa.bool_()), ("complete", pa.bool_()), ("valid", pa.bool_())])


def _blocks(path: str) -> Iterator[bytes]:
    fs, name = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as source:
        while data := source.read(BLOCK):
            yield data


def _reader(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for head, number, start, data, digest, last, complete, valid in records(_blocks(path), chunk):
                    name = head.get("warc-record-id")
                    rows.append((path, name[1:-1] if name and name[0] == "<" else name, head.get("warc-type"), head.get("warc-target-uri"), head.get("x-page-id"), number, start, data, digest, last, complete, valid))
                    size += len(data) + 256
                    if size > BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=_KINDS)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], schema=_KINDS)

    return run


def read_listed(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the files whose URIs are in the one column of paths; one task a file or a few."""
    return mapped(paths.select(F.col(paths.columns[0]).alias("path")), _reader(chunk), CHUNKS)


def read(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of WARC files, given by URI or local path."""
    uris = [p if "://" in p else f"file://{p}" for p in paths]
    return read_listed(spark.createDataFrame([(p,) for p in uris], "path string").repartition(max(len(uris), 1)), chunk)


def _field(value) -> str:
    return _CONTROL.sub(lambda m: quote(m[0]), str(value))


def record(page_id, url, payload: bytes) -> Iterator[bytes]:
    """The bytes of one resource record, in pieces of at most CHUNK bytes of block."""
    view = memoryview(payload)
    block = base64.b32encode(hashlib.sha1(view).digest()).decode()
    key = hashlib.md5(f"{'' if page_id is None else page_id}|{'' if url is None else url}|{block}".encode()).hexdigest()
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(key)}>", f"WARC-Date: {DATE}", "Content-Type: text/html; charset=utf-8", f"WARC-Block-Digest: sha1:{block}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {_field(page_id)}")
    lines.append(f"Content-Length: {len(payload)}")
    yield "\r\n".join([*lines, "", ""]).encode()
    for low in range(0, len(payload), CHUNK):
        yield bytes(view[low : low + CHUNK])
    yield b"\r\n\r\n"


_FILES = "path string, records long, bytes long"


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, fs, path, count, size = None, None, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
        for batch in batches:
            for page_id, url, payload in zip(*(c for c in batch.columns), strict=True):
                if out is None:  # an empty partition makes no file
                    fs, name = pafs.FileSystem.from_uri(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, compression=None)
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                for piece in record(page_id.as_py(), url.as_py(), payload.as_buffer() or b""):
                    data = pack.compress(piece)
                    size += out.write(data) or len(data)
                data = pack.flush()
                size += out.write(data) or len(data)
                count += 1
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([count]), pa.array([size])], ["path", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", payload: str = "html", level: int = 1) -> DataFrame:
    """Write a WARC file a task into folder; path, records and bytes of the files, written there as the table `_files`."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_column).cast("string"), F.col(url).cast("string"), body)
    mapped(rows, _writer(folder, level), _FILES).write.parquet(f"{folder}/_files")
    return pages.sparkSession.read.schema(_FILES).parquet(f"{folder}/_files")


def through_files(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """page_id, record_id, url, chunk_no, start, size, digest, last, valid and payload (base64) of pages written as WARC and read again."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    files = write(pages, folder)
    n = files.count()
    rows = read_listed(files.select("path").repartition(max(n, 1), "path"), chunk)
    return rows.select(
        F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "record_id", F.col("uri").alias("url"),
        "chunk_no", "start", F.octet_length("chunk").cast("long").alias("size"), "digest", "last", "valid", F.translate(F.base64("chunk"), "\r\n", "").alias("payload"),
    )


def payloads(chunks: DataFrame) -> DataFrame:
    """file, record_id and payload of records that fit a row, their chunks joined in order; larger ones are to be used chunk by chunk."""
    grouped = chunks.groupBy("file", "record_id").agg(F.array_sort(F.collect_set(F.struct("start", "chunk"))).alias("c"))
    return grouped.select("file", "record_id", F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["chunk"])), "")).alias("payload"))


def sql(table: str = "pages", chunk: int = CHUNK) -> str:
    """DuckDB SQL for through_files() on pages without nulls or control characters in urls."""
    return f"""
WITH p AS (SELECT page_id, url, encode(html) AS b, unhex(sha1(encode(html))) AS d FROM {table}),
bits AS (SELECT page_id, url, b, list_aggregate(list_transform(range(0, 20), lambda i: lpad(bin(('0x' || substr(hex(d), i * 2 + 1, 2))::INT), 8, '0')), 'string_agg', '') AS s FROM p),
k AS (SELECT page_id, url, b, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(s, i * 5 + j + 1, 1) = '1' THEN (16 >> j) ELSE 0 END))::INT + 1, 1)), 'string_agg', '') AS block FROM bits),
r AS (SELECT page_id, url, b, md5(page_id::VARCHAR || '|' || url || '|' || block) AS m, octet_length(b) AS n FROM k),
c AS (SELECT *, unnest(range(0, greatest(CAST(ceil(n / {chunk}) AS BIGINT), 1))) AS chunk_no FROM r)
SELECT page_id, 'urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS record_id, url,
  CAST(chunk_no AS BIGINT) AS chunk_no, CAST(chunk_no * {chunk} AS BIGINT) AS start, CAST(least({chunk}, n - chunk_no * {chunk}) AS BIGINT) AS size,
  sha1(b[1 : least(n, (chunk_no + 1) * {chunk})]) AS digest, (chunk_no + 1) * {chunk} >= n AS last,
  CASE WHEN (chunk_no + 1) * {chunk} >= n THEN true END AS valid, to_base64(b[chunk_no * {chunk} + 1 : least(n, (chunk_no + 1) * {chunk})]) AS payload
FROM c"""
