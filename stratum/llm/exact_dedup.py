"""Exact dedup by composable polynomial fingerprints.

The fingerprint of bytes b_0 .. b_(n-1) is sum((b_i + 1) * B**i) modulo a prime, for two
primes. Fingerprints compose: F(xy) = F(x) + B**len(x) * F(y). A text is hashed in
chunks and the chunk hashes are combined by that length-shifted sum; texts beyond
HUGE_BYTES are split into chunk rows that different tasks hash. Rows with the same
fingerprint and length are candidates; their texts are compared chunk by chunk: equal
chunks collapse in a map-side hash aggregate on the chunk's own bytes, so a hot group
of copies shuffles one chunk per task. A fingerprint whose chunks differ anywhere (a
collision) is resolved by grouping those rows on the whole text.

mark(df) returns a row per input row: doc_id, first_id (least doc_id with this text),
copies (rows with this text) and is_copy (false for one row of each text).

Defined results: a null text counts as empty, and all empty texts are copies of each
other; a null doc_id sorts last, so it is first_id only if the whole group is null;
rows equal in doc_id and text are copies too, all but one marked. An empty table gives
an empty table. Other columns take no part and may have any name. Rows are told apart by
row_key, the SHA-256 of doc_id and text; no row is dropped on a shorter hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._io import fresh, identity, mapped, materialise, sized

PRIMES = (2147483647, 2147483629)
BASES = (1000003337, 1540483477)
CHUNK = 1 << 16
HUGE_BYTES = 32 << 20


def _tables(primes) -> list[np.ndarray]:
    out = []
    for base, p in zip(BASES, primes, strict=True):
        table, at = np.ones(CHUNK + 1, np.uint64), 1
        step = np.uint64(base % p)
        while at <= CHUNK:  # doubling: table[at : 2 at] = table[:at] * B**at
            shift = np.uint64(int(table[at - 1]) * int(step) % p)
            width = min(at, CHUNK + 1 - at)
            table[at : at + width] = table[:width] * shift % np.uint64(p)
            at += width
        out.append(table)
    return out


def chunk_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, primes=PRIMES, tables=None) -> np.ndarray:
    """One hash a prime for every chunk [start, end) of at most CHUNK bytes; chunks are sorted, not empty and without gaps."""
    tables = tables or _tables(primes)
    out = np.zeros((len(primes), len(starts)), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
        low = starts[at]
        values = raw[low : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(values)) - np.repeat(starts[at:to] - low, ends[at:to] - starts[at:to])
        for i, (p, table) in enumerate(zip(primes, tables, strict=True)):
            out[i, at:to] = np.add.reduceat(values * table[place], starts[at:to] - low) % np.uint64(p)
        at = to
    return out


def fingerprints(raw: np.ndarray, offsets: np.ndarray, primes=PRIMES, tables=None) -> np.ndarray:
    """One fingerprint a prime for every text, combined from its chunks."""
    tables = tables or _tables(primes)
    sizes = np.diff(offsets)
    counts = -(-sizes // CHUNK)
    out = np.zeros((len(primes), len(sizes)), np.uint64)
    if not counts.sum():
        return out
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + number * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[1:][owner])
    hashes = chunk_hashes(raw, starts, ends, primes, tables)
    most = int(counts.max())
    for i, (p, table) in enumerate(zip(primes, tables, strict=True)):
        shift, shifts = int(table[CHUNK]), [1]
        while len(shifts) < most:
            shifts.append(shifts[-1] * shift % p)
        moved = hashes[i] * np.array(shifts, np.uint64)[number] % np.uint64(p)
        # at most 2**32 chunks of less than 2**31 each: the sum fits
        out[i][counts > 0] = np.add.reduceat(moved, (np.cumsum(counts) - counts)[counts > 0]) % np.uint64(p)
    return out


def _print_texts(primes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(primes)
        for batch in batches:
            for a, b in T.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                raw, offsets = T.buffers(part.column(2))
                prints = fingerprints(raw, offsets, primes, tables)
                yield pa.record_batch(
                    [part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in prints), pa.array(np.diff(offsets))],
                    ["doc_id", "row_key", "h1", "h2", "n_bytes"],
                )

    return run


def _split_texts(keys: int):
    """Rows of (the first `keys` columns, chunk_no, chunk) from rows whose last column is the text; an empty text has no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(keys), 8 << 20):
                part = batch.slice(a, b - a)
                raw, offsets = T.buffers(part.column(keys))
                counts = -(-np.diff(offsets) // CHUNK)
                owner = np.repeat(np.arange(len(counts)), counts)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                bounds = np.r_[offsets[:-1][owner] + number * CHUNK, offsets[-1]]
                for low in range(0, len(owner), 128):
                    high = min(low + 128, len(owner))
                    data = raw[bounds[low] : bounds[high]].tobytes()
                    chunk = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((bounds[low : high + 1] - bounds[low]).astype(np.int32)), pa.py_buffer(data)])
                    taken = [c.take(pa.array(owner[low:high])) for c in part.columns[:keys]]
                    yield pa.record_batch([*taken, pa.array(number[low:high]), chunk], [*part.schema.names[:keys], "chunk_no", "chunk"])

    return run


def _print_chunks(primes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(primes)
        for batch in batches:
            raw, offsets = T.buffers(batch.column(3))
            hashes = chunk_hashes(raw, offsets[:-1], offsets[1:], primes, tables)
            yield pa.record_batch([*batch.columns[:3], *(pa.array(x.astype(np.int64)) for x in hashes), pa.array(np.diff(offsets))], ["doc_id", "row_key", "chunk_no", "h1", "h2", "size"])

    return run


def printed(df: DataFrame, primes=PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """doc_id, row_key, h1, h2, n_bytes of every row."""
    rows = df.select("doc_id", identity().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    small = mapped(rows.where(F.octet_length("text") <= huge), _print_texts(primes), f"{_id(df)}, row_key binary, h1 long, h2 long, n_bytes long")
    chunks = mapped(rows.where(F.octet_length("text") > huge), _split_texts(2), f"{_id(df)}, row_key binary, chunk_no long, chunk binary")
    hashed = mapped(chunks.repartition("row_key", "chunk_no"), _print_chunks(primes), f"{_id(df)}, row_key binary, chunk_no long, h1 long, h2 long, size long")
    # rows equal in doc_id and text give equal chunk rows: divide their number out, then fold high chunks first
    distinct = hashed.groupBy("doc_id", "row_key", "chunk_no").agg(F.count("*").alias("times"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("size").alias("size"))
    folded = distinct.groupBy("doc_id", "row_key").agg(F.max("times").alias("times"), F.sum("size").alias("n_bytes"), F.reverse(F.array_sort(F.collect_list(F.struct("chunk_no", "h1", "h2")))).alias("c"))
    shift = [pow(b, CHUNK, p) for b, p in zip(BASES, primes, strict=True)]
    fold = lambda name, i: F.aggregate("c", F.lit(0).cast("long"), lambda acc, c: (acc * shift[i] + c[name]) % primes[i])
    large = folded.select("doc_id", "row_key", fold("h1", 0).alias("h1"), fold("h2", 1).alias("h2"), "n_bytes", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).drop("time")
    return small.unionByName(large)


def _id(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def mark(df: DataFrame, primes=PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """doc_id, row_key, first_id, copies, nth and is_copy of every row; see the module's text."""
    prints = materialise(printed(df, primes, huge), "fingerprints")
    same = ["h1", "h2", "n_bytes"]
    groups = materialise(prints.groupBy(same).agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("keys")).where("keys > 1"), "candidates")
    wanted = materialise(prints.join(groups.select(same), same, "left_semi").select("row_key", *same).distinct(), "wanted")
    texts = df.select(identity().alias("row_key"), "text").join(sized(wanted), "row_key").select(*same, "text")
    chunks = mapped(texts, _split_texts(3), "h1 long, h2 long, n_bytes long, chunk_no long, chunk binary")
    contents = chunks.groupBy(*same, "chunk_no", "chunk").agg(F.lit(1).alias("one"))
    collided = materialise(contents.groupBy(*same, "chunk_no").agg(F.count("*").alias("n")).where("n > 1").select(same).distinct(), "collided")
    order = Window.partitionBy(*same, "part").orderBy(F.col("doc_id").asc_nulls_last())
    whole = Window.partitionBy(*same, "part")
    rows = prints.withColumn("part", F.lit(None).cast("string"))
    if not collided.isEmpty():
        keys = prints.join(sized(collided), same, "left_semi").select("row_key").distinct()
        parts = df.select(identity().alias("row_key"), F.coalesce("text", F.lit("")).alias("part")).join(keys, "row_key", "left_semi").distinct()
        rows = prints.join(parts, "row_key", "left")
    return rows.select(
        "doc_id", "row_key",
        F.min("doc_id").over(whole).alias("first_id"),
        F.count("*").over(whole).alias("copies"),
        F.row_number().over(order).alias("nth"),
    ).withColumn("is_copy", F.col("nth") > 1)


def report(df: DataFrame) -> DataFrame:
    """doc_id, first_id, copies, is_copy of every row."""
    return mark(df).select("doc_id", "first_id", "copies", "is_copy")


def without_copies(df: DataFrame, primes=PRIMES, huge: int = HUGE_BYTES) -> DataFrame:
    """The rows of df without copies: of each text the row of least doc_id, with the columns of df."""
    copies = materialise(mark(df, primes, huge).where("is_copy").select("doc_id", "row_key", "first_id"), "copies")
    (key,) = fresh(df, "__key")
    keyed = df.withColumn(key, identity())
    again = copies.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("row_key").alias(key)).distinct()
    away = copies.where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("row_key").alias(key))
    kept = keyed.join(sized(away), key, "left_anti")
    if not again.isEmpty():  # rows equal in doc_id and text
        again = sized(again)
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*(F.col(f"`{c}`") for c in df.columns))


def sql(table: str = "documents") -> str:
    """DuckDB SQL for report() on a table without null doc_ids."""
    return f"""
SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS is_copy
FROM {table} WINDOW w AS (PARTITION BY coalesce(text, ''))"""
