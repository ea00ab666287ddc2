"""N-gram Jaccard join: documents whose word n-gram sets have a Jaccard index of at least a threshold.

The document by n-gram incidence matrix is multiplied with its transpose in blocks:

1. A first pass names the n-gram set of every row by a 96-bit fingerprint (of two wrapping
   sums of mixed hashes); the table of these, a few words a row, is written. Sets with
   very many rows are known from it, and only one row of each goes on.
2. The second pass sends every column block of the matrix as a few packed binary rows a
   slice of text. In a block, rows of one fingerprint collapse to one and columns with a
   single entry go: they add to no overlap. Columns with more entries than HOT_ROWS, if
   there can be any, are found by counting beforehand and skip the block: their entries
   go straight to their rows, so no task holds a hot column.
3. By row, the remaining entries bound the overlap with any other row. Rows with fewer
   than t * size of them reach no partner and are discarded; rows with equal entries and
   size act alike and are multiplied once, with a weight (documents that share boilerplate
   only are such).
4. With columns ordered by rarity, two rows that reach the threshold share one of the
   first size - ceil(t * size) + 1 columns of each. If the i-th is the first that they
   share, their overlap is at most what is left from there, which bounds the size of the
   partner. Only rows that this leaves a partner in a column are linked; linked rows
   form row blocks.
5. Each row block is multiplied densely in column strips, adding up overlap counts; pairs
   below the threshold for their sizes are discarded. Row blocks of more than TILE rows
   are cut by size, and tiles whose sizes and entries rule out every pair don't meet.

report() has a row for every row of the input: doc_id, class_id (the least doc_id that a
chain of links and equal sets leads to), links (how many other n-gram sets reach the
threshold with this one's) and copies (rows with this set). It is exact but for ties of
96-bit fingerprints and of 40-bit hashes inside a column block (about two in a million
entries). No document, partner or candidate is capped. Where many different rows share
rare columns without being similar, step 5 can still take time by the square of their
number.

Defined results: doc_id has any type with an order. n-grams are of lower-cased words; a
text of fewer than n words has a single n-gram, the whole of it; null, empty and blank
texts have none: their class is their own doc_id, without links and one copy. Null
doc_ids count last: class_id is null only if the whole class is. Repeated rows are rows
each. An empty table gives an empty table. Other columns take no part and may have any
name. one_of_each() keeps of each class the row of least doc_id (then least row identity;
rows equal in doc_id and text stay or go together) and every row without n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fresh, identity, mapped, materialise, remove, scratch_path, ship, sized

N = 5
THRESHOLD = 0.45
SLICE = 6 << 20
BLOCK_ENTRIES = 2_000_000
TILE = 2048
STRIP = 4096
#: Columns with more entries than this, or than a 2**22th of all entries, skip the column blocks; sets with more rows than FREQUENT, or than a MANYth of all rows, go on as one row.
HOT_ROWS, HOT_COLUMNS, FREQUENT, MANY, KEPT = 1 << 20, 1 << 22, 64, 200_000, 1 << 21
LOW = np.uint64(2**40 - 1)
A, B = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def needed(t: float, size: np.ndarray) -> np.ndarray:
    """The least overlap that a set of this size needs with any partner."""
    return np.ceil(t * np.asarray(size, np.float64) - 1e-9).astype(np.int64)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of the texts of a column, and the index of their text, in the order of the texts."""
    raw, offsets = T.buffers(pc.utf8_lower(column))
    starts, ends, owner = T.words(raw, offsets)
    return T.distinct(*T.ngrams(T.span_hashes(raw, starts, ends), owner, n))


def _prints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each run of values, of 64 and of 32 bits."""
    return np.add.reduceat(T.mix(values ^ A), first), np.add.reduceat(T.mix(values ^ B), first) >> np.uint64(32)


def _same(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair comes first, and the number of its pair for every entry."""
    order = np.lexsort((lo, hi))
    a, b = hi[order], lo[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    label = np.empty(len(hi), np.int64)
    label[order] = np.cumsum(new) - 1
    return order[new], label


def _sets(n: int):
    """doc_id, row_key, hi, lo and size of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in T.slices(batch.column(2), SLICE):
                grams, owner = gram_sets(batch.column(2).slice(a, b - a), n)
                size, hi, lo = np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                if len(grams):
                    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    size[owner[first]] = np.diff(np.r_[first, len(owner)])
                    hi[owner[first]], lo[owner[first]] = _prints(grams, first)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x.view(np.int64)) for x in (hi, lo)), pa.array(size)], ["doc_id", "row_key", "hi", "lo", "size"])

    return run


def _heavy(n: int, share: float):
    """Of a partition, n-grams that may have half that share of its entries, with an upper bound of their number: all but KEPT counters are dropped by lowering all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times, dropped, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for a, b in T.slices(batch.column(0), SLICE):
                grams, count = np.unique(gram_sets(batch.column(0).slice(a, b - a), n)[0], return_counts=True)
                total += int(count.sum())
                both, at = np.unique(np.r_[known, grams], return_inverse=True)
                known, times = both, np.bincount(at, weights=np.r_[times, count], minlength=len(both)).astype(np.int64)
                if len(known) > KEPT:
                    edge = int(np.partition(times, len(times) - KEPT - 1)[len(times) - KEPT - 1])
                    known, times, dropped = known[times > edge], times[times > edge] - edge, dropped + edge
        some = times + dropped >= total * share / 2
        known, times = known[some], times[some] + dropped
        for a in range(0, len(known), 100_000):
            yield pa.record_batch([pa.array(known[a : a + 100_000].view(np.int64)), pa.array(times[a : a + 100_000])], ["gram", "n"])

    return run


def hot_columns(texts: DataFrame, n: int, entries: int) -> np.ndarray:
    """The sorted n-grams that may have more entries than a column block should hold; 2 * HOT_COLUMNS at most."""
    least = max(HOT_ROWS, entries / HOT_COLUMNS)
    found = mapped(texts, _heavy(n, least / max(entries, 1)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 2)
    return np.sort(np.asarray(found.select("gram").toArrow().column("gram"), np.int64).view(np.uint64))


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Names of sets in twelve bytes each."""
    out = np.empty((len(hi), 3), np.uint32)
    out[:, :2], out[:, 2] = hi.astype(np.uint64).view(np.uint32).reshape(-1, 2), lo
    return out


def _few(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each where they fit."""
    return counts.astype(np.uint16 if counts.max(initial=0) < 65536 else np.uint32)


def _joined_counts(table: pa.Table) -> np.ndarray:
    """The counts of all packed rows; their width follows from the number of sets."""
    out = [np.frombuffer(c.as_buffer(), np.uint16 if c.as_buffer().size * 6 == s.as_buffer().size else np.uint32) for c, s in zip(table.column("counts"), table.column("sets"), strict=True)]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


_INCIDENCE = "block long, sets binary, counts binary, low binary, high binary"
_NAMES = ["block", "sets", "counts", "low", "high"]


def _incidence(n: int, blocks: int, shared):
    """Packed rows: sizes of sets (low null), entries of hot columns (high null), and entries of a column block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, frequent = shared.value
        for batch in batches:
            for a, b in T.slices(batch.column(1), SLICE):
                grams, owner = gram_sets(batch.column(1).slice(a, b - a), n)
                if not len(grams):
                    continue
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                sizes = np.diff(np.r_[first, len(owner)])
                hi, lo = _prints(grams, first)
                kept = np.zeros(len(hi), bool)
                kept[_same(hi, lo)[0]] = True
                if frequent:
                    keys = batch.column(0).slice(a, b - a).take(pa.array(owner[first])).to_pylist()
                    kept = np.array([frequent.get((h, w), k) == k for h, w, k in zip(hi.tolist(), lo.tolist(), keys, strict=True)])
                    own = np.flatnonzero(kept)
                    kept[:] = False
                    kept[own[_same(hi[own], lo[own])[0]]] = True
                grams, row = grams[np.repeat(kept, sizes)], np.repeat(np.arange(int(kept.sum())), sizes[kept])
                hi, lo, sizes = hi[kept], lo[kept], sizes[kept]
                keys, home = _keys(hi, lo), (hi % np.uint64(blocks)).astype(np.int64)
                out: list[tuple] = []
                for h in np.unique(home):
                    own = home == h
                    out.append((int(h), *_pack(keys[own], _few(sizes[own])), None, None))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
                    is_hot = hot[at] == grams
                    order = np.argsort(home[row[is_hot]], kind="stable")
                    out += [(int(home[r[0]]), *_pack(keys[r[new]], _few(np.diff(np.r_[new, len(r)])), x.astype(np.int32)), None) for r, x, new in _runs(row[is_hot][order], at[is_hot][order], home)]
                    grams, row = grams[~is_hot], row[~is_hot]
                block = ((grams >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block.astype(np.uint16) if blocks < 65536 else block, kind="stable")
                block, row, grams = block[order], row[order], grams[order] & LOW
                at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
                for low, high in zip(at, np.r_[at[1:], len(block)] if len(at) else [], strict=True):
                    rows, part = row[low:high], grams[low:high]
                    new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    out.append((int(block[low]), *_pack(keys[rows[new]], _few(np.diff(np.r_[new, len(rows)])), part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint8))))
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64() if i == 0 else pa.binary()) for i, x in enumerate(zip(*out, strict=True))], _NAMES)

    return run


def _runs(row: np.ndarray, value: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and values of each home, in order, and where each row begins."""
    own = home[row]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    for low, high in zip(at, np.r_[at[1:], len(own)] if len(at) else [], strict=True):
        r = row[low:high]
        yield r, value[low:high], np.flatnonzero(np.r_[True, r[1:] != r[:-1]])


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    raw, _ = T.buffers(column)
    return np.frombuffer(raw.tobytes(), kind)


def _joined_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    both = _joined(table.column("sets"), np.uint32).reshape(-1, 3)
    return np.ascontiguousarray(both[:, :2]).view(np.uint64)[:, 0], both[:, 2].astype(np.uint64)


_SHARED = "home long, block long, sets binary, counts binary, low binary, high binary, rank binary"
_SHARED_NAMES = ["home", "block", "sets", "counts", "low", "high", "rank"]


def _column_block(blocks: int):
    def run(table: pa.Table) -> pa.Table:
        here = table.column("block")[0].as_py()
        through = table.filter(pc.is_null(table.column("high")))
        out = [(here, here, s, c, g, None, None) for s, c, g in zip(*(through.column(x).to_pylist() for x in ("sets", "counts", "low")), strict=True)]
        entries = table.filter(pc.is_valid(table.column("high")))
        if entries.num_rows:
            hi, lo = _joined_keys(entries)
            counts = _joined_counts(entries)
            grams = _joined(entries.column("low"), np.uint32).astype(np.uint64) | (_joined(entries.column("high"), np.uint8).astype(np.uint64) << np.uint64(32))
            kept = np.zeros(len(hi), bool)
            kept[_same(hi, lo)[0]] = True  # copies have equal columns
            entry = np.repeat(kept, counts)
            row = np.repeat(np.arange(len(hi), dtype=np.int32), counts)[entry]
            grams = grams[entry]
            order = np.argsort(grams)
            grams, row = grams[order], row[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            runs = np.diff(np.r_[first, len(grams)])
            rank = np.repeat(np.minimum(runs, 65535), runs)
            shared = rank > 1
            grams, row, rank = grams[shared], row[shared], rank[shared].astype(np.uint16)
            home = (hi % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((row, home[row]))
            grams, row, rank = grams[order], row[order], rank[order]
            keys, at = _keys(hi, lo), 0
            for rows, part, new in _runs(row, grams, home):
                out.append((int(home[rows[0]]), here, *_pack(keys[rows[new]], _few(np.diff(np.r_[new, len(rows)])), part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint8), rank[at : at + len(rows)])))
                at += len(rows)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(_SHARED_NAMES)
        return pa.table([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(columns)], _SHARED_NAMES)

    return run


_ROWS = "hi long, lo long, size int, p_hi long, p_lo long, grams array<long>"
_ROWS_NAMES = ["hi", "lo", "size", "p_hi", "p_lo", "grams"]


def _row_block(t: float):
    """Sets that can reach a partner, with their columns by rarity and a fingerprint of these."""

    def run(table: pa.Table) -> pa.Table:
        about = table.filter(pc.is_null(table.column("low")))
        hi, lo = _joined_keys(about)
        sizes = _joined_counts(about)
        normal, hot = table.filter(pc.is_valid(table.column("high"))), table.filter(pc.and_(pc.is_valid(table.column("low")), pc.is_null(table.column("high"))))
        h2, l2 = _joined_keys(normal)
        h3, l3 = _joined_keys(hot)
        first, label = _same(np.r_[hi, h2, h3], np.r_[lo, l2, l3])
        own, of, of_hot = label[: len(hi)], label[len(hi) : len(hi) + len(h2)], label[len(hi) + len(h2) :]
        size = np.zeros(len(first), np.int64)
        size[own] = sizes
        counts = _joined_counts(normal)
        grams = _joined(normal.column("low"), np.uint32).astype(np.uint64) | (_joined(normal.column("high"), np.uint8).astype(np.uint64) << np.uint64(32))
        lengths = np.asarray(pc.divide(pc.binary_length(normal.column("low")), 4), np.int64)
        grams = (grams | np.repeat(np.asarray(normal.column("block"), np.uint64), lengths) << np.uint64(40)).view(np.int64)
        rank, row = _joined(normal.column("rank"), np.uint16), np.repeat(of, counts)
        if hot.num_rows:  # a set of several slices has its hot columns as often
            times = _joined_counts(hot)
            once = np.zeros(len(of_hot), bool)
            once[np.unique(of_hot, return_index=True)[1]] = True
            entry = np.repeat(once, times)
            more = -1 - _joined(hot.column("low"), np.int32).astype(np.int64)[entry]
            grams, row, rank = np.r_[grams, more], np.r_[row, np.repeat(of_hot, times)[entry]], np.r_[rank, np.full(len(more), 65535, np.uint16)]
        total = np.bincount(row, minlength=len(first)).astype(np.int64)
        rows = np.flatnonzero(total >= np.maximum(needed(t, size), 1))
        keep = np.isin(row, rows)
        grams, rank, row = grams[keep], rank[keep], row[keep]
        order = np.lexsort((grams, rank, row))
        grams = grams[order]
        if not len(rows):
            return pa.table([pa.array([], x) for x in [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 2 + [pa.list_(pa.int64())]], _ROWS_NAMES)
        ends = np.cumsum(total[rows])
        p_hi, p_lo = _prints(grams.view(np.uint64), ends - total[rows])
        every = np.r_[hi, h2, h3][first], np.r_[lo, l2, l3][first]
        return pa.table([*(pa.array(x[rows].view(np.int64)) for x in every), pa.array(size[rows].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (p_hi, p_lo)), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(grams))], _ROWS_NAMES)

    return run


def _about(df: DataFrame, n: int) -> DataFrame:
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", identity().alias("row_key"), F.coalesce("text", F.lit("")).alias("text"))
    return materialise(mapped(rows, _sets(n), f"doc_id {kind}, row_key binary, hi long, lo long, size long"), "sets")


def _incident(df: DataFrame, about: DataFrame, n: int, t: float) -> DataFrame:
    """sid, hi, lo, size, p_hi, p_lo and grams of the sets that can reach a partner; written once."""
    spark = df.sparkSession
    total, entries = about.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries / BLOCK_ENTRIES))
    text = F.coalesce("text", F.lit("")).alias("text")
    # no column has more entries than there are rows
    hot = hot_columns(df.select(text), n, entries) if total > HOT_ROWS else np.zeros(0, np.uint64)
    many = about.where("size > 0").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("row_key").alias("row_key")).where(F.col("n") > max(FREQUENT, total // MANY))
    frequent = {(r.hi % 2**64, r.lo % 2**64): bytes(r.row_key) for r in many.collect()}
    shared = spark.sparkContext.broadcast((hot, frequent))
    entry = mapped(df.select(identity().alias("row_key"), text), _incidence(n, blocks, shared), _INCIDENCE)
    rows = entry.groupBy("block").applyInArrow(_column_block(blocks), _SHARED).groupBy("home").applyInArrow(_row_block(t), _ROWS)
    return materialise(rows.withColumn("sid", F.monotonically_increasing_id()), "incidence")


def components(edges: DataFrame) -> DataFrame:
    """`doc` and `root`, the least id of its connected component, of every id in the edges (u, v).

    Alternating large-star and small-star steps over an edge list that never grows beyond
    the edges, written to the shared folder. The least neighbour of an id is an aggregate
    with partial sums and joined back, so an id with very many edges is no group of rows.
    """
    spark = edges.sparkSession
    kept: list[str] = []

    def write(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept.append(scratch_path(spark, "edges"))
        df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(kept[-1])
        new = spark.read.schema("u long, v long").parquet(kept[-1])
        return new, tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    least = lambda df: df.join(df.groupBy("u").agg(F.min("v").alias("m")), "u")
    now, before = write(edges)
    while before[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least(both).select("u", "v", F.least("u", "m").alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = least(down)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now, after = write(small)
        while len(kept) > 1:
            remove(spark, kept.pop(0))
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("doc"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("doc"), F.col("v").alias("root")).distinct())


def _products(sizes: np.ndarray, counts: np.ndarray, grams: np.ndarray, side: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Row index pairs at or above the threshold; side: 0, 1 or 2, rows of one tile, or of the first or second of two."""
    k = len(sizes)
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(k), counts)
    some = count[column] > 1
    column, row = new[column[some]], row[some]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = int(new[-1]) + 1 if len(new) else 0
    overlap = np.zeros((k, k), np.float32)
    for low in range(0, width, STRIP):
        a, b = np.searchsorted(column, [low, low + STRIP])
        strip = np.zeros((k, min(STRIP, width - low)), np.float32)
        strip[row[a:b], column[a:b] - low] = 1
        overlap += strip @ strip.T
    i, j = np.nonzero(np.triu(overlap, 1) > 0)
    apart = (side[i] == 0) | (side[i] != side[j])
    i, j = i[apart], j[apart]
    shared = overlap[i, j].astype(np.int64)
    enough = shared >= t * (sizes[i] + sizes[j] - shared)
    return i[enough], j[enough]


_LINKS = "pid long, links long, star long"


def _multiply(t: float):
    """Of each row with a partner in its tiles: the weight of its partners, and the least row that links lead to."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("root").combine_chunks()
        root, pid, size, weight, side = (np.asarray(table.column(c), np.int64) for c in ("root", "pid", "size", "weight", "side"))
        lists = table.column("grams").combine_chunks() if isinstance(table.column("grams"), pa.ChunkedArray) else table.column("grams")
        counts = np.asarray(pc.list_value_length(lists), np.int64)
        grams = np.asarray(lists.flatten(), np.int64)
        ends = np.cumsum(counts)
        out = [[], [], []]
        at = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        for a, b in zip(at, np.r_[at[1:], len(root)], strict=True):
            i, j = _products(size[a:b], counts[a:b], grams[ends[a] - counts[a] : ends[b - 1]], side[a:b], t)
            if not len(i):
                continue
            links = np.bincount(i, weights=weight[a:b][j], minlength=b - a) + np.bincount(j, weights=weight[a:b][i], minlength=b - a)
            star = pid[a:b].copy()
            while True:
                new = star.copy()
                np.minimum.at(new, i, star[j])
                np.minimum.at(new, j, star[i])
                if np.array_equal(new, star):
                    break
                star = new
            own = np.flatnonzero(links)
            for x, y in zip(out, (pid[a:b][own], links[own].astype(np.int64), star[own]), strict=True):
                x.append(y)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], ["pid", "links", "star"])

    return run


def _class(size):
    """Sizes in steps of a tenth."""
    return F.floor(F.log(size) / math.log(1.1)).cast("int")


def _linked(sets: DataFrame, t: float) -> DataFrame:
    """hi, lo, links and root (an id of its class) of every set with a partner."""
    spark = sets.sparkSession
    like = ["p_hi", "p_lo", "size"]
    alike = materialise(sets.groupBy(like).agg(F.min("sid").alias("pid"), F.count("*").alias("weight")), "alike")
    rows = sets.join(sized(alike.select(F.col("pid").alias("sid"), "weight")), "sid").withColumnRenamed("sid", "pid")
    total = F.size("grams")
    # the largest partner of a row whose overlap is at most `rest`
    most = lambda rest: F.floor(rest * (1 + t) / t - F.col("size") + 1e-6).cast("int")
    width = (total - F.ceil(F.lit(t) * F.col("size") - 1e-9) + 1).cast("int")
    prefixes = rows.select("pid", "size", total.alias("total"), F.posexplode(F.slice("grams", F.lit(1), F.greatest(width, F.lit(1)))).alias("at", "gram"))
    prefixes = prefixes.select("pid", "size", "gram", most(F.col("total") - F.col("at")).alias("most"))
    hubs = prefixes.groupBy("gram").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.min_by("pid", "size").alias("hub")).where("n > 1").drop("n")
    edges = prefixes.select("gram", "pid", "most").join(hubs, "gram").where("pid <> hub AND most >= least").select(F.col("pid").alias("u"), F.col("hub").alias("v")).distinct()
    blocks = materialise(components(edges), "row-blocks").withColumnRenamed("doc", "pid")
    sizes = blocks.groupBy("root").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > TILE).select("root"), "large")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(blocks.count() / TILE))
    placed = rows.join(sized(blocks), "pid").select("root", "pid", "size", "weight", "grams")
    key = F.pmod(F.xxhash64("root"), F.lit(buckets))
    columns = ["root", "pid", "size", "weight", "grams", "side", "part_a", "part_b"]
    small = placed if large.isEmpty() else placed.join(sized(large), "root", "left_anti")
    work = small.select("root", "pid", "size", "weight", "grams", F.lit(0).alias("side"), key.alias("part_a"), F.lit(-1).cast("long").alias("part_b"))
    if not large.isEmpty():
        own = placed.join(sized(large), "root").withColumn("class", _class(F.col("size")))
        bounds = materialise(own.groupBy("root", "class").agg(F.ceil(F.count("*") / (TILE // 2)).alias("tiles"), F.min("size").alias("least"), F.max(most(F.size("grams"))).alias("most")), "bounds")
        a, b = (bounds.select("root", *(F.col(c).alias(f"{c}_{x}") for c in ("class", "tiles", "least", "most"))) for x in "ab")
        # classes of a root are few: sizes grow by a tenth from one to the next
        meet = a.join(b, "root").where("class_a <= class_b AND most_a >= least_b AND most_b >= least_a")
        first = meet.select("root", F.col("class_a").alias("class"), "class_a", "class_b", "tiles_a", "tiles_b", F.lit(1).alias("as"))
        second = meet.select("root", F.col("class_b").alias("class"), "class_a", "class_b", "tiles_a", "tiles_b", F.lit(2).alias("as"))
        both = own.join(sized(materialise(first.unionByName(second), "meet")), ["root", "class"])
        hashed = lambda n: F.pmod(F.xxhash64("pid", F.lit(1)), n)
        mine = hashed(F.when(F.col("as") == 1, F.col("tiles_a")).otherwise(F.col("tiles_b")))
        other = F.when(F.col("as") == 1, F.col("tiles_b")).otherwise(F.col("tiles_a"))
        both = both.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
        same = F.col("class_a") == F.col("class_b")
        # within a class a tile meets itself once and each other tile once
        both = both.where(~same | ((F.col("as") == 1) & (F.col("mine") <= F.col("other"))) | ((F.col("as") == 2) & (F.col("mine") > F.col("other"))))
        at = lambda x, y: F.when(F.col("as") == 1, x).otherwise(y)
        tile_a, tile_b = at(F.col("mine"), F.col("other")), at(F.col("other"), F.col("mine"))
        side = F.when(same & (F.col("mine") == F.col("other")), 0).otherwise(F.col("as"))
        place = lambda c, tile: (c.cast("long") * (1 << 40) + tile).cast("long")
        tiles = both.select("root", "pid", "size", "weight", "grams", side.alias("side"), place(F.col("class_a"), tile_a).alias("part_a"), place(F.col("class_b"), tile_b).alias("part_b"), F.col("root").alias("of"))
        work = work.withColumn("of", F.lit(-1).cast("long")).unionByName(tiles)
    else:
        work = work.withColumn("of", F.lit(-1).cast("long"))
    found = materialise(work.select(*columns, "of").groupBy("of", "part_a", "part_b").applyInArrow(_multiply(t), _LINKS), "links")
    roots = materialise(components(found.select(F.col("pid").alias("u"), F.col("star").alias("v"))), "classes")
    partners = found.groupBy("pid").agg(F.sum("links").alias("links")).join(roots.select(F.col("doc").alias("pid"), "root"), "pid")
    alone = F.size("grams") >= t * (2 * F.col("size") - F.size("grams"))
    members = sets.select("hi", "lo", *like, alone.alias("alike")).join(sized(alike), like).select("hi", "lo", "pid", "weight", (F.col("alike") & (F.col("weight") > 1)).alias("alike"))
    out = members.join(sized(materialise(partners, "partners")), "pid", "left").where("links IS NOT NULL OR alike")
    return materialise(out.select("hi", "lo", (F.coalesce("links", F.lit(0)) + F.when(F.col("alike"), F.col("weight") - 1).otherwise(0)).alias("links"), F.coalesce("root", "pid").alias("root")), "linked")


def _classes(df: DataFrame, n: int, t: float) -> DataFrame:
    """doc_id, row_key, size, hi, lo, root (null without links), class_id, links and copies of every row."""
    about = _about(df, n)
    linked = _linked(_incident(df, about, n, t), t)
    owners = about.where("size > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    owners = materialise(owners.join(sized(linked), ["hi", "lo"], "left").where("copies > 1 OR root IS NOT NULL"), "owners")
    least = owners.where("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("class_least"))
    info = owners.join(sized(materialise(least, "least")), "root", "left").select("hi", "lo", "root", "copies", "links", F.coalesce("class_least", "least").alias("class_id"))
    found = about.join(sized(materialise(info, "classes")), ["hi", "lo"], "left")
    return found.select("doc_id", "row_key", "size", "hi", "lo", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def report(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, links and copies of every row; see the module's text."""
    return _classes(df, n, threshold).select("doc_id", "class_id", "links", "copies")


def one_of_each(df: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df of which one stands for each class, with the columns of df; see the module's text."""
    rows = _classes(df, n, threshold).where("copies > 1 OR root IS NOT NULL")
    alone = F.col("root").isNull()
    rows = materialise(rows.select("doc_id", "row_key", "root", F.when(alone, F.col("hi")).alias("hi"), F.when(alone, F.col("lo")).alias("lo")), "members")
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    (key,) = fresh(df, "__key")
    same = rows.groupBy("root", "hi", "lo").agg(F.min(one)["row_key"].alias("chosen")).select(F.col("root").alias("r"), F.col("hi").alias("h"), F.col("lo").alias("l"), "chosen")
    match = F.col("root").eqNullSafe(F.col("r")) & F.col("hi").eqNullSafe(F.col("h")) & F.col("lo").eqNullSafe(F.col("l"))
    away = materialise(rows.join(same, match).where("row_key <> chosen").select(F.col("row_key").alias(key)).distinct(), "near-copies")
    return df.withColumn(key, identity()).join(sized(away), key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def sql(n: int = N, threshold: float = THRESHOLD, table: str = "documents") -> str:
    """DuckDB SQL for report() on a table of unique doc_ids."""
    gram = f"CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) END"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x01-\\x20]+'), lambda x: x <> '') AS w FROM {table}),
g AS (SELECT doc_id, list_sort(list_distinct({gram})) AS g FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, g, len(g) AS size, md5(array_to_string(g, chr(10))) AS k FROM g),
r AS (SELECT k, min(doc_id) AS rep, count(*) AS copies FROM k GROUP BY k),
e AS (SELECT doc_id AS rep, size, unnest(g) AS gram FROM k JOIN r ON r.k = k.k AND r.rep = k.doc_id),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS overlap, min(a.size) + min(b.size) AS sizes FROM e a JOIN e b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE overlap >= {threshold} * (sizes - overlap)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, r.rep, d.doc_id) AS class_id, CAST(coalesce(n.links, 0) AS BIGINT) AS links, CAST(coalesce(r.copies, 1) AS BIGINT) AS copies
FROM {table} d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (k) LEFT JOIN c ON c.a = r.rep LEFT JOIN n ON n.a = r.rep"""
