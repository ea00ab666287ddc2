"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on the UTF-8 buffer of an Arrow string array: word
boundaries, word hashes and word n-gram hashes are numpy expressions over whole
slices of a batch, so no Python code runs per word.

Words are maximal runs of bytes above 0x20; ASCII white space and control bytes
separate them. A word's hash depends on its bytes alone, never on its position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 17
SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Bytes with A-Z as lower case and ASCII signs other than letters and digits as spaces.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = [ord(chr(c).lower()) if chr(c).isalnum() else c if c <= 32 else 32 for c in range(128)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, SEGMENT + 1)
_INVERSES = _powers(_INVERSE, SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes together, one row at least."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word."""
    solid = raw > 32
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    full = offsets[:-1] < offsets[1:]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[offsets[:-1][full]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[offsets[1:][full] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; spans are sorted and disjoint."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = int(np.searchsorted(ends, base + SEGMENT, "right"))
        if to <= at:  # one span longer than a segment: fold its segments
            value, low = np.uint64(0), int(base)
            with np.errstate(over="ignore"):
                while low < ends[at]:
                    high = min(low + SEGMENT, int(ends[at]))
                    part = ((raw[low:high].astype(np.uint64) + np.uint64(1)) * _POWERS[: high - low]).sum(dtype=np.uint64)
                    value = value * np.uint64(0xD6E8FEB86659FD93) + part
                    low = high
            out[at] = value
            at += 1
            continue
        total = np.zeros(int(ends[to - 1] - base) + 1, np.uint64)
        np.cumsum((raw[base : ends[to - 1]].astype(np.uint64) + np.uint64(1)) * _POWERS[: len(total) - 1], out=total[1:])
        low = starts[at:to] - base
        out[at:to] = (total[ends[at:to] - base] - total[low]) * _INVERSES[low]
        at = to
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def ngrams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every n-gram of consecutive words; an owner with fewer words has one, of all of them."""
    if n == 1 or not len(hashes):
        return hashes, owner
    if len(hashes) >= n:
        total = np.zeros(len(hashes) - n + 1, np.uint64)
        for j in range(n):
            total += hashes[j : len(hashes) - n + 1 + j] * np.uint64((0x9FB21C651E98DF25 * (2 * j + 1) | 1) & (2**64 - 1))
        whole = owner[: len(total)] == owner[n - 1 :]
        total, of = mix(total[whole]), owner[: len(whole)][whole]
    else:
        total, of = np.zeros(0, np.uint64), np.zeros(0, owner.dtype)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    counts = np.diff(np.r_[first, len(owner)])
    few = counts < n
    if few.any():
        short_first, short_counts = first[few], counts[few]
        extra = np.zeros(len(short_first), np.uint64)
        for j in range(n - 1):
            has = short_counts > j
            extra[has] += hashes[short_first[has] + j] * np.uint64((0x9FB21C651E98DF25 * (2 * j + 1) | 1) & (2**64 - 1))
        total = np.r_[total, mix(extra + short_counts.astype(np.uint64))]
        of = np.r_[of, owner[short_first]]
        order = np.argsort(of, kind="stable")
        total, of = total[order], of[order]
    return total, of


def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value) pairs, by owner and then value."""
    if len(owner) and owner[-1] < 65536:  # owners ascend; a radix sort restores them after the sort by value
        order = np.argsort(values)
        order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    else:
        order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]
        values, owner = values[new], owner[new]
    return values, owner
