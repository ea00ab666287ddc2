"""Byte-level BPE encoding and decoding over Arrow batches.

encode() cuts the texts of a slice before every white space that follows a solid
character. The byte-level pattern never joins across such a cut, so the pieces can be
encoded apart: each distinct piece goes through the tokenizers library once and a
bounded cache of pieces lives as long as the worker. Rows whose ids don't decode to
their own bytes (two pieces of one hash) are encoded again whole, as is everything if
the vocabulary has another pattern. Spans come from the byte table: token byte lengths sum to byte offsets, and a count of
UTF-8 lead bytes maps byte offsets to character offsets. A token's character span
covers every character of which it holds a byte, so tokens that split a character all
span it. decode() gathers the byte strings of all ids of a slice at once and reads the
joined bytes as UTF-8; split characters come together because bytes are joined before
they are read. Bytes that are not UTF-8 (ids cut from the middle of a character)
become U+FFFD.

Defined results: a null text gives null ids, spans and text; an empty text gives empty
lists; an id outside the vocabulary or a null id is an error for its row: its text is
null. Special tokens' strings in a text are ordinary text. Texts are encoded whole,
however long. Repeated rows are encoded each on its own; an empty table gives an empty
table. Columns of the input with the name of an added column, in any case, are replaced;
others may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import fresh, mapped, without

SLICE = 1 << 20
CACHED = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable stand-in character of every byte, as byte-level vocabularies write them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cuts(raw: np.ndarray, offsets: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """Whether each end follows a byte that ends no white space; where pieces start: every text, and every ASCII white space after such a byte."""
    two = np.r_[np.uint8(0), raw[:-1]]
    # white space beyond ASCII is C2 85, C2 A0, E1 9A 80, E2 80 .., E2 81 9F or E3 80 80; a control byte is no safe end
    solid = (raw > 32) & (raw != 127) & ~((raw >= 128) & ((two == 0xC2) | (two == 0x9A) | (two == 0x80) | (two == 0x81)))
    if ends is not None:
        return solid[ends - 1], np.zeros(0, np.int64)
    start = ((raw == 32) | ((raw >= 9) & (raw <= 13))) & np.r_[False, solid[:-1]]
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return None, np.flatnonzero(start)


class Codec:
    """A vocabulary file with its byte table."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(open(path, encoding="utf-8").read())
        special = {x["id"]: x["content"] for x in spec.get("added_tokens", ())}
        table, of = [b""] * self.tokenizer.get_vocab_size(), byte_characters()
        for token, i in self.tokenizer.get_vocab().items():
            table[i] = special[i].encode() if i in special else bytes(of[c] for c in token)
        self.sizes = np.array([len(x) for x in table], np.int64)
        self.table = pa.array(table, pa.large_binary())

        before = spec.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add distinct, sorted hashes and their pieces to the cache.

        Pieces between a white space and a solid byte may stand in a row as well as
        alone, so they are encoded joined, and token sizes tell where each one ends.
        """
        data = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joined = cuts(raw, np.array([0, len(raw)]), ends)[0] & ((raw[starts] == 32) | ((raw[starts] >= 9) & (raw[starts] <= 13)))
        order = np.r_[np.flatnonzero(joined), np.flatnonzero(~joined)]
        n = int(joined.sum())
        groups = [b"".join([data[i] for i in order[k : min(k + 256, n)]]).decode("utf-8", "replace") for k in range(0, n, 256)]
        together, _ = self.direct(groups)
        bounds = np.searchsorted(np.r_[0, np.cumsum(self.sizes[together])], np.r_[0, np.cumsum((ends - starts)[order[:n]])])
        alone, counts = self.direct([data[i].decode("utf-8", "replace") for i in order[n:]])
        count, first = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        count[order] = np.r_[np.diff(bounds), counts]
        first[order] = len(self.ids) + np.cumsum(count[order]) - count[order]
        place = np.searchsorted(self.known, hashes)
        self.first, self.count, self.known = (np.insert(x, place, y) for x, y in ((self.first, first), (self.count, count), (self.known, hashes)))
        self.ids = np.r_[self.ids, together, alone]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        sizes = np.diff(offsets)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        text = lambda a, b: raw[a:b].tobytes().decode("utf-8", "replace")
        if not self.by_piece:
            return self.direct([text(a, b) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        _, starts = cuts(raw, offsets)
        ends = np.r_[starts[1:], len(raw)]
        hashes = T.span_hashes(raw, starts, ends)
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[place] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if len(self.known) > CACHED:
            self.forget()
            new[:] = True
        if new.any():
            self.learn(distinct[new], raw, starts[at[new]], ends[at[new]])
        place = np.searchsorted(self.known, distinct)[which]
        first, count = self.first[place], self.count[place]
        owner = np.searchsorted(offsets, starts, "right") - 1
        total = np.cumsum(count)
        ids = self.ids[np.repeat(first - (total - count), count) + np.arange(total[-1])]
        counts = np.bincount(owner, weights=count, minlength=len(sizes)).astype(np.int64)
        bounds = np.r_[0, np.cumsum(counts)]
        back, at = T.buffers(self.decode(ids, bounds))
        if len(back) == len(raw) and np.array_equal(at, offsets) and np.array_equal(back, raw):
            return ids, counts
        lists = []
        for i in range(len(sizes)):
            own = ids[bounds[i] : bounds[i + 1]]
            if back[at[i] : at[i + 1]].tobytes() != raw[offsets[i] : offsets[i + 1]].tobytes():
                own = self.direct([text(offsets[i], offsets[i + 1])])[0]
            lists.append(own)
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text, from the library alone."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x.ids for x in found]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def spans(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end of every token in its text."""
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        lead = np.cumsum((raw & 0xC0) != 0x80)  # characters begun at or before each byte
        base = np.repeat(np.r_[0, lead][offsets[:-1]], counts)
        return lead[starts] - 1 - base, lead[ends - 1] - base

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each list of ids, joined."""
        parts = self.table.take(pa.array(ids))
        raw, at = T.buffers(parts)
        at = at[offsets]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw.tobytes())])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _text_array(joined: pa.Array) -> pa.Array:
    try:
        return pc.cast(joined, pa.large_string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.large_string())


def _lists(values: np.ndarray, counts: np.ndarray, null: pa.Array) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32), mask=np.r_[np.asarray(null), False]) if len(counts) else pa.array([0], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def encode_column(column: pa.Array, path: str, round_trip: bool) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Row ranges with their ids, starts, ends (and decoded texts)."""
    c = codec(path)
    for a, b in T.slices(column, SLICE):
        part = column.slice(a, b - a)
        null = pc.is_null(part).to_numpy(zero_copy_only=False)
        raw, offsets = T.buffers(part)
        ids, counts = c.encode(raw, offsets)
        starts, ends = c.spans(ids, counts, raw, offsets)
        out = [_lists(ids, counts, null), _lists(starts, counts, null), _lists(ends, counts, null)]
        if round_trip:
            text = _text_array(c.decode(ids, np.r_[0, np.cumsum(counts)]))
            out.append(pc.if_else(pa.array(null), pa.scalar(None, text.type), text).cast(pa.string()))
        yield a, b, out


def _adder(path: str, keep: int, round_trip: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, new in encode_column(batch.column(keep), path, round_trip):
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[:keep]), *new], names)

    return run


def _with_text(df: DataFrame, text: str, added: list[str]) -> DataFrame:
    (name,) = fresh(df, "__text")
    return df.select(*(F.col(f"`{c}`") for c in without(df, added)), F.col(f"`{text}`").alias(name))


def _schema(df: DataFrame, more: str) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1])
    return f"{own}, {more}" if own else more


def encode(df: DataFrame, path: str | None = None, text: str = "text", round_trip: bool = False) -> DataFrame:
    """df with token_ids, starts and ends; with round_trip also `decoded`, the text that decoding the ids gives."""
    added = ["token_ids", "starts", "ends"] + ["decoded"] * round_trip
    rows = _with_text(df, text, added)
    names = [*rows.columns[:-1], *added]
    schema = _schema(rows, "token_ids array<int>, starts array<int>, ends array<int>" + ", decoded string" * round_trip)
    return mapped(rows, _adder(path or default_vocabulary(), len(rows.columns) - 1, round_trip, names), schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """df with `decoded`, the text of the ids."""
    rows = _with_text(df, ids, ["decoded"])
    path, keep = path or default_vocabulary(), len(rows.columns) - 1
    names = [*rows.columns[:-1], "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(keep)
                null = pc.is_null(lists).to_numpy(zero_copy_only=False)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                flat = lists.flatten()
                wrong = pc.fill_null(pc.or_(pc.less(flat, 0), pc.greater_equal(flat, len(c.sizes))), True).to_numpy(zero_copy_only=False)
                ids_ = np.where(wrong, 0, np.asarray(pc.fill_null(flat, 0), np.int64))
                null = null | (np.add.reduceat(np.r_[wrong, False].astype(np.int64), (np.cumsum(counts) - counts)) * (counts > 0) > 0) if len(counts) else null
                text = _text_array(c.decode(ids_, np.r_[0, np.cumsum(counts)]))
                text = pc.if_else(pa.array(null), pa.scalar(None, text.type), text).cast(pa.string())
                yield pa.record_batch([*part.columns[:keep], text], names)

    return mapped(rows, run, _schema(rows, "decoded string"))
