"""Chat formatting with offset-aligned loss masks.

The turns of a conversation are collected by conv_id and rendered one after another as
HEADER + role + newline + text + FOOTER. Rendered turns of a slice lie in one Arrow
buffer, so a conversation is a range of that buffer and needs no further copy. It is
encoded once, whole; token byte lengths give token spans, and turn spans (the text and
the end marker of every turn of a trained role) are sorted and disjoint, so a binary
search over the span ends finds the one span that a token can overlap. A token is a
target if it shares a byte with such a span.

Defined results: turns are ordered by turn, nulls last, then role, then text; rows that
are equal in all of these stay, one after another. A null text counts as empty, a null
role as "unknown", which is never trained. Rows with a null conv_id belong to no
conversation and are left out. Markers written inside a text are ordinary text and
change no span. Conversations are encoded whole, however long. An empty table gives an
empty table. Other columns take no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._io import mapped
from .bpe import SLICE, codec, default_vocabulary

HEADER, MIDDLE, END, AFTER = "<|im_start|>", "\n", "<|im_end|>", "\n"
TRAINED = ("assistant",)


def rendered(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each turn as one string, with the bytes before its text and after its end marker."""
    turns = pc.binary_join_element_wise(HEADER, roles, MIDDLE, texts, END, AFTER, "")
    before = np.asarray(pc.binary_length(roles), np.int64) + len(HEADER) + len(MIDDLE)
    return turns.cast(pa.large_string()), before, np.full(len(roles), len(AFTER), np.int64)


def overlapping(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Whether each token [start, end) shares a byte with one of the sorted, disjoint spans."""
    if not len(span_starts):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(span_ends, starts, "right")
    inside = at < len(span_ends)
    return inside & (span_starts[np.minimum(at, len(span_ends) - 1)] < ends)


_SCHEMA = "n_turns long, text string, token_ids array<int>, loss_mask array<boolean>, n_tokens long, n_targets long"
_NAMES = ["conv_id", "n_turns", "text", "token_ids", "loss_mask", "n_tokens", "n_targets"]


def _encoder(path: str, trained: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            sizes = np.asarray(batch.column(2), np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                part = batch.slice(at, to - at)
                at = to
                lists = part.column(1)
                counts = np.asarray(pc.list_value_length(lists), np.int64)
                turns = lists.flatten()
                roles, texts = turns.field("role"), turns.field("text")
                joined, before, after = rendered(roles, texts)
                raw, edges = T.buffers(joined)
                bounds = np.r_[0, np.cumsum(counts)]
                offsets = edges[bounds]
                ids, n_ids = c.encode(raw, offsets)
                stops = np.cumsum(c.sizes[ids])
                wanted = pc.is_in(roles, pa.array(trained)).to_numpy(zero_copy_only=False)
                mask = overlapping(stops - c.sizes[ids], stops, (edges[:-1] + before)[wanted], (edges[1:] - after)[wanted])
                lengths = pa.array(np.r_[0, np.cumsum(n_ids)].astype(np.int32))
                text = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())).cast(pa.string())
                of = np.repeat(np.arange(len(counts)), n_ids)
                yield pa.record_batch(
                    [
                        part.column(0), pa.array(counts), text,
                        pa.ListArray.from_arrays(lengths, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(lengths, pa.array(mask)),
                        pa.array(n_ids.astype(np.int64)), pa.array(np.bincount(of, weights=mask, minlength=len(counts)).astype(np.int64)),
                    ],
                    _NAMES,
                )

    return run


def format_chats(turns: DataFrame, path: str | None = None, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, n_turns, text, token_ids, loss_mask, n_tokens and n_targets of every conversation."""
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    grouped = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum(F.octet_length(text) + 64).alias("size"))
    rows = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), "size")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return mapped(rows, _encoder(path or default_vocabulary(), tuple(trained)), f"conv_id {kind}, {_SCHEMA}")
