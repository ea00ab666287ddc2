"""Write-once Parquet segments with the statistics of their footers."""

from __future__ import annotations

import datetime
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from decimal import Decimal

import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from stratum.functions import ids
from stratum.functions.types import Refused, Schema

from .files import Files

#: Bytes of a row group before it is closed: point lookups on clustered tables skip the others.
ROW_GROUP = 16 << 20
#: Bytes that one task of a larger write gets, about, to sort and write as a segment: ten times that in memory.
PART = 16 << 20
CODECS = {"zstd", "snappy", "gzip", "lz4", "lz4_raw", "uncompressed", "none"}


def _plain(value):
    if isinstance(value, datetime.datetime):
        return {"type": "timestamp", "value": value.replace(tzinfo=None).isoformat()}
    if isinstance(value, datetime.date):
        return {"type": "date", "value": value.isoformat()}
    if isinstance(value, Decimal):
        return {"type": "decimal", "value": str(value)}
    return value if isinstance(value, (int, float, str, bool)) else None


def footer(files: Files, path: str) -> dict:
    """rows, bytes and min, max and nulls of the columns, from the footer alone; a column without full statistics is left out."""
    size, source = files.end(path)
    with source:
        meta = pq.ParquetFile(source).metadata
    stats: dict[str, dict] = {}
    for i in range(meta.num_columns):
        column = meta.schema.column(i).path
        parts = [meta.row_group(g).column(i).statistics for g in range(meta.num_row_groups)]
        if any(p is None or not p.has_null_count for p in parts):
            continue
        nulls = sum(p.null_count for p in parts)
        bounds = [(p.min, p.max) for p in parts if p.has_min_max]
        if len(bounds) == sum(p.num_values > 0 for p in parts) and bounds:
            low, high = _plain(min(b[0] for b in bounds)), _plain(max(b[1] for b in bounds))
            if low is not None and high is not None:
                stats[column] = {"min": low, "max": high, "nulls": nulls}
        elif nulls == meta.num_rows:
            stats[column] = {"min": None, "max": None, "nulls": nulls}
    return {"rows": meta.num_rows, "bytes": size, "stats": stats, "columns": meta.schema.to_arrow_schema().names}


def estimate(df: DataFrame) -> int | None:
    """Bytes that df reads, where these bound what it holds: files or local rows, filtered, projected or united. None for all else."""
    todo, total = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "LogicalRelation" and node.relation().getClass().getSimpleName() == "HadoopFsRelation":
            total += node.relation().sizeInBytes()
        elif name == "LocalRelation":
            total += int(node.stats().sizeInBytes().toString())
        elif name in ("Project", "Filter", "Union"):
            todo += [node.children().apply(i) for i in range(node.children().size())]
        else:
            return None
    return total


def write(df: DataFrame, schema: Schema, files: Files, folder: str, name: str | None = None, codec: str = "zstd", outputs: int | None = None, least: int = 1) -> list[dict]:
    """Segments of df in the table's column order, sorted by its clustering; none for no rows.

    outputs: by default as many as the size of df asks for, `least` at least, so that no
    task gets much more than PART bytes; where the plan doesn't tell the size, df is written
    once to measure it. With one output the file has the given name, else each has its
    own, as another attempt may cut elsewhere; with more than one, clustered tables are
    range-partitioned, so that files cover disjoint keys and come out in their order.
    """
    if codec not in CODECS:
        raise Refused("unknown_codec", codec)
    rows, keys, measured = df.select(schema.projection(df.columns)), schema.sort_keys(), None
    if outputs is None:
        if (size := estimate(rows)) is None:
            measured = f"_staging/{uuid.uuid4().hex}"
            rows.write.option("compression", codec).parquet(files.path(measured))
            size, rows = files.size(files.path(measured)), df.sparkSession.read.schema(schema.struct).parquet(files.path(measured))
        outputs = max(least, math.ceil(size / PART))
    if outputs > 1:
        rows = rows.repartitionByRange(outputs, *keys) if keys else rows.repartition(outputs)
    else:
        rows = rows.coalesce(1)
    if keys:
        rows = rows.sortWithinPartitions(*keys)
    staging = f"_staging/{uuid.uuid4().hex}"
    rows.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(files.path(staging))

    def placed(item: tuple[int, str]) -> dict | None:
        path = files.path(f"{staging}/{item[1]}")
        about = footer(files, path)
        if not about["rows"]:
            return None
        key = f"{folder}/{name if name and outputs == 1 else ids.generate()}.parquet"
        if not files.move(path, key):  # the same name is the same content: a repeated attempt
            about = footer(files, files.path(key))
        return {"key": key, **about}

    parts = list(enumerate(n for n in files.names(staging) if n.startswith("part-")))
    with ThreadPoolExecutor(min(16, max(len(parts), 1))) as pool:
        out = [x for x in pool.map(placed, parts) if x]
    for folder in (staging, measured):
        if folder:
            files.delete(folder)
    return out
