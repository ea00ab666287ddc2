"""Sharding: a Feistel permutation with cycle walking over global row numbers.

number_rows() gives every row its place 0..N-1 in the order of a key, without a
single-partition window; permuted() maps a place to a position by a keyed bijection of
0..N-1; shard and slot follow from the position alone, so any row's place in the
shuffled corpus can be computed, and inverted, without moving data.

The permutation works on pairs (left, right) of base S = ceil(sqrt(N)): a round sends
them to (right, (left + f(right)) mod S), which is a bijection of S * S values. Values
of N or more are sent through again until they fall below N (cycle walking). How many
times that can happen is computed exactly on the driver: only S * S - N < 2 * S + 1
values lie outside.

Defined results: the order is by doc_id, nulls last, then by a hash of the whole row;
rows equal in every column are interchangeable, each gets its own number. An empty
table gives an empty table. Null or very long texts change nothing. Columns may be of any
type, maps and variants too (these are hashed as JSON), and have any name; input columns
with the name of an added column, in any case, are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import fresh, scratch_path, without

PRIME = 2147483647
ADDED = ("row_number", "position", "shard", "slot")


def round_keys(seed: int, rounds: int = 4) -> list[tuple[int, int]]:
    """Multiplier and addend of every round."""
    out, x = [], (seed * 2862933555777941757 + 3037000493) % 2**64
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append(tuple(pair))
    return out


def side(n: int) -> int:
    """The base of the pairs: the least S with S * S >= n."""
    return max(1, math.isqrt(max(n - 1, 0)) + 1)


def _forward(left, right, s: int, keys):
    """One pass over numpy arrays."""
    for a, c in keys:
        f = (right % PRIME * a + c) % PRIME
        f = (f * f + right) % PRIME
        left, right = right, (left + f) % s
    return left, right


def walks(n: int, keys) -> int:
    """The most passes that any value below n needs: one, and as many as the longest chain of values outside."""
    s = side(n)
    outside = np.arange(n, s * s, dtype=np.int64)
    most, x = 1, outside
    while len(x):
        left, right = _forward(x // s, x % s, s, keys)
        x = left * s + right
        x = x[x >= n]
        most += 1
        if most > len(outside) + 2:
            break
    return most


def permuted(index: Column, n: int, seed: int) -> Column:
    """Position of a row number below n; a built-in expression."""
    s, keys = side(n), round_keys(seed)
    rounds = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for a, c in keys))
    pair = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(at: Column, k: Column) -> Column:
        f = (at["r"] % PRIME * k["a"] + k["c"]) % PRIME
        return pair(at["r"], (at["l"] + (f * f + at["r"]) % PRIME) % s)

    once = lambda at: F.aggregate(rounds, at, step)
    start = once(pair((index - index % s) / s, index % s))
    more = walks(n, keys) - 1
    if more:
        passes = F.array(*(F.lit(i) for i in range(more))) if more <= 64 else F.sequence(F.lit(1), F.lit(more))
        start = F.aggregate(passes, start, lambda at, _: F.when(at["l"] * s + at["r"] >= n, once(at)).otherwise(at))
    return F.transform(F.array(start), lambda at: at["l"] * s + at["r"])[0]


def _hashable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def number_rows(df: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int]:
    """df with `row_number`, and the number of rows.

    Range-partitions by the key, sorts inside partitions, and writes the rows with
    their partition and place to the shared folder; the partitions' counts, one small
    row each, then give each partition its first number. Written once, so a retried
    task can't shift numbers.
    """
    spark = df.sparkSession
    columns = without(df, ADDED)
    tie, part, at, first = fresh(df, "__tie", "__part", "__at", "__first")
    order = [F.col(f"`{key}`").asc_nulls_last(), F.col(tie)]
    path = scratch_path(spark, "numbered")
    (
        df.select(*(F.col(f"`{c}`") for c in columns)).withColumn(tie, F.xxhash64(*(_hashable(df, c) for c in columns)))
        .repartitionByRange(*order).sortWithinPartitions(*order).drop(tie)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .write.parquet(path)
    )
    written = spark.read.schema(f"{part} int").parquet(path)
    counts = sorted(tuple(r) for r in written.groupBy(part).agg(F.count("*")).collect())
    starts, total = [], 0
    for number, count in counts:
        starts.append((number, total))
        total += count
    offsets = spark.createDataFrame(starts or [(0, 0)], f"{part} int, {first} long")
    numbered = spark.read.parquet(path).join(F.broadcast(offsets), part).withColumn("row_number", F.col(first) + F.col(at))
    return numbered.select(*(F.col(f"`{c}`") for c in columns), "row_number"), total


def apply(df: DataFrame, shards: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """df with row_number, position, shard and slot; shard = position mod shards, slot = position div shards."""
    numbered, n = number_rows(df, key)
    out = numbered.withColumn("position", permuted(F.col("row_number"), n, seed))
    return out.withColumn("shard", F.col("position") % shards).withColumn("slot", ((F.col("position") - F.col("shard")) / shards).cast("long"))


def sql(shards: int, seed: int = 0, table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB SQL for apply(), for unique keys."""
    keys = round_keys(seed)
    pick = lambda i: "CASE k " + " ".join(f"WHEN {j} THEN CAST({kv[i]} AS BIGINT)" for j, kv in enumerate(keys)) + " END"
    f = f"((r % {PRIME} * ({pick(0)}) + ({pick(1)})) % {PRIME})"
    return f"""
WITH RECURSIVE d AS (SELECT {columns}, row_number() OVER (ORDER BY doc_id) - 1 AS row_number FROM {table}),
s AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS s FROM {table}),
walk AS (
  SELECT row_number, row_number // s AS l, row_number % s AS r, 0 AS k, n, s FROM d, s
  UNION ALL
  SELECT row_number, CASE WHEN k < {len(keys)} THEN r ELSE l END,
    CASE WHEN k < {len(keys)} THEN (l + ({f} * {f} + r) % {PRIME}) % s ELSE r END,
    CASE WHEN k < {len(keys)} THEN k + 1 ELSE 0 END, n, s
  FROM walk WHERE k < {len(keys)} OR l * s + r >= n
),
p AS (SELECT row_number, l * s + r AS position FROM walk WHERE k = {len(keys)} AND l * s + r < n)
SELECT {columns}, CAST(row_number AS BIGINT) AS row_number, CAST(position AS BIGINT) AS position,
  CAST(position % {shards} AS BIGINT) AS shard, CAST(position // {shards} AS BIGINT) AS slot
FROM d JOIN p USING (row_number)"""
