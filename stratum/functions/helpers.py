"""DataFrame forms of what Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(column: Column) -> Column:
    """The sum of integers, exact beyond 64 bits."""
    return F.sum(column.cast("decimal(38,0)"))


def qualify(df: DataFrame, window: str, keep: str, name: str = "q") -> DataFrame:
    """The rows whose window expression, named `name`, meets the condition."""
    return df.withColumn(name, F.expr(window)).where(keep).drop(name)


def _ordering(order: list[str]) -> list[Column]:
    out = []
    for item in order:
        column, _, way = item.partition(" ")
        out.append(F.col(column).desc_nulls_last() if way.strip().upper() == "DESC" else F.col(column).asc_nulls_last())
    return out


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    first = Window.partitionBy(*keys).orderBy(*_ordering(order))
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tie: str | None = None) -> DataFrame:
    """left with the columns of the last right row of the same keys at or before its time, null without one.

    One shuffle by key and one sort: both sides are unioned and a window carries the
    last right row forward, so no pair of rows is ever formed and state is one row.
    Null times and null keys match nothing. Columns of right with the name of one of left
    come out as right_<name>.
    """
    right = right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c in left.columns and c not in keys})
    right_at, tie = (f"right_{c}" if c in left.columns and c not in keys else c for c in (right_at, tie))
    carried = [c for c in right.columns if c not in keys]
    both = left.select(*left.columns, F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("__r"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"))
    there = right.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, right_at]))
    others = there.select(*(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.struct(*carried).alias("__r"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"))
    order = [F.col("__at"), F.col("__side")] + ([F.col(f"__r.{tie}")] if tie else [])
    last = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.unionByName(others).withColumn("__m", last).where("__side = 1")
    match = F.when(F.col("__at").isNotNull(), F.col("__m"))
    return out.select(*left.columns, *(match[c].alias(c) for c in carried))


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs with low <= at < high, as an equi-join on buckets of `width` and an exact filter.

    width should be near the usual length of a span: a span costs a row for every
    bucket that it touches.
    """
    cut = spans.where(f"{low} < {high}").withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(cut, "__b").where(f"{at} >= {low} AND {at} < {high}").drop("__b")


def column_stats(df: DataFrame) -> DataFrame:
    """name, min, max (as strings) and null_count of every column, in one pass."""
    fields = [F.struct(F.lit(c).alias("name"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), (F.count("*") - F.count(c)).alias("null_count")) for c in df.columns]
    return df.agg(F.array(*fields).alias("s")).select(F.inline("s"))
