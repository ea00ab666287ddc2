"""Validation and coercion of NDJSON rows as one projection over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.types import Field, Schema

_INTEGER, _NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?"


def coerced(f: Field, kind: Column, text: Column) -> Column:
    """The value of a JSON kind and text in the field's type; null if the kind doesn't fit or the text doesn't parse."""
    whole, number = kind == "BIGINT", kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    string = kind == "STRING"
    name = f.type.upper()
    if name == "INT64":
        return F.when(whole | (string & text.rlike(_INTEGER)), text.try_cast("long"))
    if name == "FLOAT64":
        return F.when(number | (string & text.rlike(_NUMBER)), text.try_cast("double"))
    if name == "STRING":
        return F.when(string, text)
    if name == "BOOL":
        return F.when(kind == "BOOLEAN", text.try_cast("boolean"))
    if name == "DATE":
        return F.when(string & text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    if name == "TIMESTAMP":
        moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp_ltz").cast("timestamp_ntz"))
        return F.when(string & text.rlike(_ISO + "(Z|[+-][0-9]{2}:?[0-9]{2})$"), moved).when(string & text.rlike(_ISO + "$"), text.try_cast("timestamp_ntz"))
    return F.when(number | (string & text.rlike(_NUMBER)), text.try_cast(f.spark))


LINE = "__carried"


def checked(lines: DataFrame, schema: Schema, carried: str) -> DataFrame:
    """index, errors (every problem of the row), a column of lines as LINE, and the typed columns of lines (index, line).

    Numbers outside a type's range are errors; NUMERIC rounds digits beyond its scale.
    """
    json = F.col("__json")
    parsed = lines.withColumn("__json", F.try_parse_json("line"))
    parsed = parsed.withColumn("__object", F.coalesce(F.schema_of_variant(json).startswith("OBJECT"), F.lit(False)))
    parsed = parsed.withColumn("__keys", F.when(F.col("__object"), F.map_keys(F.from_json("line", "map<string,string>"))))
    values, problems = [], []
    for f in schema.fields:
        kind = F.schema_of_variant(F.when(F.col("__object"), F.try_variant_get(json, f"$.{f.name}", "variant")))
        text = F.when(F.col("__object"), F.try_variant_get(json, f"$.{f.name}", "string"))
        given = kind.isNotNull() & (kind != "VOID")
        value = coerced(f, kind, text)
        values.append(value.cast(f.spark).alias(f.name))
        bad = F.when(given & value.isNull(), F.lit(f"{f.name}: not a valid {f.type}"))
        problems.append(bad if f.nullable else bad.when(~given, F.lit(f"{f.name}: required")))
    unknown = F.transform(F.array_sort(F.array_except("__keys", F.array(*(F.lit(n) for n in schema.names)))), lambda k: F.concat(k, F.lit(": unknown column")))
    found = F.concat(F.array_compact(F.array(*problems)), unknown)
    errors = F.when(F.col("__object"), found).otherwise(F.array(F.lit("not a JSON object")))
    return parsed.select(F.col("index"), errors.alias("errors"), F.col(carried).alias(LINE), *values)


def numbered(lines: DataFrame) -> DataFrame:
    """index (from 0, over all lines in file order) and line; blank lines are skipped but counted.

    Two passes over the text, the first for a count a partition; no shuffle.
    """
    placed = lines.select(F.col(lines.columns[0]).alias("line"), F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    first, total = [], 0
    for p, n in sorted(map(tuple, placed.groupBy("__p").count().collect())):
        first.append((p, total))
        total += n
    starts = lines.sparkSession.createDataFrame(first or [(0, 0)], "__p int, __first long")
    rows = placed.join(F.broadcast(starts), "__p").select((F.col("__first") + F.col("__at")).alias("index"), "line")
    return rows.where(F.trim("line") != "")
