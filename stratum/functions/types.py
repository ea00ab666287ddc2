"""The closed table of logical types, identifiers and schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {"INT64": T.LongType(), "FLOAT64": T.DoubleType(), "STRING": T.StringType(), "BOOL": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType()}
_NUMERIC = re.compile(r"NUMERIC\(\s*(\d+)\s*,\s*(\d+)\s*\)", re.I)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
_PARTITION = re.compile(r"__p\d+$")


class Refused(ValueError):
    """A request that the engine doesn't accept; `reason` is a short code."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


def identifier(name: str, what: str = "name") -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name) or (what == "table" and _PARTITION.search(name)):
        raise Refused("invalid_identifier", f"{what} {name!r}")
    return name


def spark_type(name: str) -> T.DataType:
    """The Spark type of an API type name."""
    if simple := _SIMPLE.get(name.strip().upper()):
        return simple
    if (m := _NUMERIC.fullmatch(name.strip())) and 0 < int(m[1]) <= 38 and int(m[2]) <= int(m[1]):
        return T.DecimalType(int(m[1]), int(m[2]))
    raise Refused("invalid_type", name)


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = True

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type)


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]
    clustering: tuple[str, ...] = ()
    partitions: int = 1

    @staticmethod
    def of(*fields, clustering=(), partitions=1) -> Schema:
        """Fields are (name, type) or (name, type, nullable)."""
        made = tuple(f if isinstance(f, Field) else Field(*f) for f in fields)
        if not made:
            raise Refused("empty_schema")
        for f in made:
            identifier(f.name, "column")
            spark_type(f.type)
        if len({f.name.lower() for f in made}) < len(made):
            raise Refused("duplicate_column")
        return Schema(made, tuple(clustering), partitions)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def struct(self) -> T.StructType:
        """All columns nullable, as files may lack some."""
        return T.StructType([T.StructField(f.name, f.spark, True) for f in self.fields])

    def projection(self, present: list[str]) -> list[Column]:
        """Every column in declared order and type; a typed null for one that isn't present. Undeclared columns are refused."""
        if extra := sorted(set(present) - set(self.names)):
            raise Refused("undeclared_columns", ", ".join(extra))
        return [(F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.spark).alias(f.name) for f in self.fields]

    def sort_keys(self) -> list[Column]:
        return [F.col(f"`{c}`").asc_nulls_last() for c in self.clustering if c in self.names]

    def json(self) -> dict:
        return {"fields": [[f.name, f.type, f.nullable] for f in self.fields], "clustering": list(self.clustering), "partitions": self.partitions}

    @staticmethod
    def read(data: dict) -> Schema:
        return Schema(tuple(Field(*f) for f in data["fields"]), tuple(data["clustering"]), data["partitions"])

    def but(self, **changes) -> Schema:
        return replace(self, **changes)
