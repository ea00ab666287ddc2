"""Scratch tables in the folder that all executors share, and size-checked joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, on one machine only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "folder" not in _local:
        _local["folder"] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _local["folder"], ignore_errors=True)
    return f"file://{_local['folder']}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage and outlives a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, names) -> list[str]:
    """The columns of df but those of the given names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """SHA-256 of doc_id and text, which tells rows apart; null and empty texts are one, a null doc_id is none of the others."""
    name = F.col(doc_id).cast("string")
    head = F.coalesce(F.concat(F.length(name).cast("string"), F.lit(":"), name), F.lit("-"))
    return F.unhex(F.sha2(F.concat(head, F.coalesce(F.col(text), F.lit(""))), 256))


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; counting must be cheap (a written table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a path all machines share; else use --py-files)."""
    import os
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in (known := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    # workers are reused: large arrays go back to the system when they are freed, not to a heap that only grows
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "1")
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(4 << 20))
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(4 << 20))


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with this package importable in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
