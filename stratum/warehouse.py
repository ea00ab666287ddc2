"""The engine: a folder of segments under a catalog, with ingest, queries, jobs and maintenance."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratum.functions import ids
from stratum.functions.types import Schema
from stratum.operators.maintain import Maintenance
from stratum.plans.jobs import Jobs
from stratum.plans.planner import Planner
from stratum.sources.catalog import Catalog, Ref
from stratum.sources.federation import Federation, redacted
from stratum.sources.files import Files
from stratum.sources.manifest import Manifest
from stratum.streaming.ingest import Ingest


class Warehouse:
    """root: a folder that the driver and all executors reach, a local path or a Hadoop URI."""

    def __init__(self, spark: SparkSession, root: str, **job_options):
        self.spark, self.files, self.turn = spark, Files(spark, root), 0
        self.catalog, self.manifests = Catalog(self.files), {}
        self.planner, self.ingest, self.maintenance = Planner(self), Ingest(self), Maintenance(self)
        self.federation, self.jobs = Federation(self), Jobs(self, **job_options)

    def manifest(self, ref: Ref) -> Manifest:
        self.catalog.schema(ref)
        return self.manifests.setdefault(ref, Manifest(self.files, ref))

    def create(self, ref: Ref, *fields, **options) -> Ref:
        """Create the dataset and the table where they are missing."""
        self.catalog.create_dataset(ref[0])
        self.catalog.create_table(ref, Schema.of(*fields, **options))
        return ref

    def table(self, ref: Ref, at: int | None = None) -> DataFrame:
        return self.planner.table(ref, at)[0]

    def sql(self, text: str, at: int | None = None) -> DataFrame:
        """The query's DataFrame over one snapshot."""
        return self.planner.plan(text, at).df

    def preview(self, ref: Ref, rows: int = 50) -> DataFrame:
        return self.table(ref).limit(rows)

    def scratch(self, df: DataFrame) -> DataFrame:
        """df written once under the root and read again."""
        key = f"_staging/{uuid.uuid4().hex}"
        df.write.parquet(self.files.path(key))
        out = self.spark.read.schema(df.schema).parquet(self.files.path(key))
        out._stratum_key = key
        return out

    def drop_scratch(self, df: DataFrame) -> None:
        self.files.delete(df._stratum_key)

    def remember(self, job: dict) -> None:
        self.files.create(f"_history/{ids.generate()}.json", json.dumps(job).encode())

    def history(self, most: int = 100) -> list[dict]:
        """Jobs, newest first."""
        return [json.loads(self.files.read(f"_history/{n}")) for n in reversed(self.files.names("_history")[-most:])]

    def redacted(self, text: str) -> str:
        return redacted(text, *self.federation.secrets.values())
