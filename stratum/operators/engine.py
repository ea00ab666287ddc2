"""Queries that run the storage engine over the given tables; their SQL is plain SQL on the originals."""

from __future__ import annotations

import atexit
import datetime
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.types import Refused
from stratum.sources import writer
from stratum.warehouse import Warehouse

EVENTS = ("analytics", "events")
_FIELDS = (("event_id", "INT64", False), ("ts", "TIMESTAMP"), ("user_id", "INT64"), ("event_type", "STRING"), ("value", "FLOAT64"), ("props", "STRING"))


def warehouse(spark: SparkSession) -> Warehouse:
    """A new warehouse in the folder that all executors share; on one machine, without such a setting, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise Refused("no_shared_folder", "set spark.checkpoint.dir")
        shared = tempfile.mkdtemp(prefix="stratum-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    made = Warehouse(spark, f"{shared.rstrip('/')}/warehouse-{uuid.uuid4().hex}")
    atexit.register(_gone, made)
    return made


def _gone(w: Warehouse) -> None:
    try:
        w.files.delete("")
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")


def filled(spark: SparkSession, sf_dir: str, parts: int = 4, **options) -> Warehouse:
    """A warehouse whose events came in `parts` commits."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS, **options)
    rows = events(spark, sf_dir)
    for i in range(parts):
        w.ingest.commit(EVENTS, rows.where(F.pmod("event_id", F.lit(parts)) == i))
    return w


TWO_TIERS = "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, min(ts) AS first FROM analytics.events WHERE event_id >= 10 GROUP BY event_type ORDER BY n DESC LIMIT 10"


def two_tiers(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Two thirds of the events sealed, the others hot."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    rows = events(spark, sf_dir)
    w.ingest.commit(EVENTS, rows.where("event_id % 3 <> 0"))
    w.maintenance.seal(EVENTS)
    w.ingest.commit(EVENTS, rows.where("event_id % 3 = 0"))
    return w


def two_tier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_tiers(spark, sf_dir).sql(TWO_TIERS)


def membership_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after each step of a seal, all over the same rows."""
    w = filled(spark, sf_dir, 3)
    n = lambda: w.table(EVENTS).agg(F.count("*")).first()[0]
    steps, m = [("hot", n())], w.maintenance
    output = m.claim(EVENTS)
    steps.append(("claimed", n()))
    made = m.merge(EVENTS, w.manifest(EVENTS).claims()[output], output)
    steps.append(("merged", n()))
    w.catalog.register(EVENTS, made)
    steps.append(("registered", n()))
    m.finish(EVENTS, output)
    steps.append(("retired", n()))
    m.reap(EVENTS, 0)
    steps.append(("reaped", n()))
    return spark.createDataFrame(steps, "step string, n long")


def clustered(spark: SparkSession, sf_dir: str, by: str) -> Warehouse:
    """Events in eight segments, clustered by a column."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS, clustering=(by,))
    w.catalog.register(EVENTS, writer.write(events(spark, sf_dir), w.catalog.schema(EVENTS), w.files, "analytics/events", least=8))
    return w


def _pruned(spark: SparkSession, sf_dir: str, by: str, sql: str) -> DataFrame:
    """A query over eight segments, with whether it read less than half of them, all uses of the table together."""
    plan = clustered(spark, sf_dir, by).planner.plan(sql)
    scanned = plan.statistics["analytics.events"]
    return plan.df.withColumn("pruned", F.lit(scanned["sealed_files"] < scanned["sealed_files_total"] / 2))


BETWEEN = "SELECT event_id, value FROM {0} WHERE event_id BETWEEN 100 AND 160"
TIME = "SELECT event_id, ts FROM {0} WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-05 12:00:00'"
LIST = "SELECT event_id, value FROM {0} WHERE event_id IN (3, 40, 41)"
NESTED = "WITH a AS (SELECT event_id AS i, user_id FROM {0}), b AS (SELECT * FROM (SELECT event_id, value FROM {0}) s WHERE s.event_id < 50) SELECT a.i, b.value FROM a JOIN b ON a.i = b.event_id WHERE a.i BETWEEN 10 AND 60"


def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, "event_id", BETWEEN.format("analytics.events"))


def pruned_scan_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, "ts", TIME.format("analytics.events"))


def pruned_scan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pruned(spark, sf_dir, "event_id", LIST.format("analytics.events"))


def pruned_scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uses of a table, by a common table expression and a subquery, each pruned by its own conditions."""
    return _pruned(spark, sf_dir, "event_id", NESTED.format("analytics.events"))


def log_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer and a reader that fell behind a checkpoint of the log, and go on."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    rows = events(spark, sf_dir)
    part = lambda i: rows.where(F.pmod("event_id", F.lit(3)) == i)
    w.ingest.commit(EVENTS, part(0))
    late = Warehouse(spark, w.files.root)
    late.table(EVENTS)
    w.ingest.commit(EVENTS, part(1))
    w.manifest(EVENTS).log.checkpoint()
    w.catalog.log.checkpoint()
    late.ingest.commit(EVENTS, part(2))
    return Warehouse(spark, w.files.root).table(EVENTS)


def parquet_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of many files loaded into several segments."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    folder = w.files.path("_in/parquet")
    events(spark, sf_dir).repartition(20).write.parquet(folder)
    w.maintenance.target = w.files.size(folder) // 5
    w.ingest.load(EVENTS, folder, "parquet")
    return w.table(EVENTS).withColumn("several", F.lit(len(w.manifest(EVENTS).entries()) > 3))


def group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand small requests at once: few segments, every row once."""
    w = warehouse(spark)
    ref = w.create(("analytics", "small"), ("id", "INT64", False), ("name", "STRING"))
    acks = [w.ingest.submit(ref, f'{{"id": {i}, "name": "n{i}"}}', f"b{i}") for i in range(1000)]
    again = [w.ingest.submit(ref, f'{{"id": {i}, "name": "n{i}"}}', f"b{i}") for i in range(0, 1000, 10)]
    assert sum(a.result().inserted for a in acks) == 1000 and all(a.result().repeated for a in again)
    return w.table(ref).withColumn("few", F.lit(len(w.manifest(ref).entries()) <= 20))


def schema_evolution_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = filled(spark, sf_dir, 2)
    w.catalog.put_options(EVENTS, fields=[("note", "STRING")])
    w.ingest.commit(EVENTS, spark.createDataFrame([(-1, "new")], "event_id long, note string"))
    w.maintenance.seal(EVENTS)
    return w.sql("SELECT event_id, note FROM analytics.events")


def seal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = filled(spark, sf_dir, 4, clustering=("user_id", "ts"))
    w.maintenance.seal(EVENTS)
    return w.table(EVENTS)


def compaction_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    for i in range(3):
        w.ingest.commit(EVENTS, events(spark, sf_dir).where(F.pmod("event_id", F.lit(3)) == i))
        w.maintenance.seal(EVENTS)
    w.maintenance.compact(EVENTS)
    files = len(w.catalog.segments(EVENTS))
    return w.table(EVENTS).withColumn("files", F.lit(files))


def retention_segment_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    rows, schema = events(spark, sf_dir), w.catalog.schema(EVENTS)
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    edge = low + (high - low) / 2
    edge = edge.replace(microsecond=0, second=0, minute=0, hour=0)
    for part in (rows.where(F.col("ts") < F.lit(edge)), rows.where(F.col("ts") >= F.lit(edge))):
        w.catalog.register(EVENTS, writer.write(part, schema, w.files, "analytics/events"))
    w.catalog.put_options(EVENTS, retention=("ts", 86_400_000))
    w.maintenance.retain(EVENTS, edge + datetime.timedelta(days=1))
    return w.table(EVENTS).select("event_id")


def dedupe_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a manifest: of each entry the furthest along counts, once. Entries are counted by the commit that wrote them, in one segment or several."""
    from stratum.plans.planner import deduplicated

    w = filled(spark, sf_dir, 3)
    before = list(w.manifest(EVENTS).entries().items())
    w.maintenance.claim(EVENTS)
    after = list(w.manifest(EVENTS).entries().items())
    merged = deduplicated([*before, *after, *before])
    return spark.createDataFrame([(len({e["commit"] for e in merged.values()}), len({e["commit"] for e in merged.values() if e["claim"] is not None}), sum(e["rows"] for e in merged.values()))], "entries long, claimed long, row_total long")


def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    folder = w.files.path("_in/ndjson")
    rows = events(spark, sf_dir)
    rows.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props")).alias("value")).unionAll(spark.createDataFrame([('{"event_id": "x", "other": 1}',), ("not json",), ("",)], "value string")).write.text(folder)
    ack = w.ingest.load(EVENTS, folder, batch_id="one")
    assert len(ack.errors) == 2 and w.ingest.load(EVENTS, folder, batch_id="one").repeated
    return w.table(EVENTS)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark)
    ref = w.create(("analytics", "customers"), ("c_custkey", "INT64", False), ("c_name", "STRING"), ("c_nationkey", "INT64"), ("c_acctbal", "NUMERIC(18,2)"), ("c_mktsegment", "STRING"))
    folder = w.files.path("_in/csv")
    spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")).write.csv(folder, header=True)
    w.ingest.load(ref, folder, "csv")
    return w.table(ref)


def _json() -> Column:
    return F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "user_id", "event_type", "value", "props")).alias("value")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spools of NDJSON files, each its own stream with its own checkpoint, into the hot tier; bad lines go to the table of rejects."""
    w = warehouse(spark)
    w.create(EVENTS, *_FIELDS)
    for i in range(2):
        spool = w.files.path(f"_in/spool{i}")
        events(spark, sf_dir).where(F.pmod("event_id", F.lit(2)) == i).select(_json()).repartition(2).unionAll(spark.createDataFrame([("not json",)], "value string")).write.text(spool)
        w.ingest.stream(EVENTS, spool, w.files.path(f"_in/marks{i}"), maxFilesPerTrigger=2).awaitTermination()
    assert w.table(w.ingest.rejects(EVENTS)).count() == 2
    return w.table(EVENTS)


def partial_final_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials over shards of files, merged by a final aggregate: the same as one aggregate."""
    w = filled(spark, sf_dir, 4)
    shards = [spark.read.parquet(w.files.path(k)) for k in sorted(w.manifest(EVENTS).entries())]
    exact = F.sum(F.col("value").cast("decimal(18,4)"))
    parts = [s.groupBy("event_type").agg(F.count("*").alias("n"), exact.alias("s"), F.min("value").alias("least")) for s in shards]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionAll(p)
    return merged.groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("s").cast("double").alias("total"), F.min("least").alias("least"))


_PLAIN = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
SQL = {
    "two_tier_union": "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, min(ts) AS first FROM events WHERE event_id >= 10 GROUP BY event_type ORDER BY n DESC LIMIT 10",
    "membership_rule": "SELECT step, (SELECT count(*) FROM events) AS n FROM (VALUES ('hot'), ('claimed'), ('merged'), ('registered'), ('retired'), ('reaped')) t(step)",
    "pruned_scan": f"SELECT *, true AS pruned FROM ({BETWEEN.format('events')})",
    "pruned_scan_ts": f"SELECT *, true AS pruned FROM ({TIME.format('events')})",
    "pruned_scan_in": f"SELECT *, true AS pruned FROM ({LIST.format('events')})",
    "pruned_scan_nested": f"SELECT *, true AS pruned FROM ({NESTED.format('events')})",
    "log_checkpoint": _PLAIN,
    "parquet_load": f"SELECT *, true AS several FROM ({_PLAIN})",
    "group_commit": "SELECT range AS id, 'n' || range AS name, true AS few FROM range(0, 1000)",
    "schema_evolution_pad": "SELECT event_id, CAST(NULL AS VARCHAR) AS note FROM events UNION ALL SELECT -1, 'new'",
    "seal_merge": _PLAIN,
    "compaction_equivalence": f"SELECT *, 1 AS files FROM ({_PLAIN})",
    "retention_segment_drop": "SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', min(ts) + (max(ts) - min(ts)) / 2) FROM events)",
    "dedupe_manifest": "SELECT CAST(3 AS BIGINT) AS entries, CAST(3 AS BIGINT) AS claimed, (SELECT count(*) FROM events) AS row_total",
    "ndjson_roundtrip": _PLAIN,
    "csv_roundtrip": "SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(18, 2)) AS c_acctbal, c_mktsegment FROM customer",
    "stream_ingest": _PLAIN,
    "partial_final_equivalence": "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total, min(value) AS least FROM events GROUP BY event_type",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
