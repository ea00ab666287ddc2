import datetime

import pytest
from pyspark.sql import functions as F

from stratum.functions import ids
from stratum.functions.types import Refused, Schema
from stratum.plans import prune
from stratum.sources.federation import redacted
from stratum.streaming import windows
from stratum.streaming.ingest import Admission
from stratum.warehouse import Warehouse

REF = ("lake", "t")


@pytest.fixture
def w(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "w"))
    made.create(REF, ("id", "INT64", False), ("ts", "TIMESTAMP"), ("name", "STRING"), ("amount", "NUMERIC(38,2)"), ("ratio", "FLOAT64"), ("ok", "BOOL"), ("day", "DATE"))
    return made


def total(w):
    return w.table(REF).agg(F.count("*"), F.countDistinct("id")).first()[:2]


def test_coercion_and_errors(w):
    ack = w.ingest.ndjson(REF, "\n".join([
        '{"id": "7", "ts": "2024-01-01T10:00:00+02:00", "amount": "1.25", "ratio": "2e3", "ok": true, "day": "2024-02-29"}', "",
        '{"id": 1.5, "name": 3, "zzz": 1, "aaa": 2}', "[1]", '{"name": "x"}', '{"id": 8, "name": null, "amount": 3}', '{"id": 9, "ok": "true", "day": "2024-02-30"}',
    ]))
    assert ack.inserted == 2
    assert [i for i, _ in ack.errors] == [2, 3, 4, 6]
    assert ack.errors[0][1] == ["id: not a valid INT64", "name: not a valid STRING", "aaa: unknown column", "zzz: unknown column"]
    assert ack.errors[2][1] == ["id: required"] and ack.errors[3][1] == ["ok: not a valid BOOL", "day: not a valid DATE"]
    row = w.table(REF).where("id = 7").first()
    assert row.ts == datetime.datetime(2024, 1, 1, 8) and str(row.amount) == "1.25" and row.ratio == 2000.0


def test_batches_are_idempotent_and_empty_ones_leave_no_file(w):
    rows = [{"id": i} for i in range(3)]
    assert w.ingest.insert(REF, rows, "b").inserted == 3
    assert w.ingest.insert(REF, rows, "b").repeated
    assert w.ingest.ndjson(REF, "nope", "e").inserted == 0
    assert total(w) == (3, 3) and len(w.manifest(REF).entries()) == 1


def test_every_row_once_at_every_step_and_snapshot(w):
    for k in range(3):
        w.ingest.insert(REF, [{"id": 10 * k + i} for i in range(4)])
    before = w.catalog.snapshot()
    m = w.maintenance
    output = m.claim(REF)
    w.ingest.insert(REF, [{"id": 100}])
    assert total(w) == (13, 13)
    made = m.merge(REF, w.manifest(REF).claims()[output], output)
    w.catalog.register(REF, made)
    assert total(w) == (13, 13) and w.table(REF, before).count() == 13
    m.finish(REF, output)
    assert total(w) == (13, 13) and w.table(REF, before).count() == 13
    m.seal(REF)
    assert total(w) == (13, 13)
    assert m.compact(REF) == 1 and total(w) == (13, 13) and len(w.catalog.segments(REF)) == 1
    m.reap(REF, 0)
    assert total(w) == (13, 13)
    assert m.expire(0, ids.milliseconds(ids.generate()) + 10**6) > 0
    assert m.collect(10, 1000) == [] and len(m.collect(10, 2000)) == 2 and total(w) == (13, 13)
    with pytest.raises(Refused, match="snapshot_expired"):
        w.table(REF, 1)


def test_recovery(w):
    w.ingest.insert(REF, [{"id": 1}])
    (key,) = w.manifest(REF).entries()
    orphan = key.replace(".parquet", "X.parquet")
    with open(w.files.path(orphan), "wb") as f:
        f.write(b"PAR1")
    assert w.manifest(REF).recover() == ([orphan], [])
    w.files.delete(key)
    with pytest.raises(Refused, match="hot_tier_unavailable"):
        w.table(REF)


def test_catalog_rules(w):
    assert w.catalog.create_table(REF, w.catalog.schema(REF)) == w.catalog.snapshot()
    for call, reason in (
        (lambda: w.catalog.create_table(REF, Schema.of(("id", "STRING"))), "table_exists"), (lambda: w.catalog.schema(("lake", "no")), "unknown_table"),
        (lambda: w.catalog.create_table(("lake", "a__p1"), Schema.of(("id", "INT64"))), "invalid_identifier"), (lambda: Schema.of(("id", "NUMERIC(39,1)")), "invalid_type"),
        (lambda: w.catalog.put_options(REF, colour="red"), "unknown_option"), (lambda: w.catalog.replace(REF, [], ["x"]), "no_segments"),
        (lambda: w.catalog.put_options(REF, partitions=65), "invalid_partitions"), (lambda: Schema.of(("a", "INT64"), ("A", "INT64")), "duplicate_column"),
    ):
        with pytest.raises(Refused, match=reason):
            call()
    w.catalog.put_options(REF, partitions=4, clustering=["name"], retention=("ts", 1000))
    w.catalog.put_options(REF, partitions=2)
    assert w.catalog.schema(REF).partitions == 4 and w.catalog.retention(REF) == ["ts", 1000]
    w.catalog.log.checkpoint()
    again = Warehouse(w.spark, w.files.root)
    assert again.catalog.snapshot() == w.catalog.snapshot() and again.catalog.tables("lake") == ["t"]


def test_lost_race_decides_again(w):
    other = Warehouse(w.spark, w.files.root)
    other.catalog.snapshot()
    w.catalog.create_dataset("one")
    other.catalog.create_dataset("two")
    assert w.catalog.datasets() == ["lake", "one", "two"]


@pytest.mark.parametrize("sql,reason", [
    ("SELECT 1; SELECT 2", "invalid_query"), ("INSERT INTO lake.t SELECT 1", "not_read_only"), ("SET a = 1", "not_read_only"), ("DROP TABLE lake.t", "not_read_only"),
    ("SELECT * FROM parquet.`/etc/x`", "unknown_table"), ("SELECT reflect('java.lang.System', 'exit')", "function_not_allowed"), ("SELECT * FROM lake.t VERSION AS OF 1", "unsupported_at_clause"),
    ("SELECT * FROM t", "unknown_table"), ("SELECT * FROM read_csv('x')", "table_function_not_allowed"), ("SELECT * FROM a.b.c", "unknown_connection"),
    ("SELECT (SELECT java_method('a', 'b'))", "function_not_allowed"), ("SELECT * FROM lake.t WHERE id IN (SELECT id FROM lake.missing)", "unknown_table"),
])
def test_gate_refuses(w, sql, reason):
    with pytest.raises(Refused, match=reason):
        w.sql(sql)


def test_sql_over_tables(w):
    w.ingest.insert(REF, [{"id": i, "name": f"{{n{i}}}"} for i in range(5)])
    assert w.sql("SELECT t.id FROM lake.t WHERE t.name = '{n3}'").collect()[0].id == 3
    assert w.sql("WITH x AS (SELECT id FROM lake.t) SELECT count(*) AS n FROM x JOIN lake.t y ON x.id = y.id").first().n == 5


@pytest.mark.parametrize("op,literal,out", [("=", 0, True), ("=", 1, False), ("=", 10, False), ("=", 11, True), ("<", 1, True), ("<", 2, False), ("<=", 0, True), ("<=", 1, False), (">", 10, True), (">", 9, False), (">=", 11, True), (">=", 10, False), ("=", "x", False), ("=", None, False)])
def test_pruner(op, literal, out):
    assert prune.excluded({"min": 1, "max": 10, "nulls": 0}, op, literal) is out
    assert prune.excluded({"min": None, "max": None, "nulls": 3}, "=", 1) and not prune.excluded(None, "=", 1)


def test_jobs(w):
    w.ingest.insert(REF, [{"id": i} for i in range(25)])
    job = w.jobs.wait(w.jobs.submit("SELECT id FROM lake.t ORDER BY id", explain="analyze"))
    assert job.state == "done" and job.rows == 25 and "Scan parquet" in job.explain and job.statistics["lake.t"]["hot_rows"] == 25
    page = w.jobs.page(job.id, size=20)
    assert len(page["rows"]) == 20 and [r["id"] for r in w.jobs.page(job.id, page["next"], 20)["rows"]] == [20, 21, 22, 23, 24]
    with pytest.raises(Refused, match="invalid_page_token"):
        w.jobs.page(job.id, "????")
    slow = w.jobs.submit("SELECT count(*) AS n FROM range(0, 1000000000000) a WHERE a.id % 7 = 3")
    w.jobs.cancel(slow.id)
    assert w.jobs.wait(slow, 30).state == "cancelled"
    assert w.jobs.wait(w.jobs.submit("SELECT count(*) AS n FROM range(0, 1000000000000) a WHERE a.id % 7 = 3", timeout=0.5), 30).state == "timeout"
    w.jobs.max_rows = 10
    with pytest.raises(Refused, match="result_too_large"):
        w.jobs.query("SELECT id FROM lake.t")
    assert w.history()[0]["state"] == "error" and len(w.history()) == 4


def test_federated_join(w, tmp_path):
    w.ingest.insert(REF, [{"id": i} for i in (1, 2, 9)])
    url = f"jdbc:derby:{tmp_path}/remote;create=true"
    w.spark.createDataFrame([(1, "a@x"), (2, "b@x")], "id long, email string").write.jdbc(url, "PEOPLE", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    w.federation.register("remote", url, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    rows = w.sql('SELECT t.id, p.EMAIL AS email FROM lake.t t JOIN remote.APP.PEOPLE p ON t.id = p.ID ORDER BY t.id').collect()
    assert [tuple(r) for r in rows] == [(1, "a@x"), (2, "b@x")]
    assert "hush" not in redacted("url?password=hush&x=1 //me:hush@host", "hush")


def test_admission():
    a = Admission(rows=100, size=1000, budget_ms=50)
    a.enter(60, 10)
    with pytest.raises(Refused, match="buffer_full"):
        a.enter(60, 10)
    a.leave(60, 10, 1.0)
    with pytest.raises(Refused, match="overloaded"):
        a.enter(10, 10)


def test_ids_sort_by_time_and_repeat():
    assert ids.generate(5) < ids.generate(6) and ids.milliseconds(ids.generate(77)) == 77
    assert ids.derive(5, "a", "b") == ids.derive(5, "a", "b") != ids.derive(5, "ab", "")


def test_windows(spark):
    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "k") for m in (1, 2, 7, 30)], "at timestamp, key string")
    assert sorted(r.n for r in windows.windowed_counts(rows, "at", ["key"], "5 minutes", "1 hour").collect()) == [1, 1, 2]
    assert sorted(r.n for r in windows.sessions(rows, "at", ["key"], "10 minutes", "1 hour").collect()) == [1, 3]
