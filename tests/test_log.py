import threading

import pytest
from pyspark.sql import functions as F

from stratum.functions.types import Refused
from stratum.sources import log as logs
from stratum.sources.files import Files
from stratum.sources.log import Log
from stratum.streaming.ingest import Admission, Ingest
from stratum.warehouse import Warehouse

REF = ("lake", "t")


def counter(files):
    return Log(files, "_log", lambda: {"seen": []}, lambda s, a, v: s["seen"].append(a["x"]))


@pytest.fixture(params=[True, False], ids=["local", "hadoop"])
def files(spark, tmp_path, request):
    made = Files(spark, f"file://{tmp_path}/f")
    made.local = request.param  # the other way through Hadoop's file system
    return made


def test_create_is_all_or_nothing(files):
    assert files.create("a/x", b"one") and not files.create("a/x", b"two") and files.read("a/x") == b"one"
    assert files.names("a") == ["x"] and files.missing(["a/x", "a/y", "b/z"]) == ["a/y", "b/z"] and files.size(files.path("a")) == 3


def test_a_crash_before_the_rename_leaves_no_version(files, monkeypatch):
    log = counter(files)
    log.commit(lambda s: [{"x": 1}])
    if files.local:
        monkeypatch.setattr("os.link", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    else:
        monkeypatch.setattr(files, "_rename", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        log.commit(lambda s: [{"x": 2}])
    monkeypatch.undo()
    assert counter(files).state()["seen"] == [1]
    assert log.commit(lambda s: [{"x": 3}]) == 2 and counter(files).state()["seen"] == [1, 3]


def test_writers_and_readers_that_fell_behind_a_checkpoint(files):
    a, late, reader = (counter(files) for _ in range(3))
    a.commit(lambda s: [{"x": 0}])
    late.state(), reader.state()
    for i in range(1, 6):
        a.commit(lambda s, i=i: [{"x": i}])
    a.checkpoint()
    a.commit(lambda s: [{"x": 6}])
    assert reader.state()["seen"] == list(range(7))
    assert late.commit(lambda s: [{"x": 7}]) == 8 and counter(files).state()["seen"] == a.state()["seen"] == list(range(8))


def test_a_checkpoint_between_listing_and_create(files, monkeypatch):
    a, late = counter(files), counter(files)
    a.commit(lambda s: [{"x": 0}])
    late.state()
    create, done = files.create, []

    def slow(key, data):
        if not done:
            done.append(True)
            for i in range(1, 4):
                a.commit(lambda s, i=i: [{"x": i}])
            a.checkpoint()
        return create(key, data)

    late.files = type("Slow", (), {"__getattr__": lambda self, n: slow if n == "create" else getattr(files, n)})()
    assert late.commit(lambda s: [{"x": 9}]) == 5
    assert counter(files).state()["seen"] == [0, 1, 2, 3, 9]


def test_checkpoints_come_by_themselves(files, monkeypatch):
    monkeypatch.setattr(logs, "EVERY", 4)
    a = counter(files)
    for i in range(11):
        a.commit(lambda s, i=i: [{"x": i}])
    assert counter(files).state()["seen"] == list(range(11)) and len(files.names("_log")) == 4


@pytest.fixture
def w(spark, tmp_path):
    made = Warehouse(spark, str(tmp_path / "w"))
    made.create(REF, ("id", "INT64", False), ("name", "STRING"))
    return made


def test_a_second_stream_is_another_one(w, tmp_path):
    for i in range(2):
        w.spark.createDataFrame([(f'{{"id": {10 * i + k}}}',) for k in range(5)] + [("bad",)], "value string").coalesce(1).write.text(str(tmp_path / f"s{i}"))
        w.ingest.stream(REF, str(tmp_path / f"s{i}"), str(tmp_path / f"c{i}")).awaitTermination()
        w.ingest.stream(REF, str(tmp_path / f"s{i}"), str(tmp_path / f"c{i}")).awaitTermination()
    assert w.table(REF).count() == 10
    assert [(r.line, r.errors) for r in w.table(w.ingest.rejects(REF)).collect()] == [("bad", "not a JSON object")] * 2


def test_requests_that_wait_are_committed_together(w):
    acks = []
    threads = [threading.Thread(target=lambda i=i: acks.append(w.ingest.insert(REF, [{"id": i}, {"name": "x"}], f"b{i}"))) for i in range(40)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(a.inserted for a in acks) == 40 and all(a.errors == [(1, ["id: required"])] for a in acks)
    assert w.table(REF).agg(F.countDistinct("id")).first()[0] == 40 and len(w.manifest(REF).entries()) < 20
    same = [w.ingest.submit(REF, '{"id": 99}', "again") for _ in range(5)]
    assert sum(a.result().inserted for a in same) == 1 and w.table(REF).where("id = 99").count() == 1


def test_admission_refuses_what_would_wait(w):
    tight = Ingest(w, window=0.5, admission=lambda: Admission(rows=3))
    first = tight.submit(REF, '{"id": 1}\n{"id": 2}')
    with pytest.raises(Refused, match="buffer_full"):
        tight.submit(REF, '{"id": 3}\n{"id": 4}')
    assert first.result().inserted == 2 and tight.ndjson(REF, '{"id": 3}').inserted == 1


def test_rounds_of_maintenance_and_the_sweep_of_staging(w, monkeypatch):
    for i in range(3):
        w.ingest.commit(REF, w.spark.range(i, i + 1))
    later = 10**15
    assert w.maintenance.tick(later)[REF].startswith("sealed 1") and w.table(REF).count() == 3
    w.ingest.commit(REF, w.spark.range(9, 10))
    monkeypatch.setattr(w.maintenance, "merge", lambda *a: (_ for _ in ()).throw(RuntimeError("no")))
    assert w.maintenance.tick(later)[REF].startswith("failed") and w.maintenance.tick(later + 1)[REF] == "resting"
    monkeypatch.undo()
    assert w.maintenance.tick(later + 10**6)[REF].startswith("sealed") and w.table(REF).count() == 4
    w.files.create("_staging/left/part-0", b"x")
    assert "_staging/left" in w.maintenance.collect(now=later) and w.files.names("_staging") == []


def test_codecs_write_what_they_read(w):
    for codec in ("zstd", "snappy", "gzip", "lz4_raw", "uncompressed"):
        from stratum.sources import writer

        (made,) = writer.write(w.spark.range(20).selectExpr("id", "'x' AS name"), w.catalog.schema(REF), w.files, "lake/t/hot", codec=codec)
        assert made["rows"] == 20 and made["stats"]["id"] == {"min": 0, "max": 19, "nulls": 0}
        assert w.spark.read.parquet(w.files.path(made["key"])).count() == 20


def test_footers_are_read_through_hadoop_too(w):
    from stratum.sources import writer

    (made,) = writer.write(w.spark.range(2000).selectExpr("id", "repeat('y', 50) AS name"), w.catalog.schema(REF), w.files, "lake/t/hot")
    other = Files(w.spark, "file://" + w.files.base)
    other.local = False
    assert {k: v for k, v in made.items() if k != "key"} == writer.footer(other, w.files.path(made["key"]))
    size, tail = other.end(w.files.path(made["key"]), 16)
    assert size == made["bytes"] and tail.read(4) == b"\0" * 4


def test_writes_are_cut_by_size(w, monkeypatch):
    """One commit of much is several tasks and segments, in key order, whether the plan tells its size or not."""
    from stratum.sources import writer

    ref, folder = w.create(("lake", "cut"), ("id", "INT64"), ("name", "STRING"), clustering=("id",)), w.files.path("_in/cut")
    w.spark.range(4000).selectExpr("(id * 7919) % 4000 AS id", "uuid() AS name").write.parquet(folder)
    files, made = w.spark.read.parquet(folder), w.spark.range(4000).selectExpr("id", "uuid() AS name")
    assert writer.estimate(files.where("id > 5")) == w.files.size(f"{folder}/*.parquet") and writer.estimate(made) is None
    monkeypatch.setattr(writer, "PART", 30_000)
    for rows in (files, made):
        found = writer.write(rows, w.catalog.schema(ref), w.files, "lake/cut")
        bounds = [(s["stats"]["id"]["min"], s["stats"]["id"]["max"]) for s in found]
        assert len(found) >= 3 and bounds == sorted(bounds) and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:])) and sum(s["rows"] for s in found) == 4000
    w.ingest.commit(ref, files, "once")
    assert len(w.manifest(ref).entries()) >= 3 and not w.ingest.commit(ref, files, "once") and w.table(ref).count() == 4000
    assert w.files.names("_staging") == []


def test_seals_of_much_are_cut_and_repeatable(w, monkeypatch):
    """A seal in several tasks: parts that follow each other, registered together and once, however often it is tried."""
    from stratum.sources import writer

    ref, m = w.create(("lake", "parts"), ("id", "INT64"), ("name", "STRING"), clustering=("id",)), w.maintenance
    for i in range(2):
        w.ingest.commit(ref, w.spark.range(2000).selectExpr(f"id * 2 + {i} AS id", "uuid() AS name"))
    before = w.catalog.snapshot()
    monkeypatch.setattr(writer, "PART", 20_000)
    output = m.claim(ref)
    keys = w.manifest(ref).claims()[output]
    left = m.merge(ref, keys, output)  # and a crash before it is registered
    assert len(left) >= 3 and w.table(ref).count() == 4000
    late = m.merge(ref, keys, output)
    m.finish(ref, output)
    w.catalog.register(ref, late)  # another that was slower
    assert len({s["of"] for s in w.catalog.segments(ref).values()}) == 1 and not set(w.catalog.segments(ref)) & {s["key"] for s in [*left, *late]}
    assert w.table(ref).selectExpr("count(*)", "count(DISTINCT id)").first()[:2] == (4000, 4000) == w.table(ref, before).selectExpr("count(*)", "count(DISTINCT id)").first()[:2]
    bounds = [(s["stats"]["id"]["min"], s["stats"]["id"]["max"]) for s in w.catalog.segments(ref).values()]
    assert len(bounds) >= 3 and bounds == sorted(bounds) and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))
    assert m.seal(ref) == [] and m.compact(ref) == 0 and w.manifest(ref).claims() == {}
    m.reap(ref, 0)
    assert w.table(ref).count() == 4000


def test_places_in_a_seal_of_several_parts(spark, monkeypatch):
    from differential import compare

    from stratum.operators import relational
    from stratum.sources import writer

    monkeypatch.setattr(writer, "PART", 8_000)
    compare(spark, relational.clustered_sort, relational.oracle_sql()["clustered_sort"])
