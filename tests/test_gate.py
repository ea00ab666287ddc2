import datetime

import pytest
from pyspark.sql import functions as F

from stratum.functions.types import Refused
from stratum.plans import dialect
from stratum.warehouse import Warehouse

REF = ("lake", "t")


@pytest.fixture(scope="module")
def w(spark, tmp_path_factory):
    made = Warehouse(spark, str(tmp_path_factory.mktemp("gate") / "w"))
    made.create(REF, ("id", "INT64", False), ("ts", "TIMESTAMP"), ("name", "STRING"), clustering=("ts",))
    made.create(("lake", "u"), ("id", "INT64"), ("extra", "STRING"))
    for day in range(1, 6):
        rows = spark.range(day * 10, day * 10 + 10).select("id", (F.lit(datetime.datetime(2024, 1, day)) + F.make_dt_interval(hours=F.col("id").cast("int") % 10)).cast("timestamp_ntz").alias("ts"), F.concat(F.lit("n"), "id").alias("name"))
        made.ingest.commit(REF, rows)
    made.ingest.commit(("lake", "u"), spark.createDataFrame([(11, "x"), (52, "y")], "id long, extra string"))
    return made


@pytest.mark.parametrize("sql,reason", [
    ("SELECT TRANSFORM(id) USING 'echo pwned' AS (x STRING) FROM lake.t", "not_"), ("EXECUTE IMMEDIATE 'DROP TABLE x'", "not_read_only"), ("BEGIN SELECT 1; END", "not_read_only"),
    ("SELECT * FROM IDENTIFIER('parquet.`/etc`')", "not_allowed"), ("SELECT * FROM IDENTIFIER('lake' || '.t')", "not_allowed"), ("SELECT IDENTIFIER('ver' || 'sion')()", "not_allowed"),
    ("SELECT IDENTIFIER('id') FROM lake.t", "not_allowed"), ("SELECT * FROM text.`/etc/passwd`", "unknown_table"), ("SELECT * FROM csv.`/etc/passwd`", "unknown_table"), ("SELECT * FROM STREAM(lake.t)", "not_allowed"),
    ("SELECT from_xml('<a/>', 'a INT', map('rowValidationXSDPath', '/etc/passwd'))", "function_not_allowed"), ("SELECT from_protobuf(x, 'M', '/etc/passwd') FROM lake.t", "function_not_allowed"), ("SELECT no_such_udf(1)", "function_not_allowed"),
    ("SELECT system.builtin.reflect('java.lang.System', 'exit')", "function_not_allowed"), ("SELECT try_reflect('a', 'b')", "function_not_allowed"), ("SELECT current_user()", "function_not_allowed"), ("SELECT current_user", "not_allowed"),
    ("SELECT * FROM python_worker_logs()", "table_function_not_allowed"), ("SELECT input_file_name() FROM lake.t", "function_not_allowed"), ("SHOW TABLES", "not_read_only"), ("CREATE TABLE x AS SELECT 1", "not_read_only"), ("CACHE TABLE x AS SELECT 1", "not_read_only"),
    ("SELECT * FROM lake.t LATERAL VIEW reflect('a', 'b') q", "function_not_allowed"), ("WITH a AS (SELECT java_method('a', 'b')) SELECT * FROM a", "function_not_allowed"), ("SELECT 1 FROM lake.t UNION BY NAME SELECT * FROM parquet.`/x`", "unknown_table"),
    ("SELECT id FROM lake.t UNION ALL BY NAME SELECT id FROM lake.u ORDER BY reflect('a', 'b')", "function_not_allowed"), ("EXPLAIN SELECT 1", "not_read_only"), ("DESCRIBE lake.t", "not_read_only"),
])
def test_refused(w, sql, reason):
    with pytest.raises(Refused, match=reason):
        w.sql(sql)


def test_session_functions_and_views_are_out_of_reach(w):
    w.spark.udf.register("mine", lambda x: x, "string")
    w.spark.range(1).createOrReplaceTempView("secret")
    for sql in ("SELECT mine('a')", "SELECT * FROM secret", "SELECT * FROM global_temp.secret"):
        with pytest.raises(Refused):
            w.sql(sql)


def test_the_analysed_plan_is_checked(w):
    """Even a plan that got past the parser reads nothing but the files of its tables."""
    other = w.spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    with pytest.raises(Refused, match="outside"):
        w.planner.gate.checked(other, set(), set())
    with pytest.raises(Refused, match="not_allowed"):
        w.planner.gate.checked(w.spark.range(1).select(F.udf(lambda x: x)("id")), set(), set())


def files(w, sql, zone="UTC"):
    w.spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        plan = w.planner.plan(sql)
        return plan.statistics["lake.t"]["hot_files"], plan.df.count()
    finally:
        w.spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("sql,want", [
    ("SELECT * FROM lake.t WHERE ts >= TIMESTAMP '2024-01-04 00:00:00'", (2, 20)), ("SELECT * FROM lake.t WHERE ts = TIMESTAMP_NTZ '2024-01-02 03:00:00'", (1, 1)), ("SELECT * FROM lake.t WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-02 23:00:00'", (1, 10)),
    ("SELECT * FROM lake.t WHERE ts > '2024-01-05'", (1, 9)), ("SELECT * FROM lake.t WHERE DATE '2024-01-05' <= ts", (1, 10)), ("SELECT * FROM lake.t WHERE id IN (12, 13, 51)", (2, 3)), ("SELECT * FROM (SELECT id AS i FROM lake.t) s WHERE s.i < 20", (1, 10)),
    ("WITH a AS (SELECT * FROM lake.t) SELECT * FROM a WHERE id >= 50", (1, 10)), ("SELECT a.id FROM lake.t a JOIN lake.t b ON a.id = b.id WHERE a.id < 20 AND b.id > 15", (2, 4)), ("SELECT * FROM lake.t WHERE id < 20 OR id > 55", (5, 14)),
    ("SELECT * FROM lake.t t JOIN lake.u u ON t.id = u.id WHERE u.id > 40", (2, 1)), ("SELECT * FROM lake.t LEFT JOIN (SELECT * FROM lake.u WHERE id > 40) u USING (id)", (5, 50)), ("SELECT * FROM lake.t WHERE name = 'n21'", (1, 1)), ("SELECT * FROM lake.t WHERE name IN ('n21', 'n33') AND id > 30", (1, 1)),
])
def test_files_that_are_read(w, sql, want):
    assert files(w, sql) == want


def test_timestamps_are_read_in_the_zone_of_the_session(w):
    sql = "SELECT * FROM lake.t WHERE ts >= TIMESTAMP '2024-01-04 00:00:00'"
    for zone in ("America/New_York", "Asia/Tokyo", "UTC"):
        n, rows = files(w, sql, zone)
        assert rows == 20 and n in (2, 3)


def test_forms(w):
    one = lambda sql: [tuple(r) for r in w.sql(sql).collect()]
    assert one("SELECT id, name FROM lake.t WHERE id < 20 QUALIFY row_number() OVER (ORDER BY id DESC) = 1") == [(19, "n19")]
    assert one("SELECT * FROM (SELECT id FROM lake.t QUALIFY row_number() OVER (ORDER BY id) <= 2) s WHERE s.id > 10") == [(11,)]
    assert one("SELECT DISTINCT ON (id % 2) id FROM lake.t ORDER BY id % 2, id DESC") == [(58,), (59,)]
    assert one("SELECT id, extra FROM lake.u UNION ALL BY NAME SELECT name, id FROM lake.t WHERE id = 10 ORDER BY id LIMIT 2") == [(10, None, "n10"), (11, "x", None)]
    assert one("SELECT g.i FROM generate_series(1, 3) AS g(i)") == [(1,), (2,), (3,)] and one("SELECT * FROM unnest(array(5, 6)) WHERE unnest > 5") == [(6,)]
    assert one("SELECT lake.t.id FROM lake.t WHERE lake.t.name = 'lake.t.id' OR lake.t.id = 10") == [(10,)]
    assert one("SELECT 'QUALIFY generate_series(1, 2) {x}' AS a, repeat('ab', 2) AS b -- QUALIFY 1") == [("QUALIFY generate_series(1, 2) {x}", "abab")]
    assert dialect.rewritten("SELECT a FROM b") == "SELECT a FROM b"


@pytest.mark.parametrize("sql", [
    "SELECT u.id, x.id AS t FROM lake.u, LATERAL (SELECT t.id FROM lake.t WHERE t.id >= u.id ORDER BY t.name DESC, t.id LIMIT 1) x",
    "SELECT u.id, (SELECT t.id FROM lake.t t WHERE t.id % 10 = u.id % 10 ORDER BY t.name DESC LIMIT 1) AS t FROM lake.u",
])
def test_limited_subqueries_keep_their_order(w, sql):
    """The rank over which Spark limits a correlated subquery has the sort keys, selected or not."""
    df = w.sql(sql)
    assert df.columns == ["id", "t"]
    assert all("DESC" in x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "windowspecdefinition" in x)
    assert sorted(map(tuple, df.collect())) == ([(11, 59), (52, 59)] if "LATERAL" in sql else [(11, 51), (52, 52)])


def test_limited_subqueries_that_stay():
    for sql in ("SELECT a FROM (SELECT a FROM b ORDER BY a LIMIT 1)", "SELECT a FROM (SELECT b AS a FROM c ORDER BY 1 DESC, a LIMIT 1)", "SELECT a FROM (SELECT a FROM b ORDER BY c)", "SELECT a FROM b ORDER BY c LIMIT 1"):
        assert dialect.rewritten(sql) == sql


def test_windows_over_all_rows_are_aggregates(w):
    df = w.sql("SELECT id, count(*) OVER () AS n, 2 * max(abs(id)) OVER () AS m, rank() OVER (PARTITION BY id ORDER BY ts) AS r FROM lake.t WHERE id < 30 ORDER BY id LIMIT 2")
    assert [tuple(r) for r in df.collect()] == [(10, 20, 58, 1), (11, 20, 58, 1)] and df.columns == ["id", "n", "m", "r"]
    assert "windowspecdefinition(specifiedwindowframe" not in df._jdf.queryExecution().optimizedPlan().toString()
    for sql in (
        "SELECT a, count(*) OVER () AS n FROM b GROUP BY a", "SELECT DISTINCT a, count(*) OVER () AS n FROM b", "SELECT sum(count(*)) OVER () AS n FROM b", "SELECT collect_list(a) AS l, count(*) OVER () AS n FROM b",
        "SELECT a + 1 AS x, sum(x) OVER () AS n FROM b", "SELECT count(*) FILTER (WHERE a) OVER () AS n FROM b", "SELECT count(*) OVER () FROM b", "SELECT row_number() OVER () AS n FROM b", "SELECT count(*) OVER () AS n FROM b TABLESAMPLE (5 ROWS)",
    ):
        assert dialect.rewritten(sql) == sql


def test_sketches_are_not_kept_by_key(spark):
    """The exact count's keys and the sketch are aggregated apart."""
    from stratum.operators import relational

    plan = relational.approx_distinct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all("approx_count_distinct" not in x for x in plan.split("\n") if "keys=[l_partkey" in x)
