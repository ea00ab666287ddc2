"""The relational queries: declarative SQL that Catalyst plans, with the same SQL for a differential check.

A query is one text where both dialects agree and a pair where they don't. `{name}`
stands for a table. They go through the engine: its tables hold a sealed and a hot part
of the rows, and the gate, the rewriting of forms, pruning and the planner are all on the
way. Sums of doubles go through decimals, so that they don't depend on the order in which
partial sums meet.
"""

from __future__ import annotations

import itertools
import math
import re
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import helpers as H
from stratum.warehouse import Warehouse

from . import engine

_TABLE = re.compile(r"\{(\w+)\}")
_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18, 4))) AS DOUBLE)"


def money(column: str) -> str:
    return _MONEY.replace("{0}", column)


SQL: dict[str, str | tuple[str, str]] = {
    # scans and projections
    "scan_project": "SELECT r_regionkey, r_name FROM {region}",
    "scan_expr_alias": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) || '-' || l_linestatus AS flags FROM {lineitem} WHERE l_linenumber = 1",
    "scan_exclude": ("SELECT * EXCEPT (props) FROM {events}", "SELECT * EXCLUDE (props) FROM {events}"),
    "scan_no_from": "SELECT 1 + 1 AS two, 'x' AS x",
    "gen_range": ("SELECT id AS i FROM range(0, 1000)", "SELECT range AS i FROM range(0, 1000)"),
    "gen_series": ("SELECT generate_series AS i FROM generate_series(1, 50)", "SELECT CAST(generate_series AS INTEGER) AS i FROM generate_series(1, 50)"),
    "gen_unnest": ("SELECT unnest(array(1, 2, 3)) AS x", "SELECT unnest([1, 2, 3]) AS x"),
    "gen_repeat": ("SELECT r.x FROM repeat('a', 5) AS r(x)", "SELECT 'a' AS x FROM range(5)"),
    # filters
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice >= 150000 AND o_orderstatus <> 'F'",
    "filter_between": "SELECT o_orderkey, o_orderdate FROM {orders} WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-06-30 00:00:00'",
    "filter_or": "SELECT event_id FROM {events} WHERE event_type = 'click' OR (value > 50 AND user_id < 20)",
    "filter_in_list": "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_is_null": "SELECT c.c_custkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL",
    "filter_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM {orders}",
    "filter_like": "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE '%A%' OR p_name LIKE 'p%1'",
    # subqueries
    "in_subquery": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 5000)",
    "exists_semi": "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "anti_join": "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice = (SELECT max(o_totalprice) FROM {orders})",
    "from_subquery": "SELECT s.k, s.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY c_nationkey) s WHERE s.n > 3",
    "cte_chain": "WITH a AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT n, count(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "join_using": "SELECT k, a.n AS left_n, b.n AS right_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} GROUP BY 1) b USING (k)",
    "join_left": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_acctbal > 0) c RIGHT JOIN {orders} ON c_custkey = o_custkey",
    "join_full": "SELECT a.k AS a_k, b.k AS b_k FROM (SELECT DISTINCT c_nationkey AS k FROM {customer} WHERE c_nationkey < 15) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM {supplier}) b ON a.k = b.k",
    "join_cross_filtered": "SELECT r_name, n_name FROM {region}, {nation} WHERE r_regionkey = n_regionkey",
    "join_on_true": "SELECT r.r_name, n.n_name FROM {region} r JOIN {nation} n ON true",
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey",
    "join_3way": f"SELECT r_name, {money('c_acctbal')} AS balance FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey GROUP BY r_name",
    "join_lateral": "SELECT c.c_custkey, t.o_orderkey FROM {customer} c, LATERAL (SELECT o.o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1) t",
    # aggregates
    "agg_global": f"SELECT count(*) AS n, {money('l_extendedprice')} AS total, min(l_quantity) AS least, max(l_quantity) AS most FROM {{lineitem}}",
    "agg_group": f"SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_tax) AS taxed, {money('l_quantity')} AS quantity, min(l_shipdate) AS first_ship, max(l_discount) AS discount FROM {{lineitem}} GROUP BY l_returnflag, l_linestatus",
    "agg_group_expr": "SELECT year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY year(o_orderdate)",
    "agg_group_alias": "SELECT o_orderkey % 7 AS bucket, count(*) AS n FROM {orders} GROUP BY bucket",
    "agg_group_all": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n, {money('o_totalprice')} AS total FROM {{orders}} GROUP BY ALL",
    "agg_unselected_key": "SELECT count(*) AS n FROM {orders} GROUP BY o_custkey, o_orderstatus",
    "agg_group_only": "SELECT o_orderstatus FROM {orders} GROUP BY o_orderstatus",
    "agg_exact_sum": ("SELECT CAST(sum(CAST(l_orderkey * 1000000000000 AS DECIMAL(38, 0))) AS STRING) AS total FROM {lineitem}", "SELECT CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000000000000) AS VARCHAR) AS total FROM {lineitem}"),
    "agg_avg": "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) / count(l_quantity) AS mean FROM {lineitem} GROUP BY l_returnflag",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM {lineitem} GROUP BY l_returnflag",
    "agg_filter": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM {orders}",
    "agg_ordered": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM {nation} GROUP BY n_regionkey"),
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS mid FROM {lineitem} GROUP BY l_returnflag",
    "agg_percentile": ("SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS p90 FROM {orders}", "SELECT quantile_cont(o_totalprice, 0.9) AS p90 FROM {orders}"),
    "agg_arith": "SELECT o_orderstatus, sum(o_custkey) + 1 AS s, max(o_orderkey) - min(o_orderkey) AS width FROM {orders} GROUP BY o_orderstatus",
    "agg_bool": "SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_f, bool_and(o_totalprice > 1000) AS all_big FROM {orders} GROUP BY o_custkey",
    "agg_arg_max": ("SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_order FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM {orders} GROUP BY o_custkey"),
    "having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    # windows
    "win_over_all": "SELECT o_orderkey, count(*) OVER () AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM {orders}",
    "win_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS quarter, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey, 2, -1) OVER w AS later FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "win_rows_frame": "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM {lineitem}",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    # order and limits
    "sort_nulls_last": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey ORDER BY o_orderkey NULLS LAST, c_custkey LIMIT 500",
    "limit": "SELECT n_name FROM {nation} ORDER BY n_nationkey LIMIT 7",
    "limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 20 OFFSET 15",
    "topk_agg": "SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10",
    "last_n_tail": "SELECT event_id, ts, event_type FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 100",
    # sets
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_nationkey < 12",
    "intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    # scalar functions
    "fn_string": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 2, 4) AS s, replace(c_name, '0', '.') AS r, concat_ws('/', c_name, c_mktsegment) AS j, trim('  x ') AS t FROM {customer}",
    "fn_math": "SELECT o_orderkey, abs(o_orderkey - 500) AS a, o_orderkey % 7 AS m, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, sqrt(CAST(o_orderkey AS DOUBLE)) AS q FROM {orders}",
    "fn_div": ("SELECT o_orderkey, o_orderkey div 7 AS d, try_divide(1.0D, CAST(o_orderkey % 5 AS DOUBLE)) AS t FROM {orders}", "SELECT o_orderkey, o_orderkey // 7 AS d, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1.0 AS DOUBLE) / (o_orderkey % 5) END AS t FROM {orders}"),
    "fn_date_trunc": ("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM {orders} GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM {orders} GROUP BY 1"),
    "fn_interval": "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS due, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, month(o_orderdate) AS mo FROM {orders}",
    "fn_cast": ("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey AS STRING) AS k, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey AS VARCHAR) AS k, CAST(l_extendedprice AS DECIMAL(18, 2)) AS p FROM {lineitem}"),
    "fn_try_cast": "SELECT c_custkey, try_cast(substring(c_name, 1, 3) AS INTEGER) AS bad, try_cast('12' AS INTEGER) AS good FROM {customer}",
    "fn_coalesce": "SELECT c_custkey, coalesce(o_orderkey, -1) AS o, nullif(c_nationkey, 3) AS k FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey",
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}"),
    "fn_array": ("SELECT vec_id, size(embedding) AS n, element_at(embedding, 1) AS first, array_max(embedding) AS most FROM {embeddings}", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, list_max(embedding) AS most FROM {embeddings}"),
    "fn_regexp": ("SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, c_name RLIKE '[5-9]$' AS hit FROM {customer}", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_matches(c_name, '[5-9]$') AS hit FROM {customer}"),
    "fn_version": ("SELECT version() IS NOT NULL AS known", "SELECT version() IS NOT NULL AS known"),
    # forms that are rewritten before Spark parses them
    "qualify": "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "qualify_alias": "SELECT o_custkey, o_orderkey, rank() OVER w AS rk FROM {orders} WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC) QUALIFY rank() OVER w = 1 ORDER BY o_orderkey LIMIT 50",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    "union_all_by_name": "SELECT c_custkey AS id, c_name AS name FROM {customer} UNION ALL BY NAME SELECT s_acctbal AS balance, s_suppkey AS id FROM {supplier}",
    "union_by_name": "SELECT c_nationkey AS k, c_mktsegment AS m FROM {customer} UNION BY NAME SELECT s_nationkey AS k FROM {supplier} ORDER BY k, m LIMIT 1000",
    "qualified_column": ("SELECT star.orders.o_orderkey FROM {orders} WHERE star.orders.o_totalprice > 200000", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 200000"),
    # published benchmark shapes
    "point_lookup": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 77",
    "group_high_cardinality": f"SELECT l_orderkey, count(*) AS n, {money('l_extendedprice')} AS total FROM {{lineitem}} GROUP BY l_orderkey",
    "group_low_cardinality": f"SELECT event_type, count(*) AS n, {money('value')} AS total FROM {{events}} GROUP BY event_type",
}


DATASET = "star"
_CLUSTERING = {"lineitem": ("l_orderkey",), "orders": ("o_orderkey",), "events": ("ts",)}
_TYPES = {"int": "INT64", "bigint": "INT64", "double": "FLOAT64", "string": "STRING", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOL", "date": "DATE"}
_lakes: dict[tuple, Warehouse] = {}
_lock = threading.Lock()


def lake(spark: SparkSession, sf_dir: str, names) -> Warehouse:
    """A warehouse, one a session and folder, with the given tables: two thirds of the rows sealed in several segments, the rest hot."""
    with _lock:
        w = _lakes.setdefault((spark.sparkContext.applicationId, sf_dir), None) or engine.warehouse(spark)
        _lakes[spark.sparkContext.applicationId, sf_dir] = w
        for name in sorted(names):
            rows, ref = _read(spark, sf_dir, name), (DATASET, name)
            if ref[0] in w.catalog.datasets() and name in w.catalog.tables(DATASET):
                continue
            w.create(ref, *((c, _TYPES[kind]) for c, kind in rows.dtypes), clustering=_CLUSTERING.get(name, ()))
            third = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
            sealed = engine.writer.write(rows.where(third > 0), w.catalog.schema(ref), w.files, f"{DATASET}/{name}", least=8 if name in _CLUSTERING else 1)
            w.catalog.register(ref, sealed)
            w.ingest.commit(ref, rows.where(third == 0))
    return w


def plain(name: str) -> bool:
    """Whether the engine's types cover a table; the embeddings' arrays are none of them."""
    return name != "embeddings"


def runner(text: str):
    names = set(_TABLE.findall(text))
    if not all(map(plain, names)):
        return lambda spark, sf_dir: spark.sql(text, **{n: _read(spark, sf_dir, n) for n in names})
    return lambda spark, sf_dir: lake(spark, sf_dir, names).sql(_TABLE.sub(rf"{DATASET}.\1", text))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_asof(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    clicks = _read(spark, sf_dir, "events").where("event_type = 'click'").selectExpr("user_id", "ts AS click_ts", "event_id AS click_id")
    return H.asof_join(events, clicks, ["user_id"], "ts", "click_ts", tie="click_id").select("event_id", "click_ts")


def join_range(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("at"))
    spans = _read(spark, sf_dir, "nation").selectExpr("n_nationkey", "CAST(788918400 + n_nationkey * 1000000 AS BIGINT) AS low", "CAST(788918400 + n_nationkey * 1000000 + 2500000 AS BIGINT) AS high")
    return H.range_join(orders, spans, "at", "low", "high", 1_000_000).select("o_orderkey", "n_nationkey")


def pivot(spark, sf_dir):
    return _read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def clustered_sort(spark, sf_dir):
    """The place of every row in what a seal of a clustered table wrote: one segment, or several that follow each other."""
    w, ref = engine.warehouse(spark), ("sorted", "orders")
    rows = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    w.create(ref, ("o_custkey", "INT64"), ("o_orderdate", "TIMESTAMP"), ("o_orderkey", "INT64"), clustering=("o_custkey", "o_orderdate", "o_orderkey"))
    for i in range(2):
        w.ingest.commit(ref, rows.where(F.pmod("o_orderkey", F.lit(2)) == i))
    w.maintenance.seal(ref, most=math.inf)
    segments = w.catalog.segments(ref)  # in the order in which they were registered
    ends = itertools.accumulate(s["rows"] for s in segments.values())
    starts = spark.createDataFrame([(k.rsplit("/", 1)[1], end - segments[k]["rows"]) for k, end in zip(segments, ends, strict=True)], "name string, start long")
    rows = w.planner.frame(ref, [*segments]).select("*", F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("at"))
    return rows.join(F.broadcast(starts), "name").select("o_custkey", "o_orderdate", "o_orderkey", (F.col("start") + F.col("at")).alias("place"))


def col_stats(spark, sf_dir):
    return H.column_stats(_read(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")))


def approx_distinct(spark, sf_dir):
    """The sketch and the exact count apart: in one aggregate, Spark keeps a sketch for every key."""
    rows = _read(spark, sf_dir, "lineitem")
    sketch, exact = rows.agg(F.approx_count_distinct("l_partkey", 0.02).alias("about")), rows.agg(F.countDistinct("l_partkey").alias("n"))
    return sketch.crossJoin(exact).select((F.abs(F.col("about") / F.col("n") - 1) < 0.1).alias("close"))


def table_sample(spark, sf_dir):
    """A sampling operator: another RNG than any other engine's, so only its size is checked."""
    return _read(spark, sf_dir, "lineitem").sample(0.25, seed=7).agg(F.count("*").alias("n")).crossJoin(_read(spark, sf_dir, "lineitem").agg(F.count("*").alias("whole"))).select((F.abs(F.col("n") / F.col("whole") - 0.25) < 0.03).alias("near_quarter"))


FRAMES = {
    "join_asof": (join_asof, "SELECT e.event_id, c.ts AS click_ts FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts"),
    "join_range": (join_range, "SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON epoch(o_orderdate) >= 788918400 + n_nationkey * 1000000 AND epoch(o_orderdate) < 788918400 + n_nationkey * 1000000 + 2500000"),
    "pivot": (pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"),
    "clustered_sort": (clustered_sort, "SELECT o_custkey, o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderdate NULLS LAST, o_orderkey NULLS LAST) - 1 AS place FROM orders"),
    "col_stats": (col_stats, " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({x}) AS VARCHAR) AS min, CAST(max({x}) AS VARCHAR) AS max, count(*) - count({x}) AS null_count FROM orders" for c, x in ((c, "CAST(o_totalprice AS DECIMAL(18, 2))" if c == "o_totalprice" else c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))),
    "approx_distinct": (approx_distinct, "SELECT true AS close"),
    "table_sample": (table_sample, "SELECT true AS near_quarter"),
}


def queries() -> dict:
    return {k: runner(v if isinstance(v, str) else v[0]) for k, v in SQL.items()} | {k: v[0] for k, v in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _TABLE.sub(r"\1", v if isinstance(v, str) else v[1]) for k, v in SQL.items()} | {k: v[1] for k, v in FRAMES.items()}
