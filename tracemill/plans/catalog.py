"""The registered core queries and their SQL for DuckDB.

Most queries go through the read-only provider, as a user's SQL does, with the tables as a catalog of
Spark scans; decoders and workflow outputs, which SQL cannot express, are queries without an oracle."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import gate
from ..operators import workflow as wf
from ..operators.outputs import query_outputs
from ..operators.provider import fresh_session, run
from ..operators.table import Table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def bound(spark: SparkSession, sf_dir: str, sql: str, params: dict | None = None) -> DataFrame:
    """One read-only statement over the tables it names, through gate, binding and a session of its own."""
    text, args = gate.bind(sql, params)
    session = fresh_session(spark)
    frames = {t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    return run(session, gate.series(text), args, frames)


#: name: SQL that Spark and DuckDB read alike.
SHARED = {
    "qualified_projection": "SELECT o.o_orderkey AS order_key, o.o_totalprice AS price FROM orders o",
    "select_star": "SELECT * FROM nation",
    "arithmetic_projection": "SELECT n_nationkey + 1 AS next_key, n_nationkey * 2 - 3 AS other FROM nation",
    "constant_projection": "SELECT 1 AS one, 'x' AS letter",
    "where_false": "SELECT n_name FROM nation WHERE FALSE",
    "half_open_window": "SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'",
    "like_in": "SELECT p_partkey, p_type FROM part WHERE p_type NOT LIKE '%STEEL%' AND p_size IN (1, 5, 10, 20)",
    "case_between": "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'mid' WHEN o_totalprice > 50000 THEN 'high' ELSE 'low' END AS band FROM orders",
    "join_using": "SELECT l_orderkey AS order_key, l_linenumber AS line, o_orderstatus AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "three_way_fusion": "SELECT o_orderkey AS order_key, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "left_join_null_fill": "SELECT c_custkey AS k, COUNT(o_orderkey) AS orders_seen, CAST(COALESCE(SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS cents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "full_join": "SELECT r_regionkey AS r, n_nationkey AS n FROM region FULL JOIN nation ON r_regionkey = n_regionkey AND n_nationkey > 10",
    "right_join": "SELECT r_name, n_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_regionkey < 2",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "in_subquery": "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "theta_join": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "cross_join_group_count_distinct": "SELECT r_name, COUNT(*) AS n, COUNT(DISTINCT n_regionkey) AS regions FROM region CROSS JOIN nation GROUP BY r_name",
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "group_count_order": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type",
    "count_distinct": "SELECT event_type, COUNT(user_id) AS n, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "distinct_values": "SELECT DISTINCT event_type, user_id FROM events",
    "coalesce_sum": "SELECT CAST(COALESCE(SUM(event_id), 0) AS BIGINT) AS s FROM events WHERE event_type = 'no such type'",
    "avg_three_keys": "SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, ROUND(AVG(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber",
    "having": "SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 3",
    "filtered_aggregate": "SELECT event_type, COUNT(*) FILTER (WHERE value > 0) AS pos, COUNT(*) AS n FROM events GROUP BY event_type",
    "statistics": "SELECT l_returnflag AS f, ROUND(STDDEV_SAMP(l_quantity), 6) AS sd, ROUND(VAR_POP(l_quantity), 6) AS vp, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag",
    "median": "SELECT l_linenumber AS n, MEDIAN(l_quantity) AS m FROM lineitem GROUP BY l_linenumber",
    "rollup": "SELECT o_orderstatus AS s, o_orderpriority AS p, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube": "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "row_number_window": "SELECT o_orderkey AS k, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM orders",
    "rank_window": "SELECT p_partkey AS k, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part",
    "ntile_window": "SELECT c_custkey AS k, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM customer",
    "lag_lead_window": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events",
    "frame_window": "SELECT event_id, CAST(SUM(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events",
    "range_window": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_nationkey < 10",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT n_nationkey FROM nation",
    "order_limit": "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50",
    "top1": "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 1",
    "scalar_subquery": "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)",
    "correlated_subquery": "SELECT o_orderkey AS k FROM orders o WHERE o_totalprice > (SELECT AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte_select": "WITH big AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_name AS name, n FROM big JOIN customer ON c_custkey = k WHERE n > 2",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    "string_functions": "SELECT n_nationkey AS k, UPPER(n_name) AS u, SUBSTRING(n_name, 2, 3) AS s, CAST(LENGTH(n_name) AS BIGINT) AS l, REPLACE(n_name, 'N', 'n') AS r, TRIM(CONCAT(' ', n_name, ' ')) AS t, CAST(POSITION('T' IN n_name) AS BIGINT) AS p FROM nation",
    "repeat": "SELECT n_nationkey AS k, REPEAT('x', n_nationkey) AS xs FROM nation",
    "date_functions": "SELECT o_orderkey AS k, CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(MONTH(o_orderdate) AS BIGINT) AS m, CAST(DATE_TRUNC('month', o_orderdate) AS DATE) AS first_day, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "math_functions": "SELECT l_orderkey AS k, l_linenumber AS n, ABS(l_tax - l_discount) AS a, ROUND(l_extendedprice, 1) AS r, ROUND(SQRT(l_quantity), 6) AS q, l_orderkey % 7 AS m, GREATEST(l_tax, l_discount) AS g, LEAST(l_tax, l_discount) AS l, NULLIF(l_linenumber, 3) AS z FROM lineitem",
    "interval_clip": (
        "WITH e AS (SELECT event_id, user_id, event_id * 10 AS ts, LEAD(event_id * 10) OVER (PARTITION BY user_id ORDER BY event_id) - event_id * 10 AS dur FROM events) "
        "SELECT user_id, CAST(SUM(LEAST(ts + dur, 5000) - GREATEST(ts, 1000)) AS BIGINT) AS clipped FROM e WHERE ts < 5000 AND ts + dur > 1000 GROUP BY user_id"
    ),
    "adjacent_interval_sum": (
        "WITH s AS (SELECT user_id AS cpu, event_type AS thread, event_id AS clock, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS until FROM events) "
        "SELECT cpu, thread, CAST(SUM(until - clock) AS BIGINT) AS busy, COUNT(*) AS slices FROM s WHERE until IS NOT NULL AND thread <> 'idle' GROUP BY cpu, thread"
    ),
    "slice_join_sum": (
        "SELECT o_custkey AS thread, c_name AS name, COUNT(*) AS slices, CAST(SUM(l_linenumber) AS BIGINT) AS dur FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey "
        "WHERE o_custkey <> 0 AND l_linenumber IS NOT NULL GROUP BY o_custkey, c_name"
    ),
    "clock_conversion": (
        "WITH snapshot AS (SELECT 'boot' AS domain, 1000 AS reading UNION ALL SELECT 'mono', 400) "
        "SELECT event_id, event_id - f.reading + t.reading AS converted FROM events JOIN snapshot f ON f.domain = 'boot' JOIN snapshot t ON t.domain = 'mono'"
    ),
    "continuity_gaps": (
        "WITH s AS (SELECT user_id, event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) "
        "SELECT user_id, COUNT(*) AS gaps, MAX(event_id - prev) AS widest FROM s WHERE event_id - prev > 20 GROUP BY user_id"
    ),
    "missing_parents": "SELECT l_orderkey AS k FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)",
    "pricing_summary": (
        "SELECT l_returnflag AS f, l_linestatus AS s, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue "
        "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
    ),
    "revenue_by_nation": (
        "SELECT n_name AS nation, COUNT(*) AS n, CAST(ROUND(SUM(l_extendedprice * (1 - l_discount))) AS BIGINT) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    ),
}

#: name: (Spark SQL, DuckDB SQL, parameters) where the spelling differs.
TWO = {
    "filter_param_join": (
        "SELECT l_orderkey AS order_key, l_linenumber AS line, c_name AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= $minimum ORDER BY order_key, line",
        "SELECT l_orderkey AS order_key, l_linenumber AS line, c_name AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 25",
        {"minimum": 25},
    ),
    "equality_param": ("SELECT event_id FROM events WHERE event_type = $kind AND user_id < $most", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id < 40", {"kind": "click", "most": 40}),
    "array_cardinality": ("SELECT vec_id, CARDINALITY(embedding) AS n, element_at(embedding, 1) AS first FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first FROM embeddings", None),
    "struct_field": (
        "SELECT k, s['label'] AS label FROM (SELECT n_nationkey AS k, named_struct('label', n_name, 'size', n_regionkey) AS s FROM nation) t",
        "SELECT n_nationkey AS k, n_name AS label FROM nation", None,
    ),
    "cast_date_text": ("SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders", "SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders", None),
    "cast_bigint": ("SELECT CAST(0 AS BIGINT) AS z, CAST(COUNT(*) AS BIGINT) AS n FROM region", "SELECT CAST(0 AS BIGINT) AS z, CAST(COUNT(*) AS BIGINT) AS n FROM region", None),
    "values_rows": ("VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(column1, column2)", None),
    "range_rows": ("SELECT id FROM range(100)", "SELECT range AS id FROM range(100)", None),
    "generate_series_rows": ("SELECT value FROM generate_series(1, 100)", "SELECT CAST(generate_series AS INTEGER) AS value FROM generate_series(1, 100)", None),
    "double_quoted_name": ('SELECT "n_name" AS "self" FROM nation', 'SELECT "n_name" AS "self" FROM nation', None),
    "regex_replace": ("SELECT n_nationkey AS k, regexp_replace(n_name, '[0-9]+', '#') AS r FROM nation", "SELECT n_nationkey AS k, regexp_replace(n_name, '[0-9]+', '#', 'g') AS r FROM nation", None),
    "floor_ceil": ("SELECT l_orderkey AS k, l_linenumber AS n, CAST(FLOOR(l_extendedprice) AS BIGINT) AS f, CAST(CEIL(l_extendedprice) AS BIGINT) AS c FROM lineitem",) * 2 + (None,),
    "string_aggregate": (
        "SELECT n_regionkey AS r, LISTAGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", None,
    ),
    "explode_array": (
        "SELECT vec_id, p AS at, x FROM embeddings LATERAL VIEW posexplode(embedding) e AS p, x",
        "SELECT vec_id, CAST(i - 1 AS INTEGER) AS at, x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)", None,
    ),
    "qualify_first": (
        "SELECT k, p FROM (SELECT o_custkey AS c, o_orderkey AS k, o_totalprice AS p, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", None,
    ),
    "describe_relation": (
        "DESCRIBE region", "SELECT * FROM (VALUES ('r_regionkey', 'int', 'YES'), ('r_name', 'string', 'YES')) t(column_name, data_type, is_nullable)", None,
    ),
    "information_schema_columns": (
        "SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'nation'",
        "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, data_type)", None,
    ),
}


def as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last event of the user of the customer's number up to then: one sort per user, no pairs."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("order_key"), F.lit(None).cast("long").alias("event_id"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("k"), F.expr("ts - interval 25 years").alias("at"), F.lit(None).cast("long").alias("order_key"), "event_id")
    w = Window.partitionBy("k").orderBy("at", F.col("order_key").isNotNull(), F.coalesce("event_id", "order_key")).rowsBetween(Window.unboundedPreceding, 0)
    both = orders.unionByName(events).withColumn("last_event", F.last("event_id", ignorenulls=True).over(w))
    return both.filter("order_key is not null").select("order_key", "last_event")


AS_OF_SQL = """
SELECT o.o_orderkey AS order_key, (SELECT arg_max(e.event_id, (e.ts, e.event_id)) FROM events e WHERE e.user_id = o.o_custkey AND e.ts - INTERVAL 25 YEAR <= o.o_orderdate) AS last_event FROM orders o
"""


def trace_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a text trace, decoded again: relation and row count of the decoder's output."""
    from ..sources import ftrace

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = events.select("event_id", F.format_string("worker-%d [%03d] d.... %d.%06d: %s", F.col("user_id"), F.col("user_id") % 4, F.col("event_id"), F.lit(5), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("tracing_mark_write: "), "event_type")).otherwise(F.concat(F.lit("custom_"), "event_type", F.lit(": x")))).alias("value"))
    decoded = ftrace.decode_lines(lines.withColumnRenamed("event_id", "n"), ftrace.Header("nop", False), "boot")
    out = [f.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, f in sorted(decoded.relations.items())]
    result = out[0]
    for f in out[1:]:
        result = result.union(f)
    return result


def workflow_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workflow with a nested run, its outputs published and queried below the schema `output`."""
    @wf.workflow(name="filter-events", description="Events of one type")
    def inner(ctx: wf.Context, *, kind: str):
        return Table.from_frame(bound(ctx.spark, sf_dir, "SELECT event_id, user_id FROM events WHERE event_type = $kind", {"kind": kind}))

    @wf.workflow(name="count-events", description="Events by user")
    def outer(ctx: wf.Context, *, kind: str = "click"):
        ctx.run("demo", "filter-events", kind=kind)
        return {"main": Table.from_frame(bound(ctx.spark, sf_dir, "SELECT user_id, COUNT(*) AS n FROM events WHERE event_type = $kind GROUP BY user_id", {"kind": kind}))}

    store = wf.SessionStore(Path(tempfile.mkdtemp()))
    host = wf.Host(spark, store, {"demo": [inner, outer]})
    session = store.create()
    done = host.run(session, "demo", "count-events", {})
    return query_outputs(spark, done.outputs, "SELECT user_id, n FROM output.main")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name, sql in SHARED.items():
        out[name] = lambda spark, sf_dir, sql=sql: bound(spark, sf_dir, sql)
    for name, (sql, _, params) in TWO.items():
        out[name] = lambda spark, sf_dir, sql=sql, params=params: bound(spark, sf_dir, sql, params)
    out |= {"as_of_join": as_of_events, "trace_relations": trace_relations, "workflow_outputs": workflow_outputs}
    return out


def oracle_sql() -> dict[str, str]:
    return SHARED | {name: duck for name, (_, duck, _) in TWO.items()} | {"as_of_join": AS_OF_SQL}
