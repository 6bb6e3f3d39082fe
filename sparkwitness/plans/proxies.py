"""The driver's tables as inputs of the engine.

The tables are unrelated to the engine's domain; each function states which
columns stand for which input.  Nothing here is semantics of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Measurement samples: a run is an order, its phase the return flag."""
    t = table(spark, sf, "lineitem")
    phase = F.when(F.col("l_returnflag") == "A", "baseline").when(F.col("l_returnflag") == "R", "candidate").otherwise("fix")
    return t.select(
        F.col("l_orderkey").alias("run_id"), phase.alias("phase"), F.col("l_extendedprice").alias("p95_ms"), (F.col("l_extendedprice") / 2).alias("p50_ms"),
        F.col("l_quantity").alias("query_count"), F.col("l_tax").alias("throughput"), F.col("l_discount").alias("error_rate"),
    )


def checks(spark: SparkSession, sf: str) -> DataFrame:
    """Phase checks: a workload is a customer, a run the order's month; the last one of a key counts."""
    t = table(spark, sf, "orders")
    phase = F.when(F.col("o_orderpriority") == "1-URGENT", "baseline").when(F.col("o_orderpriority") == "2-HIGH", "candidate")
    outcome = F.when(F.col("o_orderstatus") == "O", "passed").when(F.col("o_orderstatus") == "F", "test_failed").otherwise("command_failed")
    return t.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), phase.alias("phase"), F.col("o_custkey").alias("workload_id"), outcome.alias("outcome"),
        F.struct("o_orderdate", "o_orderkey").alias("ord"),
    ).where("phase is not null")


CHECKS_SQL = """checks AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'baseline' WHEN '2-HIGH' THEN 'candidate' END AS phase, o_custkey AS workload_id,
  CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'test_failed' ELSE 'command_failed' END AS outcome, o_orderdate AS d, o_orderkey AS k
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
last AS (SELECT run_id, phase, workload_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY run_id, phase, workload_id ORDER BY d DESC, k DESC) AS rn FROM checks) WHERE rn = 1)"""

SAMPLES_SQL = """samples AS (SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'candidate' ELSE 'fix' END AS phase,
  l_extendedprice AS p95_ms, l_extendedprice / 2 AS p50_ms, l_quantity AS query_count, l_tax AS throughput, l_discount AS error_rate FROM lineitem),
summary AS (SELECT run_id, phase, median(p50_ms) AS p50_ms, median(p95_ms) AS p95_ms, median(query_count) AS query_count, median(throughput) AS throughput,
  median(error_rate) AS error_rate, CASE WHEN avg(p95_ms) = 0 THEN 0.0 ELSE stddev_pop(p95_ms) / avg(p95_ms) END AS cv, count(*) AS repetitions FROM samples GROUP BY 1, 2)"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Graph nodes: customers are functions, suppliers classes, parts data tables, nations endpoints, regions load scenarios."""
    kinds = (("customer", "c_custkey", "FUNCTION", "c_name"), ("supplier", "s_suppkey", "CLASS", "s_name"), ("part", "p_partkey", "DATABASE_TABLE", "p_name"), ("nation", "n_nationkey", "ENDPOINT", "n_name"), ("region", "r_regionkey", "LOAD_SCENARIO", "r_name"))
    out = None
    for name, key, kind, label in kinds:
        changed = (F.col(key) % 500 == 0) if name == "customer" else F.lit(False)
        part = table(spark, sf, name).select(
            F.concat(F.lit("table:" if kind == "DATABASE_TABLE" else kind.lower() + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("node_type"), F.col(label).alias("key"),
            (F.lit(0.5) + (F.col(key) % 50) / 100.0).alias("confidence"), changed.alias("changed"),
        )
        out = part if out is None else out.unionByName(part)
    return out


NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{('table' if k == 'DATABASE_TABLE' else k.lower())}:' || {key}::VARCHAR AS id, '{k}' AS node_type, {label} AS key, 0.5::DOUBLE + ({key} % 50) / 100.0::DOUBLE AS confidence, {f'({key} % 500 = 0)' if t == 'customer' else 'false'} AS changed FROM {t}"
    for t, key, k, label in (("customer", "c_custkey", "FUNCTION", "c_name"), ("supplier", "s_suppkey", "CLASS", "s_name"), ("part", "p_partkey", "DATABASE_TABLE", "p_name"), ("nation", "n_nationkey", "ENDPOINT", "n_name"), ("region", "r_regionkey", "LOAD_SCENARIO", "r_name"))
) + ")"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Graph edges, merged on (source, target, edge_type): customers call suppliers, suppliers read parts and serve nations."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    calls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(name("function:", "o_custkey").alias("source"), name("class:", "l_suppkey").alias("target"), F.lit("CALLS").alias("edge_type"))
    reads = lines.select(name("class:", "l_suppkey").alias("source"), name("table:", "l_partkey").alias("target"), F.lit("READS_FROM").alias("edge_type"))
    serves = table(spark, sf, "supplier").select(name("class:", "s_suppkey").alias("source"), name("endpoint:", "s_nationkey").alias("target"), F.lit("SERVES_ENDPOINT").alias("edge_type"))
    valid = table(spark, sf, "nation").select(name("endpoint:", "n_nationkey").alias("source"), name("load_scenario:", "n_regionkey").alias("target"), F.lit("VALIDATED_BY").alias("edge_type"))
    return calls.unionByName(reads).unionByName(serves).unionByName(valid).distinct().withColumn("confidence", F.lit(0.8))


EDGES_SQL = """edges AS (SELECT DISTINCT source, target, edge_type, 0.8::DOUBLE AS confidence FROM (
  SELECT 'function:' || o_custkey::VARCHAR AS source, 'class:' || l_suppkey::VARCHAR AS target, 'CALLS' AS edge_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'class:' || l_suppkey::VARCHAR, 'table:' || l_partkey::VARCHAR, 'READS_FROM' FROM lineitem
  UNION ALL SELECT 'class:' || s_suppkey::VARCHAR, 'endpoint:' || s_nationkey::VARCHAR, 'SERVES_ENDPOINT' FROM supplier
  UNION ALL SELECT 'endpoint:' || n_nationkey::VARCHAR, 'load_scenario:' || n_regionkey::VARCHAR, 'VALIDATED_BY' FROM nation))"""


_STEPS_SQL = """steps AS (SELECT source AS src, target AS dst, edge_type, 0 AS dir, edges.confidence AS w FROM edges JOIN nodes ON id = source
    WHERE node_type IN ('FUNCTION', 'CLASS') AND edge_type IN ('CALLS', 'TESTED_BY', 'READS_FROM', 'WRITES_TO', 'SERVES_ENDPOINT') OR node_type = 'ENDPOINT' AND edge_type = 'VALIDATED_BY'
  UNION ALL SELECT target, source, edge_type, 1, edges.confidence FROM edges JOIN nodes ON id = target WHERE edge_type = 'CALLS' AND node_type IN ('FUNCTION', 'CLASS'))"""


def traversal_sql(depth: int = 3, cap: int = 64) -> str:
    """CTEs of a capped traversal, level by level: ``reached`` and ``notes``."""
    parts = [NODES_SQL, EDGES_SQL, _STEPS_SQL]
    parts.append(f"a0 AS (SELECT id, row_number() OVER (ORDER BY id) AS rk, []::VARCHAR[] AS edge_path, confidence FROM nodes WHERE changed), r0 AS (SELECT *, 0 AS distance FROM a0 WHERE rk <= {cap})")
    for d in range(1, depth + 1):
        parts.append(f"""v{d} AS (SELECT dst, r.rk, edge_type, dir, list_append(edge_path, edge_type) AS edge_path, least(r.confidence, w) AS confidence, row_number() OVER (PARTITION BY dst ORDER BY r.rk, edge_type, dir) AS n
  FROM r{d - 1} r JOIN steps ON src = r.id AND r.distance = {d - 1} WHERE dst NOT IN (SELECT id FROM r{d - 1})),
a{d} AS (SELECT dst AS id, row_number() OVER (ORDER BY rk, dst) AS rk, edge_path, confidence FROM v{d} WHERE n = 1),
r{d} AS (SELECT * FROM r{d - 1} UNION ALL SELECT *, {d} AS distance FROM a{d} WHERE rk <= {cap} - (SELECT count(*) FROM r{d - 1}))""")
    missed = " OR ".join(["(SELECT count(*) FROM a0) > (SELECT count(*) FROM r0)", *[f"(SELECT count(*) FROM a{d}) + (SELECT count(*) FROM r{d - 1}) > (SELECT count(*) FROM r{d})" for d in range(1, depth + 1)]])
    parts.append(f"""reached AS (SELECT n.id, n.node_type, n.key, r.distance, r.edge_path, r.confidence, n.changed FROM r{depth} r JOIN nodes n ON n.id = r.id),
notes AS (SELECT concat_ws(',', CASE WHEN (SELECT count(*) FROM a0) = 0 THEN 'no_changed_graph_nodes' END, CASE WHEN {missed} THEN 'traversal_node_limit' END) AS diagnostics)""")
    return ",\n".join(parts)
