"""Queries over parsed changes, sources and diffs, and over recorded artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parse as pa
from ..session import ship_package, table
from ..sources import artifacts as ar
from .registry import query


def changes(spark, sf):
    """Change sets: one for each customer, of three records."""
    k = F.col("c_custkey")
    rec = lambda *x: F.concat(*[F.concat(v, F.lit("\x00")) for v in x])
    name = F.concat(F.lit("pkg/m"), k.cast("string"))
    first = rec(F.element_at(F.array(*map(F.lit, ("A", "M", "D", "T"))), (k % 4 + 1).cast("int")), F.concat(name, F.lit(".py")))
    second = rec(F.lit("R087"), F.concat(F.lit("old/"), name, F.when(k % 3 == 0, ".txt").otherwise(".py")), F.concat(F.lit("new/"), name, F.when(k % 3 == 1, ".txt").otherwise(".py")))
    third = rec(F.lit("M"), F.concat(name, F.lit(".md")))
    return table(spark, sf, "customer").select("c_custkey", F.concat(first, second, third).alias("records"))


@query(
    "a05_change_classification",
    """SELECT c_custkey, ['added', 'modified', 'deleted', 'modified'][(c_custkey % 4 + 1)::INT] AS change, 'pkg/m' || c_custkey::VARCHAR || '.py' AS path, NULL::VARCHAR AS old_path FROM customer
UNION ALL SELECT c_custkey, ['added', 'deleted', 'renamed'][(c_custkey % 3 + 1)::INT], CASE WHEN c_custkey % 3 = 1 THEN 'old/' ELSE 'new/' END || 'pkg/m' || c_custkey::VARCHAR || '.py', CASE WHEN c_custkey % 3 = 2 THEN 'old/pkg/m' || c_custkey::VARCHAR || '.py' END FROM customer""",
)
def a05(spark, sf):
    """NUL-delimited records to added, modified, deleted and renamed sources."""
    return pa.classify_changes(pa.change_records(changes(spark, sf), "c_custkey", "records"), "c_custkey")


@query(
    "s05_hunk_intervals",
    "SELECT s_suppkey, s_suppkey + 3 AS start, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE s_suppkey % 5 END AS count FROM supplier UNION ALL SELECT s_suppkey, 900, 2 FROM supplier",
)
def s05(spark, sf):
    """Changed line intervals of hunk headers; a missing count is 1."""
    k = F.col("s_suppkey")
    head = F.concat(F.lit("@@ -1,2 +"), (k + 3).cast("string"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(","), (k % 5).cast("string"))), F.lit(" @@ def f():\n+x\n@@ -7 +900,2 @@\n"))
    t = table(spark, sf, "supplier").select("s_suppkey", F.explode(pa.changed_intervals(head)).alias("i"))
    return t.select("s_suppkey", F.col("i.start").cast("long").alias("start"), F.col("i.count").cast("long").alias("count"))


_SOURCE = '''import os
from .db import connect

class Store:
    def total(self, cursor, ids):
        out = 0
        for i in ids:
            cursor.execute("SELECT price FROM products JOIN carts ON x WHERE id = " + i)
        else:
            cursor.execute("DELETE FROM sessions")
        return helper(out)

def helper(x):
    while x:
        def inner(conn):
            conn.execute("UPDATE carts SET y = 1")
        x = 0
    return x
'''


def sources(spark, sf):
    k = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 6 == 5, F.lit("def broken(:\n")).otherwise(F.concat(F.repeat(F.lit("\n"), F.col("n_nationkey") % 3), F.lit(_SOURCE)))
    return table(spark, sf, "nation").select(F.concat(F.lit("shop/s"), k, F.lit(".py")).alias("path"), text.alias("source"))


@query("a30_loop_queries", "SELECT 'shop.s' || n_nationkey::VARCHAR || '.Store.total' AS symbol, [8 + n_nationkey % 3] AS lines FROM nation WHERE n_nationkey % 6 <> 5")
def a30(spark, sf):
    """Database calls inside loops; not in else, reset by nested functions."""
    return pa.loop_queries(pa.python_facts(sources(ship_package(spark), sf)))


@query(
    "a04_symbol_scopes",
    """SELECT 'shop/s' || n_nationkey::VARCHAR || '.py' AS path, k AS kind, 'shop.s' || n_nationkey::VARCHAR || s AS symbol, (f + n_nationkey % 3)::INT AS first, (l + n_nationkey % 3)::INT AS last FROM nation, (VALUES ('class', '.Store', 4, 11), ('function', '.Store.total', 5, 11), ('function', '.helper', 13, 18), ('function', '.helper.inner', 15, 16)) v(k, s, f, l) WHERE n_nationkey % 6 <> 5""",
)
def a04(spark, sf):
    """A4, S3: scopes of each source with their lines."""
    return pa.python_facts(sources(ship_package(spark), sf)).where("kind in ('class', 'function')").select("path", "kind", "symbol", "first", "last")


@query(
    "a03_graph_edges",
    """WITH s AS (SELECT n_nationkey::VARCHAR AS n FROM nation WHERE n_nationkey % 6 <> 5)
SELECT 'file:shop/s' || n || '.py' AS source, k || ':shop.s' || n || d AS target, 'DEFINES' AS edge_type FROM s, (VALUES ('class', '.Store'), ('function', '.Store.total'), ('function', '.helper'), ('function', '.helper.inner')) v(k, d)
UNION SELECT 'function:shop.s' || n || d, 'table:' || t, e FROM s, (VALUES ('.Store.total', 'products', 'READS_FROM'), ('.Store.total', 'carts', 'READS_FROM'), ('.Store.total', 'sessions', 'READS_FROM'), ('.Store.total', 'sessions', 'WRITES_TO'), ('.helper.inner', 'carts', 'WRITES_TO')) v(d, t, e)""",
)
def a03(spark, sf):
    """Graph edges of sources; calls to ambiguous names stay unresolved."""
    return pa.graph_of(pa.python_facts(sources(ship_package(spark), sf)))[1]


def patches(spark, sf):
    k = F.col("s_suppkey")
    path = F.element_at(F.array(*map(F.lit, ("src/a.py", "tests/test_a.py", "loadtests/x.js", "requirements.txt", ".github/workflows/ci.yml"))), (k % 5 + 1).cast("int"))
    minus = F.when(k % 10 == 1, "-def test_gone():").otherwise("-old")
    plus = F.when(k % 7 == 0, "+access_token = abcdefghijkl").otherwise("+new")
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,2 +1,2 @@\n keep\n"), minus, F.lit("\n"), plus, F.lit("\n"))
    return table(spark, sf, "supplier").select(
        "s_suppkey", diff.alias("diff"), F.when(k % 11 == 0, "bbb").otherwise("aaa").alias("base"), F.lit("aaa").alias("expected_base"), F.when(k % 13 == 0, F.lit("0")).otherwise(F.sha2(diff.cast("binary"), 256)).alias("sha256"),
        F.lit(1).alias("files_changed"), F.lit(1).alias("lines_added"), F.when(k % 17 == 0, 2).otherwise(1).alias("lines_deleted"),
    )


@query(
    "a24_patch_validation",
    """SELECT s_suppkey, list_sort(list_filter([CASE WHEN s_suppkey % 11 = 0 THEN 'base_commit_mismatch' END, CASE WHEN s_suppkey % 13 = 0 THEN 'patch_hash_mismatch' END, CASE WHEN s_suppkey % 17 = 0 THEN 'artifact_summary_mismatch' END, CASE WHEN s_suppkey % 7 = 0 THEN 'secret_pattern' END,
CASE WHEN s_suppkey % 5 = 4 THEN 'workflow_file' END, CASE WHEN s_suppkey % 5 = 3 THEN 'dependency_manifest' END, CASE WHEN s_suppkey % 5 = 2 THEN 'verification_fixture_modified' END, CASE WHEN s_suppkey % 5 = 2 THEN 'k6_scenario_modified' END, CASE WHEN s_suppkey % 10 = 1 THEN 'test_function_removed' END], lambda x: x IS NOT NULL)) AS rejections FROM supplier""",
)
def a24(spark, sf):
    """Diffs parsed, then rejected by rules."""
    return pa.validate_patches(pa.parsed_patches(patches(ship_package(spark), sf), "diff"), "diff").select("s_suppkey", "rejections")


@query("g20_diff_stats", "SELECT s_suppkey, ['src/a.py', 'tests/test_a.py', 'loadtests/x.js', 'requirements.txt', '.github/workflows/ci.yml'][(s_suppkey % 5 + 1)::INT] AS path, 1 AS lines_added, 1 AS lines_deleted, 1 AS hunks, false AS binary FROM supplier")
def g20(spark, sf):
    """Statistics of each changed file."""
    return pa.file_stats(pa.parsed_patches(patches(ship_package(spark), sf), "diff"), "s_suppkey")


def summaries(spark, sf):
    """Recorded load-test summaries, half of them in the flat layout."""
    k, v = F.col("p_partkey"), F.col("p_retailprice")
    nested = F.format_string('{"metrics":{"http_req_duration":{"values":{"med":%s,"p(95)":%s,"p(99)":%s}},"http_reqs":{"values":{"rate":%s}},"http_req_failed":{"values":{"rate":0.5}},"database_queries":{"values":{"med":7}}}}', v.cast("string"), (v * 2).cast("string"), (v * 3).cast("string"), k.cast("string"))
    flat = F.format_string('{"metrics":{"http_req_duration":{"med":%s,"p(95)":%s,"p(99)":%s},"http_reqs":{"rate":%s},"http_req_failed":{"value":0.5},"database_queries":{"med":7}}}', v.cast("string"), (v * 2).cast("string"), (v * 3).cast("string"), k.cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, nested).otherwise(flat).alias("summary"))


@query("s06_load_summaries", "SELECT p_partkey, p_retailprice AS p50_ms, p_retailprice * 2 AS p95_ms, p_retailprice * 3 AS p99_ms, p_partkey::DOUBLE AS throughput, 0.5::DOUBLE AS error_rate, 7.0::DOUBLE AS query_count FROM part")
def s06(spark, sf):
    """Nested and flat summaries to one sample row each."""
    return ar.load_samples(summaries(spark, sf), "summary").drop("summary")


@query("s09_coverage_and_history", "SELECT o_custkey, round(avg(least(o_totalprice / 600000.0::DOUBLE, 1.0)) FILTER (o_orderpriority <> '5-LOW'), 3) AS coverage, least(count(*), 20) / 20.0::DOUBLE AS churn FROM orders GROUP BY 1")
def s09(spark, sf):
    """Mean coverage of changed files, and churn from the 20 latest commits."""
    t = table(spark, sf, "orders")
    files = t.select("o_custkey", F.to_json(F.create_map(F.col("o_orderkey").cast("string"), F.struct(F.struct((F.least(F.col("o_totalprice") / 600000.0, F.lit(1.0)) * 100).alias("percent_covered")).alias("summary")))).alias("coverage"), F.col("o_orderkey").cast("string").alias("file"), "o_orderpriority")
    cov = ar.coverage_signal(files.select("o_custkey", "coverage"), files.where("o_orderpriority <> '5-LOW'").select("o_custkey", "file"), "o_custkey")
    churn = ar.churn_signal(t, "o_custkey", "o_orderdate", "o_orderkey")
    return churn.join(cov, "o_custkey", "left").select("o_custkey", F.round("coverage", 3).alias("coverage"), "churn")


@query("s16_write_once", "SELECT doc_id, CASE WHEN n = 1 THEN 'new' WHEN doc_id = low THEN 'new' ELSE 'identical' END AS outcome FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n, min(doc_id) OVER (PARTITION BY text) AS low FROM documents)")
def s16(spark, sf):
    """Write-once artifacts by digest; a retry with the same content is no conflict."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("uri"), F.sha2("text", 256).alias("sha256"))
    return ar.write_once(d, "uri", "sha256", "doc_id").select("doc_id", "outcome")


@query("s17_canonical_graph", "SELECT n_regionkey, '{\"edges\":' || '[' || string_agg('{\"source\":\"n' || n_nationkey::VARCHAR || '\",\"target\":\"r' || n_regionkey::VARCHAR || '\"}', ',' ORDER BY 'n' || n_nationkey::VARCHAR) || '],\"nodes\":[' || string_agg('\"n' || n_nationkey::VARCHAR || '\"', ',' ORDER BY 'n' || n_nationkey::VARCHAR) || ']}' AS payload FROM nation GROUP BY 1")
def s17(spark, sf):
    """Canonical JSON of a graph, nodes, edges and keys sorted."""
    n = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return ar.canonical_graph(table(spark, sf, "nation").select("n_regionkey", n.alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target")), "n_regionkey")


@query("s08_registry", "SELECT p_partkey AS workload_id, p_size AS priority, p_size > 40 AS rejected FROM part")
def s08(spark, sf):
    """JSON registry to typed rows, invalid ones flagged."""
    raw = table(spark, sf, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("workload_id"), F.lit("pytest").alias("workload_type"), F.col("p_size").alias("priority"), F.when(F.col("p_size") > 40, F.lit("../x.py")).otherwise(F.lit("tests/x.py")).alias("definition_path"))).alias("entry"))
    return ar.registry(raw, "entry").select("workload_id", "priority", "rejected")


@query("s20_artifact_integrity", "SELECT doc_id FROM documents WHERE doc_id % 6 = 0")
def s20(spark, sf):
    """Artifacts whose content is not what was recorded."""
    d = table(spark, sf, "documents")
    recorded = d.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    stored = d.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return ar.integrity_faults(recorded, stored).select("doc_id")


@query("s23_recorded_output", "SELECT conv_id, turn, substr(text, 1, 64) AS head, sha256(text) AS digest, strlen(text) AS bytes, length(text) > 64 AS truncated FROM conversations")
def s23(spark, sf):
    """Bounded head and digest of recorded output."""
    return ar.output_head(table(spark, sf, "conversations"), "text", 64).select("conv_id", "turn", "head", "digest", "bytes", "truncated")
