"""Queries over run history, state machines and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as hi
from ..session import table
from ..sources import artifacts as ar
from .registry import query


@query("j01_runs_of_repositories", "SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ")
def j01(spark, sf):
    """Runs with their repositories, filtered by membership."""
    c = table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate")


@query("s13_key_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def s13(spark, sf):
    """Row by its key."""
    return table(spark, sf, "orders").where("o_orderkey = 42")


@query("w01_latest_per_parent", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def w01(spark, sf):
    """Latest child of each parent."""
    return hi.latest(table(spark, sf, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("w02_top_finding", "SELECT l_orderkey, l_discount, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount END DESC NULLS LAST, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_discount) AS n FROM lineitem) WHERE n = 1")
def w02(spark, sf):
    """Most confident finding, nulls last, then the earliest."""
    confidence = F.when(F.col("l_returnflag") != "N", F.col("l_discount"))
    return hi.latest(table(spark, sf, "lineitem"), "l_orderkey", confidence.desc_nulls_last(), F.asc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber"), F.asc("l_discount")).select("l_orderkey", "l_discount", "l_shipdate")


@query("w04_recent_runs", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def w04(spark, sf):
    """The 25 most recent runs."""
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25)


@query(
    "j21_history_view",
    """WITH v AS (SELECT l_orderkey, count(*) AS verifications, count(*) FILTER (l_returnflag = 'R') AS failed, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1)
SELECT o_orderkey, c_name, coalesce(verifications, 0) AS verifications, coalesce(failed, 0) AS failed, last_seen FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN v ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""",
)
def j21(spark, sf):
    """History with children aggregated first, no lookup per run."""
    v = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("verifications"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.max("l_shipdate").alias("last_seen"))
    runs = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    j = runs.join(c, "o_custkey").join(v, "o_orderkey", "left")
    return j.select("o_orderkey", "c_name", F.coalesce("verifications", F.lit(0)).alias("verifications"), F.coalesce("failed", F.lit(0)).alias("failed"), "last_seen")


_STATES_SQL = """st AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'purchase' THEN 'inconclusive' ELSE 'failed' END AS status FROM events),
mv AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM st)"""


def states(spark, sf):
    e = F.col("event_type")
    s = F.when(e == "signup", "queued").when(e == "view", "running").when(e == "click", "succeeded").when(e == "purchase", "inconclusive").otherwise("failed")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", s.alias("status"))


@query("a27_status_transitions", f"WITH {_STATES_SQL} SELECT event_id, before, status FROM mv WHERE before <> status AND (before, status) NOT IN (('queued', 'running'), ('queued', 'cancelled'), ('running', 'succeeded'), ('running', 'failed'), ('running', 'cancelled'), ('running', 'inconclusive'))")
def a27(spark, sf):
    """Transitions that the run state machine does not allow."""
    return hi.transition_faults(spark, states(spark, sf), "user_id", "ts", "event_id").select("event_id", "before", "status")


@query(
    "a31_create_or_get",
    "SELECT sha256(text) AS key, count(*) AS requests, min(doc_id) AS first_id, CASE WHEN count(*) = 1 THEN 'created' WHEN count(DISTINCT lang || '/' || source) = 1 THEN 'reused' ELSE 'conflict' END AS outcome FROM documents GROUP BY 1",
)
def a31(spark, sf):
    """Idempotent creation by key with conflict detection."""
    d = table(spark, sf, "documents").withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    return hi.create_or_get(d, "key", F.concat_ws("/", "lang", "source"), "doc_id").select("key", "requests", F.col("first.doc_id").alias("first_id"), "outcome")


@query("j22_orphan_evidence", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)")
def j22(spark, sf):
    """Evidence whose parent is missing, by anti join."""
    parents = table(spark, sf, "documents").where("n_chars > 1000").select("doc_id")
    return table(spark, sf, "labels").select("doc_id").join(parents, "doc_id", "left_anti")


@query(
    "j08_classification_fallback",
    """WITH cl AS (SELECT 'A' AS phase, 'O' AS workload, 'regression' AS c UNION ALL SELECT 'A', NULL, 'baseline' UNION ALL SELECT 'R', 'F', 'fix')
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(e.c, f.c, 'unclassified') AS classification FROM lineitem LEFT JOIN cl e ON e.phase = l_returnflag AND e.workload = l_linestatus LEFT JOIN cl f ON f.phase = l_returnflag AND f.workload IS NULL""",
)
def j08(spark, sf):
    """Two-key classification with fallback to the phase."""
    cl = spark.createDataFrame([("A", "O", "regression"), ("A", None, "baseline"), ("R", "F", "fix")], "l_returnflag string, l_linestatus string, classification string")
    return hi.workload_names(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"), cl, "l_returnflag", "l_linestatus").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "classification")


@query("g16_fix_commit_and_g17_last_write", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS fix_commit FROM orders GROUP BY 1")
def g16(spark, sf):
    """Single distinct commit or null."""
    return hi.single_fix_commit(table(spark, sf, "orders"), "o_custkey", "o_orderstatus")


@query("g17_last_write_wins", "SELECT o_custkey, o_orderpriority AS phase, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS classification FROM orders GROUP BY 1, 2")
def g17(spark, sf):
    """Classification map, last write wins."""
    return table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("phase")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("classification"))


@query(
    "w10_budget_cutoffs",
    """WITH a AS (SELECT conv_id, turn, ceil(strlen(text) / 4.0)::BIGINT AS token, strlen(text)::BIGINT AS time, sha256(role) AS digest FROM conversations),
u AS (SELECT *, sum(token) OVER w AS used_token, sum(time) OVER w AS used_time, row_number() OVER (PARTITION BY conv_id, digest ORDER BY turn) > 1 AS duplicate FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, used_time::BIGINT AS used_time, used_token::BIGINT AS used_token, CASE WHEN used_time > 900 THEN 'time_budget_exceeded' WHEN used_token > 200 THEN 'token_budget_exceeded' END AS cutoff, duplicate FROM u""",
)
def w10(spark, sf):
    """Running spendings, cutoffs by precedence, duplicate attempts."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.ceil(F.octet_length("text") / F.lit(4)).cast("long").alias("token"), F.octet_length("text").cast("long").alias("time"), F.sha2("role", 256).alias("digest"))
    out = hi.running_budget(hi.duplicate_attempts(t, "conv_id", "digest", "turn"), "conv_id", "turn", {"time": 900, "token": 200})
    return out.select("conv_id", "turn", "used_time", "used_token", "cutoff", "duplicate")


@query(
    "a26_remediation_replay",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 97 = 0 THEN 'token_budget_exceeded' ELSE 'ok' END AS o FROM events),
w(user_id, i, stage, attempts, failed, pending, reason) AS (SELECT DISTINCT user_id, 0, 'context', 0, false, NULL::VARCHAR, NULL::VARCHAR FROM events UNION ALL
  SELECT user_id, i, CASE WHEN stage = 'decide' THEN CASE WHEN why IS NULL THEN 'context' ELSE 'stopped' END WHEN o <> 'ok' THEN 'decide'
      ELSE CASE stage WHEN 'context' THEN 'diagnose' WHEN 'diagnose' THEN 'patch' WHEN 'patch' THEN 'validate' WHEN 'validate' THEN 'verify' ELSE 'decide' END END,
    attempts + (stage = 'context')::INT, stage <> 'decide' AND (failed OR o <> 'ok'), CASE WHEN stage <> 'decide' AND o = 'token_budget_exceeded' THEN o ELSE pending END, why
  FROM (SELECT w.user_id, e.i::INT AS i, stage, attempts, failed, pending, o, CASE WHEN stage = 'decide' THEN CASE WHEN pending IS NOT NULL THEN pending WHEN o = 'ok' AND NOT failed THEN 'verified' WHEN attempts >= 3 THEN 'max_attempts' END END AS why
    FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1 WHERE stage <> 'stopped'))
SELECT user_id, arg_max(stage, i) AS stage, max(attempts) AS attempts, arg_max(reason, i) AS reason FROM (SELECT user_id, i, stage, attempts, coalesce(reason, '') AS r, reason FROM w) GROUP BY 1""",
)
def a26(spark, sf):
    """Replay of the remediation stages."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 97 == 0, "token_budget_exceeded").otherwise("ok").alias("outcome"))
    return hi.replay(e, "user_id", "event_id")


@query(
    "a28_evidence_report",
    """WITH v AS (SELECT l_orderkey AS o_orderkey, count(*) AS verification_count, list_sort(list(l_returnflag || ' ' || l_partkey::VARCHAR || ': ' || l_linestatus)) AS lines FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey AS o_orderkey, count(*) AS finding_count, max(l_discount) AS top FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT o.o_orderkey, coalesce(verification_count, 0) AS verification_count, coalesce(finding_count, 0) AS finding_count, round(top, 6) AS top_confidence, o_orderstatus = 'F' AND coalesce(finding_count, 0) > 0 AS noted FROM orders o LEFT JOIN v ON v.o_orderkey = o.o_orderkey LEFT JOIN f ON f.o_orderkey = o.o_orderkey""",
)
def a28(spark, sf):
    """Assembled report of each run, with notes."""
    return _report(spark, sf).select("o_orderkey", "verification_count", "finding_count", F.round("top_confidence", 6).alias("top_confidence"), ((F.col("o_orderstatus") == "F") & (F.col("finding_count") > 0)).alias("noted"))


def _report(spark, sf):
    t = table(spark, sf, "lineitem")
    v = t.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("phase"), F.col("l_partkey").cast("string").alias("workload"), F.col("l_linestatus").alias("status"))
    f = t.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("fingerprint"), F.col("l_discount").alias("confidence"))
    return hi.evidence_report(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), v, f, "o_orderkey")


@query("s21_markdown_report", "SELECT o_orderkey, '# Run ' || o_orderkey::VARCHAR || coalesce((SELECT string_agg(chr(10) || '- ' || l_returnflag || ' ' || l_partkey::VARCHAR || ': ' || l_linestatus, '' ORDER BY l_returnflag, l_partkey::VARCHAR, l_linestatus) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS markdown FROM orders")
def s21(spark, sf):
    """Markdown of each report."""
    return hi.markdown(_report(spark, sf), "o_orderkey")


@query("j25_plan_equality", "WITH p AS (SELECT o_custkey, o_orderstatus AS phase, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS seq FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2) SELECT a.o_custkey, a.seq = b.seq AS same_sequence, list_sort(list_distinct(a.seq)) = list_sort(list_distinct(b.seq)) AS same_set FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.phase = 'O' AND b.phase = 'F'")
def j25(spark, sf):
    """Plans of two phases compared as sequences and as sets."""
    t = table(spark, sf, "orders")
    side = lambda s, n: t.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias(n))
    j = side("O", "a").join(side("F", "b"), "o_custkey")
    same = lambda x: F.array_sort(F.array_distinct(x))
    return j.select("o_custkey", (F.col("a") == F.col("b")).alias("same_sequence"), (same(F.col("a")) == same(F.col("b"))).alias("same_set"))


@query("j26_checkout_receipt", "SELECT l_orderkey, count(*) AS items, sum(floor(p_retailprice * 100)::BIGINT * l_quantity::BIGINT)::BIGINT AS cents FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def j26(spark, sf):
    """Cart joined with its products in one join, total in cents."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.floor(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    cart = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("q"))
    return cart.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("cents") * F.col("q")).alias("cents"))


@query("j24_owner_patterns", "WITH pt AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS pattern FROM part WHERE p_size = 1 AND p_brand = 'Brand#7') SELECT p_partkey, coalesce(bool_or(contains(p_name, pattern)), false) AS owned FROM part LEFT JOIN pt ON true GROUP BY 1")
def j24(spark, sf):
    """Lines of an owners file to patterns, and paths that contain one."""
    t = table(spark, sf, "part")
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    owner = F.when(F.col("p_brand") == "Brand#7", F.concat(F.lit("*"), first, F.lit("* @team"))).when(F.col("p_brand") == "Brand#8", F.concat(F.lit("# "), first, F.lit(" @x"))).otherwise(first)
    lines = t.where("p_size = 1").select(owner.alias("line"))
    return ar.ownership_signal(t.select("p_partkey", "p_name"), ar.owner_patterns(lines, "line"), "p_name").select("p_partkey", "owned")


@query("g23_item_kinds", "SELECT event_type AS kind, count(*) AS items, count(*) FILTER (value > 50) AS failed FROM events GROUP BY 1")
def g23(spark, sf):
    """Items and failures by kind."""
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("value") > 50).alias("failed"))
