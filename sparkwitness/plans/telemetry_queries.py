"""Queries over telemetry and runtime correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as co
from ..operators import telemetry as te
from ..session import ship_package, table
from ..streaming import state
from . import proxies as p
from .registry import query

_NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_RUNTIME_SQL = "names AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(replace(c_name, '#', '-')) WHEN 2 THEN 'gone ' || c_name ELSE (SELECT min(p_name) FROM part) END AS runtime_name FROM customer)"


@query(
    "a20_runtime_correlation",
    f"""WITH {p.NODES_SQL}, {_RUNTIME_SQL}, k AS (SELECT id, key, {_NORM.format('key')} AS norm FROM nodes WHERE node_type <> 'LOAD_SCENARIO'),
e AS (SELECT key, list(key ORDER BY id) AS keys, min(id) AS id, count(*) AS c FROM k GROUP BY 1), l AS (SELECT norm, list(key ORDER BY id) AS keys, min(id) AS id, count(*) AS c FROM k GROUP BY 1),
j AS (SELECT runtime_name, CASE WHEN e.c = 1 THEN 'exact' WHEN e.c > 1 THEN 'ambiguous' WHEN l.c = 1 THEN 'normalized' WHEN l.c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS method, coalesce(e.keys, l.keys) AS keys, coalesce(e.id, l.id) AS id
FROM names LEFT JOIN e ON e.key = runtime_name LEFT JOIN l ON l.norm = {_NORM.format('runtime_name')})
SELECT runtime_name, CASE WHEN method IN ('exact', 'normalized') THEN 'resolved' ELSE method END AS status, method, CASE WHEN method IN ('exact', 'normalized') THEN keys[1] END AS symbol_key, CASE WHEN method IN ('exact', 'normalized') THEN id END AS graph_node_id,
CASE method WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN method = 'ambiguous' THEN len(keys) ELSE 0 END AS candidates FROM j""",
)
def a20(spark, sf):
    """Runtime names, exact, normalized, ambiguous and unresolved."""
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    low = table(spark, sf, "part").agg(F.min("p_name").alias("low"))
    c = table(spark, sf, "customer").crossJoin(F.broadcast(low))  # one row
    names = c.select(F.when(k == 0, name).when(k == 1, F.lower(F.replace(name, F.lit("#"), F.lit("-")))).when(k == 2, F.concat(F.lit("gone "), name)).otherwise(F.col("low")).alias("runtime_name"))
    return co.correlate(names, p.nodes(spark, sf)).withColumn("candidates", F.size("candidates"))


def spans(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "unavailable").otherwise("ok")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", "props", status.alias("status"))


_SPANS_SQL = "s AS (SELECT user_id, event_id, ts, event_type, props, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unavailable' ELSE 'ok' END AS status, ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.7 AS sampled FROM events)"


@query(
    "a21_telemetry_recording",
    f"""WITH {_SPANS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, sampled ORDER BY ts, event_id) AS n FROM s)
SELECT event_id, CASE WHEN NOT sampled THEN 'sampled_out' WHEN n > 40 THEN 'limited' ELSE status END AS recorded, CASE WHEN NOT sampled THEN 'sampled_out' WHEN n > 40 THEN 'failed' WHEN status = 'unavailable' THEN 'unavailable' ELSE 'healthy' END AS exporter_status FROM n""",
)
def a21(spark, sf):
    """Sampling by run, span cap, exporter status."""
    return te.record(spans(spark, sf), "user_id", ["ts", "event_id"], 0.7, 40).select("event_id", "recorded", "exporter_status")


@query("g15_runtime_summary", f"WITH {_SPANS_SQL} SELECT user_id, array_to_string(list_sort(list_distinct(list(status))), ',') AS statuses, count(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN event_type END) AS resolved, count(DISTINCT CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END) AS unresolved, count(*) AS observations FROM s GROUP BY 1")
def g15(spark, sf):
    """Statuses, symbols and counts of each run."""
    return te.summary(spans(spark, sf).withColumn("hit", F.col("event_type").isin("click", "view")), "user_id", "event_type", "hit")


@query(
    "g05_single_group_counts",
    """WITH g AS (SELECT json_extract_string(props, '$.k') AS trace_id, user_id % 3 AS run, count(*) AS spans FROM events WHERE event_type = 'click' GROUP BY 1, 2), n AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS groups FROM g)
SELECT trace_id, run, spans, groups, CASE WHEN groups = 1 THEN spans END AS valid_spans FROM n""",
)
def g05(spark, sf):
    """Evidence counts by trace, valid only with one group."""
    e = table(spark, sf, "events").where("event_type = 'click'").select(F.get_json_object("props", "$.k").alias("trace_id"), (F.col("user_id") % 3).alias("run"))
    return te.single_group_counts(e, "trace_id", "run")


@query(
    "j02_evidence_join",
    """SELECT json_extract_string(props, '$.k') AS trace_id, c_nationkey, count(*) AS spans FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'view' GROUP BY 1, 2""",
)
def j02(spark, sf):
    """Evidence joined to its run, filtered by kind, counted by JSON key."""
    e = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.get_json_object("props", "$.k").alias("trace_id"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return e.join(c, F.col("user_id") == F.col("c_custkey")).groupBy("trace_id", "c_nationkey").agg(F.count(F.lit(1)).alias("spans"))


@query("s18_artifact_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND strlen(props) <= 8")
def s18(spark, sf):
    """Artifacts within a size bound and young enough."""
    return te.retained(table(spark, sf, "events"), "ts", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), "props", 8).select("event_id")


def _event_stream(spark, sf):
    """The events as a stream of files; as a pattern the path may be one file or a folder of them."""
    path, schema = f"{sf}/events.parque[t]", table(spark, sf, "events").schema
    return ship_package(spark).readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@query("a21_streamed_span_cap", "SELECT user_id AS run_id, event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 40 THEN 'limited' ELSE 'ok' END AS recorded FROM events")
def a21_streamed(spark, sf):
    """A21 as keyed state of a stream: the cap of each run, counted across batches."""
    events = _event_stream(spark, sf).select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return state.drained(state.capped(events, 40))


@query(
    "a23_streamed_lifecycle",
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'rollback' ELSE 'pause' END AS action FROM events),
d AS (SELECT *, coalesce(max((action <> 'pause')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT user_id AS release_id, event_id, action FROM d WHERE done = 0""",
)
def a23_streamed(spark, sf):
    """A23 as keyed state of a stream: observations of a release up to its first terminal decision."""
    e = F.col("event_type")
    action = F.when(e == "purchase", "promote").when(e == "error", "rollback").otherwise("pause")
    observed = _event_stream(spark, sf).select(F.col("user_id").alias("release_id"), "event_id", "ts", action.alias("action"))
    return state.drained(state.lifecycle(observed))
