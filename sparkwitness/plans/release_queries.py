"""Queries over canaries and journals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import release as rl
from ..session import ship_package, table
from .registry import query

POLICY = rl.Policy(max_error_rate=0.3, max_latency_ms=60.0, minimum_samples=3, telemetry_max_age_seconds=40_000)


def observations(spark, sf):
    """Canary observations: a release is a user, a window a day of events."""
    day = F.date_trunc("day", F.col("ts"))
    end = lambda c: F.expr(f"timestampdiff(SECOND, {c}, date_trunc('day', ts) + interval 1 day)")
    g = table(spark, sf, "events").groupBy("user_id", day.cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"), F.max("value").alias("latency_ms"), F.min(end("ts")).alias("telemetry_age_seconds"),
        F.count_if(F.col("event_type") == "purchase").alias("verifications"), F.count_if(F.col("event_type") == "click").alias("traces"),
    )
    u = F.col("user_id")
    return g.withColumns({"validation_passed": u % 11 != 0, "telemetry_available": u % 13 != 0, "window_minimum": F.when(u % 2 == 0, 4).otherwise(3), "observed_at": F.col("day"), "deadline_at": F.lit("2024-01-03").cast("date"), "latency_ms": F.when(u % 17 != 0, F.col("latency_ms"))})


_OBS_SQL = """o AS (SELECT user_id, ts::DATE AS day, count(*) AS sample_count, avg((event_type = 'error')::INT) AS error_rate, CASE WHEN user_id % 17 <> 0 THEN max(value) END AS latency_ms,
min((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) // 1000000) AS age, count(*) FILTER (event_type = 'purchase') AS verifications, count(*) FILTER (event_type = 'click') AS traces FROM events GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN user_id % 11 = 0 THEN 'rollback/staging validation failed' WHEN user_id % 13 = 0 THEN 'pause/telemetry unavailable' WHEN age > 40000 THEN 'pause/telemetry is stale' WHEN sample_count < CASE WHEN user_id % 2 = 0 THEN 4 ELSE 3 END THEN 'pause/insufficient telemetry samples'
WHEN latency_ms IS NULL THEN 'pause/telemetry metrics are incomplete' WHEN error_rate > 0.3 THEN 'rollback/error-rate SLO breached' WHEN latency_ms > 60 THEN 'rollback/latency SLO breached' WHEN verifications = 0 THEN 'pause/validation is not linked to a verification run'
WHEN traces = 0 THEN 'pause/telemetry is not linked to a recorded trace' WHEN day < DATE '2024-01-03' THEN 'pause/canary window is still observing' ELSE 'promote/validation passed; canary window complete' END AS r FROM o)"""


def _decided(spark, sf):
    return rl.canary(observations(spark, sf), POLICY)


@query("a22_canary_decisions", f"WITH {_OBS_SQL} SELECT user_id, day, sample_count, split_part(r, '/', 1) AS action, split_part(r, '/', 2) AS reason FROM d")
def a22(spark, sf):
    """First of the ordered canary rules."""
    return _decided(spark, sf).select("user_id", "day", "sample_count", "action", "reason")


@query(
    "a23_deployment_lifecycle",
    f"""WITH {_OBS_SQL}, x AS (SELECT user_id, day, split_part(r, '/', 1) AS action FROM d), y AS (SELECT *, coalesce(max((action IN ('promote', 'rollback'))::INT) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM x)
SELECT user_id, CASE WHEN bool_or(action = 'rollback') THEN 'rolled_back' WHEN bool_or(action = 'promote') THEN 'promoted' WHEN bool_or(action = 'pause') THEN 'paused' ELSE 'released' END AS status, count(*) AS observations, arg_max(action, day) AS decision FROM y WHERE done = 0 GROUP BY 1""",
)
def a23(spark, sf):
    """Observations up to a terminal decision, status by precedence, last decision."""
    live = rl.lifecycle(_decided(spark, sf), "user_id", "day")
    event = F.when(F.col("action") == "rollback", "rolled_back").when(F.col("action") == "promote", "promoted").otherwise("paused")
    events = live.select("user_id", event.alias("event"), F.col("action").alias("decision"), F.col("day").alias("ord"))
    return rl.summary(events, "user_id", "ord")


def journal(spark, sf):
    t = table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.sha2(F.col("text"), 256).alias("digest"), F.col("role")))
    return t.select("conv_id", "turn", body.alias("body"))


_CHAIN_SQL = """b AS (SELECT conv_id, turn, '{"digest":"' || sha256(text) || '","role":"' || role || '"}' AS body FROM conversations),
ch(conv_id, turn, previous_hash, record_hash) AS (SELECT conv_id, turn, '', sha256('' || chr(31) || body) FROM b WHERE turn = 0 UNION ALL SELECT b.conv_id, b.turn, ch.record_hash, sha256(ch.record_hash || chr(31) || b.body) FROM ch JOIN b ON b.conv_id = ch.conv_id AND b.turn = ch.turn + 1)"""


@query("w12_hash_chain", f"WITH RECURSIVE {_CHAIN_SQL} SELECT conv_id, turn AS sequence, previous_hash, record_hash FROM ch")
def w12(spark, sf):
    """Hash-chained journal, the hash carried over sorted records."""
    return rl.chain(journal(ship_package(spark), sf), "conv_id", "turn", "body").drop("body")


@query("w12_chain_verification", "SELECT conv_id, CASE WHEN conv_id % 5 = 0 AND count(*) > 1 THEN 'record was modified' END AS fault, count(*) AS records FROM conversations GROUP BY 1")
def w12_verify(spark, sf):
    """Tampered journals are found by the record before and its digest, in parallel."""
    ch = rl.chain(journal(ship_package(spark), sf), "conv_id", "turn", "body")
    forged = ch.withColumn("body", F.when((F.col("conv_id") % 5 == 0) & (F.col("sequence") == 1), F.lit("{}")).otherwise(F.col("body")))
    return rl.verify_chain(forged, "conv_id")


@query(
    "j09_confirmed_claims",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 30 AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 10 = l_suppkey % 10 AND o_orderstatus = 'O')",
)
def j09(spark, sf):
    """Claimed ids backed by passed facts on every key."""
    facts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 10).alias("digit"), F.when(F.col("o_orderstatus") == "O", "passed").otherwise("failed").alias("status"))
    claims = table(spark, sf, "lineitem").where("l_quantity > 30").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_suppkey") % 10).alias("digit"))
    return rl.confirmed(claims, facts, ["l_orderkey", "digit"]).drop("digit")
