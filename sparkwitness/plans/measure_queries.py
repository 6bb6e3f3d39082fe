"""Queries over repeated measurements and phase checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measure as m
from . import proxies as p
from .registry import query

PROXY = m.Thresholds(repetitions=2)


def r6(*names):
    return [F.round(F.col(n), 6).alias(n) for n in names]


@query("g01_measurement_summary", f"WITH {p.SAMPLES_SQL} SELECT run_id, phase, round(p50_ms,6) AS p50_ms, round(p95_ms,6) AS p95_ms, round(query_count,6) AS query_count, round(throughput,6) AS throughput, round(error_rate,6) AS error_rate, round(cv,6) AS cv, repetitions FROM summary")
def g01(spark, sf):
    """Medians, population variation, repetitions."""
    return m.summarize(p.samples(spark, sf), "run_id", "phase").select("run_id", "phase", *r6(*m.METRICS, "cv"), "repetitions")


def _summaries(spark, sf):
    """Summaries dealt by run alone, so that comparing two phases needs no second shuffle."""
    return m.summarize(p.samples(spark, sf).repartition("run_id"), "run_id", "phase")


def _compare_sql(left, right):
    return f"""SELECT a.run_id, b.query_count - a.query_count AS query_delta,
  CASE WHEN a.query_count <> 0 THEN b.query_count / a.query_count WHEN b.query_count = 0 THEN 1.0 ELSE 1e308 END AS query_ratio,
  CASE WHEN a.p95_ms <> 0 THEN b.p95_ms / a.p95_ms WHEN b.p95_ms = 0 THEN 1.0 ELSE 1e308 END AS latency_ratio,
  a.cv > 0.2 OR b.cv > 0.2 AS noisy, a.repetitions <> 2 OR b.repetitions <> 2 AS wrong FROM summary a JOIN summary b ON a.run_id = b.run_id AND a.phase = '{left}' AND b.phase = '{right}'"""


_LADDER = """CASE WHEN wrong THEN 'sample_count' WHEN query_delta >= 10 AND query_ratio >= 5 THEN 'query_regression' WHEN noisy THEN 'noisy' WHEN latency_ratio >= 2 THEN 'latency_regression' ELSE 'none' END"""
_STATUS = "CASE WHEN reason IN ('sample_count', 'noisy') THEN 'inconclusive' WHEN reason = 'none' THEN 'passed' ELSE 'failed' END"


@query(
    "a07_differential_verdict",
    f"""WITH {p.SAMPLES_SQL}, c AS ({_compare_sql('baseline', 'candidate')}), d AS (SELECT *, {_LADDER} AS reason FROM c)
SELECT run_id, round(query_delta,6) AS query_delta, round(query_ratio,6) AS query_ratio, round(latency_ratio,6) AS latency_ratio, noisy, reason, {_STATUS} AS status,
({_STATUS}) = 'failed' AND ((query_delta >= 10 AND query_ratio >= 5) OR latency_ratio >= 2) AS finding FROM d""",
)
def a07(spark, sf):
    """Differential comparison of baseline and candidate."""
    s = _summaries(spark, sf)
    out = m.compare(s.where("phase = 'baseline'").drop("phase"), s.where("phase = 'candidate'").drop("phase"), "run_id", PROXY)
    return out.select("run_id", *r6("query_delta", "query_ratio", "latency_ratio"), "noisy", "reason", "status", "finding")


@query(
    "a08_three_way_fix_verdict",
    f"""WITH {p.SAMPLES_SQL}, x AS (SELECT run_id, {_STATUS} AS s FROM (SELECT *, {_LADDER} AS reason FROM ({_compare_sql('baseline', 'fix')}))),
y AS (SELECT run_id, {_STATUS} AS s FROM (SELECT *, {_LADDER} AS reason FROM ({_compare_sql('fix', 'candidate')})))
SELECT x.run_id, x.s AS base_fix, y.s AS fix_candidate,
CASE WHEN x.s = 'inconclusive' OR y.s = 'inconclusive' THEN 'inconclusive' WHEN x.s = 'failed' THEN 'failed' WHEN y.s = 'failed' THEN 'passed' ELSE 'failed' END AS status,
CASE WHEN x.s = 'inconclusive' OR y.s = 'inconclusive' THEN 'inconclusive' WHEN x.s = 'failed' THEN 'regression' WHEN y.s = 'failed' THEN 'improvement' ELSE 'no_material_change' END AS classification
FROM x JOIN y ON x.run_id = y.run_id""",
)
def a08(spark, sf):
    """Verdict of a fix against baseline and candidate."""
    s = _summaries(spark, sf)
    of = lambda phase: s.where(F.col("phase") == phase).drop("phase")
    return m.three_way(m.compare(of("baseline"), of("fix"), "run_id", PROXY), m.compare(of("fix"), of("candidate"), "run_id", PROXY), "run_id")


def last_checks(spark, sf):
    return m.latest(p.checks(spark, sf), ["run_id", "phase", "workload_id"], F.col("ord").desc()).drop("ord")


@query(
    "j03_outcome_buckets",
    f"""WITH {p.CHECKS_SQL}, j AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.workload_id, b.workload_id) AS workload_id, coalesce(a.outcome, 'passed') AS baseline, coalesce(b.outcome, 'passed') AS candidate
FROM (SELECT * FROM last WHERE phase = 'baseline') a FULL JOIN (SELECT * FROM last WHERE phase = 'candidate') b ON a.run_id = b.run_id AND a.workload_id = b.workload_id)
SELECT *, baseline = 'command_failed' OR candidate = 'command_failed' AS tool_failure, CASE WHEN baseline <> 'passed' AND candidate <> 'passed' THEN 'shared' WHEN candidate <> 'passed' THEN 'candidate_only' WHEN baseline <> 'passed' THEN 'baseline_only' ELSE 'none' END AS bucket FROM j""",
)
def j03(spark, sf):
    """Full outer pairing of the last outcomes; absent counts as passed."""
    return m.outcome_buckets(last_checks(spark, sf), ["run_id", "workload_id"])


@query(
    "a09_phase_status",
    f"""WITH {p.CHECKS_SQL}, s AS (SELECT run_id, phase, CASE WHEN bool_or(outcome = 'command_failed') THEN 'inconclusive' WHEN bool_or(outcome = 'test_failed') THEN 'failed' ELSE 'passed' END AS status, bool_and(outcome = 'passed') AS all_passed, count(*) AS checks FROM last GROUP BY 1, 2)
SELECT *, CASE WHEN status = 'inconclusive' THEN 'inconclusive' WHEN status = 'failed' AND checks > 5 THEN 'runtime_regression' WHEN status = 'failed' THEN 'candidate_test_failure' ELSE 'clean' END AS classification,
CASE WHEN checks % 7 = 0 THEN 3 WHEN status = 'inconclusive' THEN 2 WHEN status = 'failed' THEN 1 ELSE 0 END AS exit_code FROM s""",
)
def a09(spark, sf):
    """Status of each phase, its class and exit code."""
    s = m.phase_status(last_checks(spark, sf), ["run_id", "phase"])
    s = s.withColumn("classification", m.outcome_class(F.col("status"), F.col("checks") > 5))
    return s.withColumn("exit_code", m.exit_code(F.when(F.col("checks") % 7 == 0, "cancelled").otherwise("succeeded"), F.col("status")))


@query("a07_verdict_counts", f"WITH {p.SAMPLES_SQL}, c AS ({_compare_sql('baseline', 'candidate')}), d AS (SELECT *, {_LADDER} AS reason FROM c) SELECT {_STATUS} AS status, reason, count(*) AS runs FROM d GROUP BY 1, 2")
def a07_counts(spark, sf):
    """Verdicts by kind: every branch of the ladder occurs."""
    return a07(spark, sf).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "a35_report_labels",
    f"""WITH {p.SAMPLES_SQL}, c AS ({_compare_sql('baseline', 'candidate')}), d AS (SELECT *, {_LADDER} AS reason FROM c)
SELECT run_id, CASE WHEN ({_STATUS}) = 'failed' AND query_delta > 0 THEN 'runtime_regression' WHEN ({_STATUS}) = 'inconclusive' THEN 'inconclusive' END AS label, printf('%.3f', query_delta) AS shown, CASE WHEN ({_STATUS}) = 'inconclusive' THEN CASE WHEN noisy THEN 'timing variance exceeded policy' ELSE 'no regression is implied without evidence' END END AS note FROM d""",
)
def a35(spark, sf):
    """Labels recovered for reports; without more queries a regression has none."""
    c = a07(spark, sf)
    return c.select("run_id", m.report_label(F.col("status"), F.col("query_delta")).alias("label"), F.format_string("%.3f", F.col("query_delta")).alias("shown"), m.report_note(F.col("status"), F.col("noisy"), F.lit(False)).alias("note"))
