"""Repeated measurements: aggregation, differential comparison and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("p50_ms", "p95_ms", "query_count", "throughput", "error_rate")
#: Ratio of a positive value to a zero baseline.
INFINITE_RATIO = 1e308


@dataclass(frozen=True)
class Thresholds:
    """Semantic parameters of the differential comparison."""

    query_delta: float = 10.0
    query_ratio: float = 5.0
    latency_ratio: float = 2.0
    variation: float = 0.2
    repetitions: int = 5


def ratio(candidate: Column, baseline: Column) -> Column:
    """candidate / baseline; 0/0 is 1, x/0 the sentinel."""
    return F.when(baseline != 0, candidate / baseline).when(candidate == 0, F.lit(1.0)).otherwise(F.lit(INFINITE_RATIO))


def summarize(samples: DataFrame, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Median of each metric, population variation of p95 (0 for mean 0) and repetitions, for each key."""
    mean = F.avg("p95_ms")
    return samples.groupBy(*keys).agg(
        *[F.percentile(m, F.lit(0.5)).alias(m) for m in metrics],
        F.when(mean == 0, F.lit(0.0)).otherwise(F.stddev_pop("p95_ms") / mean).alias("cv"),
        F.count(F.lit(1)).alias("repetitions"),
    )


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def compare(left: DataFrame, right: DataFrame, key: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Differential verdict of the right side's summaries against the left's.

    Ladder: tool failure or wrong sample count is inconclusive; a query
    regression fails; noise is inconclusive; a latency regression fails.
    Columns ``tool_failed`` and ``newly_failed`` are optional inputs of the right side.
    """
    names = (*METRICS, "cv", "repetitions")
    a = left.select(key, *[F.col(c).alias(f"left_{c}") for c in names])
    b = right.select(*right.columns).withColumnsRenamed({c: f"right_{c}" for c in names})
    for c in ("tool_failed", "newly_failed"):
        if c not in b.columns:
            b = b.withColumn(c, F.lit(False))
    j = a.join(b, key)
    delta = F.col("right_query_count") - F.col("left_query_count")
    q_ratio = ratio(F.col("right_query_count"), F.col("left_query_count"))
    l_ratio = ratio(F.col("right_p95_ms"), F.col("left_p95_ms"))
    j = j.withColumns(
        {
            "query_delta": delta, "query_ratio": q_ratio, "latency_ratio": l_ratio,
            "query_regression": (delta >= t.query_delta) & (q_ratio >= t.query_ratio),
            "latency_regression": l_ratio >= t.latency_ratio,
            "noisy": (F.col("left_cv") > t.variation) | (F.col("right_cv") > t.variation),
            "wrong_samples": (F.col("left_repetitions") != t.repetitions) | (F.col("right_repetitions") != t.repetitions),
        }
    )
    reason = (
        F.when(F.col("tool_failed"), "tool_failure").when(F.col("wrong_samples"), "sample_count").when(F.col("newly_failed"), "candidate_failure")
        .when(F.col("query_regression"), "query_regression").when(F.col("noisy"), "noisy").when(F.col("latency_regression"), "latency_regression").otherwise("none")
    )
    status = F.when(F.col("reason").isin("tool_failure", "sample_count", "noisy"), "inconclusive").when(F.col("reason") == "none", "passed").otherwise("failed")
    j = j.withColumn("reason", reason).withColumn("status", status)
    finding = (F.col("status") == "failed") & (F.col("query_regression") | F.col("latency_regression"))
    return j.withColumn("finding", finding)


def three_way(baseline_fix: DataFrame, fix_candidate: DataFrame, key: str) -> DataFrame:
    """Verdict of a fix from baseline→fix and fix→candidate comparisons."""
    a = baseline_fix.select(key, F.col("status").alias("base_fix"))
    b = fix_candidate.select(key, F.col("status").alias("fix_candidate"))
    j = a.join(b, key)
    unsure = (F.col("base_fix") == "inconclusive") | (F.col("fix_candidate") == "inconclusive")
    verdict = F.when(unsure, "inconclusive").when(F.col("base_fix") == "failed", "failed").when(F.col("fix_candidate") == "failed", "passed").otherwise("failed")
    kind = F.when(unsure, "inconclusive").when(F.col("base_fix") == "failed", "regression").when(F.col("fix_candidate") == "failed", "improvement").otherwise("no_material_change")
    return j.withColumn("status", verdict).withColumn("classification", kind)


def outcome_buckets(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Baseline and candidate outcome of each workload (absent is passed) and its bucket; a failed command counts as a failure and is flagged."""
    side = lambda phase: checks.where(F.col("phase") == phase).select(*keys, F.col("outcome").alias(phase))
    j = side("baseline").join(side("candidate"), keys, "full_outer")
    j = j.withColumns({p: F.coalesce(p, F.lit("passed")) for p in ("baseline", "candidate")})
    bad = lambda p: F.col(p) != "passed"
    tool = (F.col("baseline") == "command_failed") | (F.col("candidate") == "command_failed")
    bucket = F.when(bad("baseline") & bad("candidate"), "shared").when(bad("candidate"), "candidate_only").when(bad("baseline"), "baseline_only").otherwise("none")
    return j.withColumn("bucket", bucket).withColumn("tool_failure", tool)


def phase_status(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Command failure makes a phase inconclusive, a test failure failed, else it passed; counts go along."""
    broken, failed = F.bool_or(F.col("outcome") == "command_failed"), F.bool_or(F.col("outcome") == "test_failed")
    return checks.groupBy(*keys).agg(
        F.when(broken, "inconclusive").when(failed, "failed").otherwise("passed").alias("status"),
        F.bool_and(F.col("outcome") == "passed").alias("all_passed"), F.count(F.lit(1)).alias("checks"),
    )


def outcome_class(status: Column, regression: Column) -> Column:
    """Class of a compared candidate."""
    return F.when(status == "inconclusive", "inconclusive").when((status == "failed") & regression, "runtime_regression").when(status == "failed", "candidate_test_failure").otherwise("clean")


def exit_code(run: Column, candidate: Column, ci: bool = True) -> Column:
    """Exit code of an analysis: 3 without a verdict; outside CI 0; else 2 inconclusive, 1 failed candidate, 0."""
    none = run.isin("failed", "running", "cancelled")
    if not ci:
        return F.when(none, 3).otherwise(0)
    return F.when(none, 3).when((run == "inconclusive") | (candidate == "inconclusive"), 2).when(candidate == "failed", 1).otherwise(0)


def report_label(status: Column, query_delta: Column) -> Column:
    """Label of a comparison in a report: only more queries make a failure a runtime regression."""
    return F.when((status == "failed") & (query_delta > 0), "runtime_regression").when(status == "inconclusive", "inconclusive")


def report_note(status: Column, noisy: Column, tool_failed: Column) -> Column:
    """Why a measurement was inconclusive; null for the others."""
    why = F.when(noisy, "timing variance exceeded policy").when(tool_failed, "a verification tool failed").otherwise("no regression is implied without evidence")
    return F.when(status == "inconclusive", why)
