"""Telemetry recording with hash sampling and a span cap, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import sampled

MAX_SPANS = 256


def record(spans: DataFrame, run: str, order: list[str], rate: float = 1.0, max_spans: int = MAX_SPANS) -> DataFrame:
    """Adds ``recorded``: sampled_out, limited (past the run's cap) or the span's own status.

    Sampling is by the run; only sampled spans count towards the cap.
    """
    s = spans.withColumn("sampled", sampled(F.col(run).cast("string"), rate))
    n = F.row_number().over(Window.partitionBy(run, "sampled").orderBy(*order))
    status = F.when(~F.col("sampled"), "sampled_out").when(n > max_spans, "limited").when(F.col("status").isin("error", "unavailable"), F.col("status")).otherwise("ok")
    exporter = F.when(~F.col("sampled"), "sampled_out").when(n > max_spans, "failed").when(F.col("status") == "unavailable", "unavailable").otherwise("healthy")
    return s.withColumn("recorded", status).withColumn("exporter_status", exporter)


def summary(observations: DataFrame, run: str, symbol: str, resolved: str) -> DataFrame:
    """Sorted distinct statuses, resolved and unresolved symbols, and the count of each run."""
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col(symbol))))
    return observations.groupBy(run).agg(F.concat_ws(",", F.array_sort(F.collect_set("status"))).alias("statuses"), F.size(names(F.col(resolved))).alias("resolved"), F.size(names(~F.col(resolved))).alias("unresolved"), F.count(F.lit(1)).alias("observations"))


def single_group_counts(evidence: DataFrame, trace: str, *keys: str) -> DataFrame:
    """Evidence counts by (trace, keys); a trace with more than one group has no valid count."""
    g = evidence.groupBy(trace, *keys).agg(F.count(F.lit(1)).alias("spans"))
    groups = F.count(F.lit(1)).over(Window.partitionBy(trace))
    return g.withColumn("groups", groups).withColumn("valid_spans", F.when(F.col("groups") == 1, F.col("spans")))


def retained(observations: DataFrame, at: str, cutoff, payload: str, max_bytes: int) -> DataFrame:
    """Rows that are young enough and whose artifact is small enough to be kept."""
    return observations.where((F.col(at) >= cutoff) & (F.octet_length(payload) <= max_bytes))
