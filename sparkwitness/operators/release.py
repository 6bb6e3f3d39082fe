"""Releases: canary policy, hash-chained journal, status folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import lookup, ordered, settled, with_previous

SEPARATOR = "\x1f"


@dataclass(frozen=True)
class Policy:
    """Service-level policy of a canary window."""

    max_error_rate: float = 0.05
    max_latency_ms: float = 300.0
    minimum_samples: int = 5
    telemetry_max_age_seconds: int = 60


def canary(df: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``action`` and ``reason``: the first rule that applies, missing evidence never promotes.

    Inputs: validation_passed, telemetry_available, telemetry_age_seconds,
    sample_count, window_minimum, error_rate, latency_ms, verifications,
    traces (counts), observed_at, deadline_at.
    """
    c = F.col
    rules = (
        (~c("validation_passed"), "rollback", "staging validation failed"),
        (~c("telemetry_available"), "pause", "telemetry unavailable"),
        (c("telemetry_age_seconds").isNull() | (c("telemetry_age_seconds") > policy.telemetry_max_age_seconds), "pause", "telemetry is stale"),
        ((c("sample_count") < policy.minimum_samples) | (c("sample_count") < c("window_minimum")), "pause", "insufficient telemetry samples"),
        (c("error_rate").isNull() | c("latency_ms").isNull(), "pause", "telemetry metrics are incomplete"),
        (c("error_rate") > policy.max_error_rate, "rollback", "error-rate SLO breached"),
        (c("latency_ms") > policy.max_latency_ms, "rollback", "latency SLO breached"),
        (c("verifications") == 0, "pause", "validation is not linked to a verification run"),
        (c("traces") == 0, "pause", "telemetry is not linked to a recorded trace"),
        (c("observed_at") < c("deadline_at"), "pause", "canary window is still observing"),
    )
    action, reason = F.lit("promote"), F.lit("validation passed; canary window complete")
    for cond, what, why in reversed(rules):
        action, reason = F.when(cond, what).otherwise(action), F.when(cond, why).otherwise(reason)
    return df.withColumn("action", action).withColumn("reason", reason)


def lifecycle(observed: DataFrame, release: str, order: str) -> DataFrame:
    """Observations of a release up to its first terminal decision; later ones change nothing.

    The first decision is one partially aggregated minimum for each release.
    """
    ends = settled(observed.groupBy(release).agg(F.min(F.when(F.col("action").isin("promote", "rollback"), F.col(order))).alias("_end"), F.count(F.lit(1)).alias("_n")))
    total = ends.agg(F.sum("_n")).first()[0] or 0
    return lookup(observed, ends, [release], "_n", total).where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")


def summary(events: DataFrame, release: str, order: str) -> DataFrame:
    """Status by precedence (rolled back, promoted, paused, released), last non-null decision and count, in one aggregate."""
    has = lambda e: F.bool_or(F.col("event") == e)
    status = F.when(has("rolled_back"), "rolled_back").when(has("promoted"), "promoted").when(has("paused"), "paused").otherwise("released")
    decision = F.max_by("decision", F.when(F.col("decision").isNotNull(), F.col(order)))
    return events.groupBy(release).agg(status.alias("status"), decision.alias("decision"), F.count(F.lit(1)).alias("observations"))


def record_hash(previous: Column, body: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit(SEPARATOR), body).cast("binary"), 256)


def chain(records: DataFrame, release: str, order: str, body: str) -> DataFrame:
    """Journal rows (release, sequence, body, previous_hash, record_hash).

    Each hash needs the one before, so a release's records pass one task in
    order; the task carries one hash and streams the records, in linear time and
    in the memory of a batch.  A null body counts as empty.
    """
    kind = records.schema[release].dataType.simpleString()
    t = records.select(F.col(release).alias("release"), F.col(order).cast("long").alias("sequence"), F.col(body).alias("body"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, started = None, "", False
        for b in batches:
            before, after = [], []
            for r, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not started or r != now:
                    now, last, started = r, "", True
                before.append(last)
                last = hashlib.sha256(f"{last}{SEPARATOR}{text or ''}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=["release", "sequence", "body", "previous_hash", "record_hash"])

    out = t.repartition("release").sortWithinPartitions("release", "sequence", "body").mapInArrow(linked, f"release {kind}, sequence long, body string, previous_hash string, record_hash string")
    return out.withColumnRenamed("release", release)


def verify_chain(journal: DataFrame, release: str) -> DataFrame:
    """First fault of each journal: a broken link, a changed record or a gap; null where it holds.

    Every record is held against the one before it, in parallel: journals are
    sorted by ranges, so a long one spans many tasks.
    """
    j = with_previous(ordered(journal, release, "sequence"), [release], "record_hash")
    before = F.coalesce("_before_record_hash", F.lit(""))
    fault = F.when(F.col("previous_hash") != before, "chain is broken").when(F.col("record_hash") != record_hash(F.col("previous_hash"), F.coalesce("body", F.lit(""))), "record was modified").when(F.col("sequence") != F.col("_pos") - 1, "sequence has a gap")
    j = j.withColumn("fault", fault)
    return j.groupBy(release).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("sequence"))).alias("fault"), F.count(F.lit(1)).alias("records"))


def confirmed(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims that a passed fact backs on every key."""
    return claims.join(facts.where("status = 'passed'").select(*keys), keys, "left_semi")
