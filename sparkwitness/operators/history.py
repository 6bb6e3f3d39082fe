"""Run history: latest rows, state machines, idempotent writes, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import ordered, with_previous

# Allowed transitions of a run's status.
TRANSITIONS = (("queued", "running"), ("queued", "cancelled"), ("running", "succeeded"), ("running", "failed"), ("running", "cancelled"), ("running", "inconclusive"))


def latest(df: DataFrame, parent: str, *order: Column) -> DataFrame:
    """One row of each parent: the first in the order."""
    n = F.row_number().over(Window.partitionBy(parent).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def transition_faults(spark: SparkSession, states: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows whose status may not follow the one before; equal statuses are no transition.

    A run's history is sorted by ranges, so a long one spans many tasks.
    """
    moves = with_previous(ordered(states, key, *order), [key], "status").withColumnRenamed("_before_status", "before").drop("_seq", "_part", "_pos")
    allowed = spark.createDataFrame(TRANSITIONS, "before string, status string")
    return moves.where("before is not null and before <> status").join(F.broadcast(allowed), ["before", "status"], "left_anti")  # six rows


def create_or_get(requests: DataFrame, key: str, payload: Column, *order: str) -> DataFrame:
    """One row of each key: reused when all payloads agree, a conflict when not.

    The partial aggregate keeps a count, a smallest and a greatest digest, so a
    hot key is never gathered.
    """
    d = F.sha2(payload, 256)
    g = requests.groupBy(key).agg(F.count(F.lit(1)).alias("requests"), F.min(d).alias("_low"), F.max(d).alias("_high"), F.min(F.struct(*order)).alias("first"))
    outcome = F.when(F.col("requests") == 1, "created").when(F.col("_low") == F.col("_high"), "reused").otherwise("conflict")
    return g.withColumn("outcome", outcome).drop("_low", "_high")


def workload_names(runs: DataFrame, classes: DataFrame, phase: str, workload: str) -> DataFrame:
    """Classification by (phase, workload), else by the phase alone, else unclassified."""
    exact = classes.where(f"{workload} is not null").select(phase, workload, F.col("classification").alias("_exact"))
    loose = classes.where(f"{workload} is null").select(phase, F.col("classification").alias("_loose"))
    j = runs.join(exact, [phase, workload], "left").join(loose, phase, "left")
    return j.withColumn("classification", F.coalesce("_exact", "_loose", F.lit("unclassified"))).drop("_exact", "_loose")


def single_fix_commit(commits: DataFrame, run: str, commit: str) -> DataFrame:
    """The one distinct commit of a run, null where there are several."""
    return commits.groupBy(run).agg(F.when(F.min(commit) == F.max(commit), F.min(commit)).alias("fix_commit"))


def running_budget(attempts: DataFrame, run: str, order: str, limits: dict[str, float]) -> DataFrame:
    """Running sums of each spending and the first limit passed (in the order of ``limits``), strictly."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = attempts.withColumns({f"used_{c}": F.sum(c).over(w) for c in limits})
    reason = F.lit(None).cast("string")
    for c, limit in reversed(limits.items()):
        reason = F.when(F.col(f"used_{c}") > limit, f"{c}_budget_exceeded").otherwise(reason)
    return out.withColumn("cutoff", reason)


def duplicate_attempts(attempts: DataFrame, run: str, digest: str, order: str) -> DataFrame:
    """Flags an attempt whose digest the run has made before."""
    n = F.row_number().over(Window.partitionBy(run, digest).orderBy(order))
    return attempts.withColumn("duplicate", n > 1)


@dataclass(frozen=True)
class Stage:
    """A state of the remediation machine."""

    stage: str = "context"
    attempts: int = 0
    failed: bool = False
    pending: str | None = None
    reason: str | None = None

    def after(self, outcome: str, max_attempts: int) -> Stage:
        """The state that an outcome leads to."""
        if self.stage == "stopped":
            return self
        good = outcome == "ok"
        if self.stage != "decide":
            following = STAGES[STAGES.index(self.stage) + 1] if good else "decide"
            return Stage(following, self.attempts + (self.stage == "context"), self.failed or not good, outcome if outcome in FINAL else self.pending)
        if self.pending:
            reason = self.pending
        elif good and not self.failed:
            reason = "verified"
        elif outcome == "declined":
            reason = "decision_declined"
        else:
            reason = "max_attempts" if self.attempts >= max_attempts else None
        return Stage("stopped", self.attempts, False, self.pending, reason) if reason else Stage("context", self.attempts)


# Stages of an attempt in order, and outcomes that end a run at its decision.
STAGES = ("context", "diagnose", "patch", "validate", "verify", "decide")
FINAL = ("duplicate_patch", "time_budget_exceeded", "token_budget_exceeded", "cost_budget_exceeded")
#: All outcomes that differ in their effect; any other one counts as the last.
OUTCOMES = ("ok", "declined", *FINAL, "failed")
#: So many events or maps are composed in one row.
COMPOSED = 1024


def automaton(max_attempts: int) -> tuple[list[Stage], list[list[int]]]:
    """The states that can be reached, the first one at 0, and for each outcome the state that follows each."""
    states = [Stage()]
    at = {states[0]: 0}
    for state in states:  # grows while it is read
        for o in OUTCOMES:
            new = state.after(o, max_attempts)
            if new not in at:
                at[new] = len(states)
                states.append(new)
    return states, [[at[s.after(o, max_attempts)] for s in states] for o in OUTCOMES]


def replay(events: DataFrame, run: str, order: str, max_attempts: int = 3) -> DataFrame:
    """Remediation state machine over recorded outcomes of each run: (run, stage, attempts, reason).

    Stages follow context, diagnose, patch, validate, verify, decide.  An outcome
    other than ok goes to decide; a duplicate patch or a spent budget ends the
    run there.  Else decide ends it as verified when the attempt went well, as
    declined when the decision says so, and at the last attempt; otherwise the
    next attempt starts with its context.

    Each event is a map from state to state, and composing maps is associative:
    events are composed in blocks of consecutive ones, blocks in larger blocks,
    and what is left of a run (about one map for each range of rows that it
    spans) in one row.  A run of any length is so dealt over many tasks.
    """
    states, table = automaton(max_attempts)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome")), F.lit(0))
    effects = F.array(*map(F.lit, table))
    same = F.lit(list(range(len(states))))
    rows = ordered(events.select(F.col(run).alias("run"), F.col(order).alias("o"), F.when(code > 0, code - 1).otherwise(len(OUTCOMES) - 1).cast("int").alias("code")), "run", "o", "code")
    composed = lambda use: F.aggregate(F.sort_array(F.collect_list(F.struct("b", "m"))), same, lambda m, x: F.transform(m, lambda s: F.get(use(x["m"]), s))).alias("m")
    blocks = rows.select("run", F.expr(f"_seq div {COMPOSED}").alias("block"), F.col("_seq").alias("b"), F.col("code").alias("m")).groupBy("run", "block").agg(composed(lambda c: F.get(effects, c)))
    wide = blocks.select("run", F.expr(f"block div {COMPOSED}").alias("wide"), F.col("block").alias("b"), "m").groupBy("run", "wide").agg(composed(lambda m: m))
    whole = wide.select("run", F.col("wide").alias("b"), "m").groupBy("run").agg(composed(lambda m: m))
    end = F.get(F.array(*[F.struct(F.lit(s.stage).alias("stage"), F.lit(s.attempts).alias("attempts"), F.lit(s.reason).cast("string").alias("reason")) for s in states]), F.get("m", F.lit(0)))
    return whole.select(F.col("run").alias(run), end.alias("s")).select(run, "s.stage", "s.attempts", "s.reason")


def evidence_report(runs: DataFrame, verifications: DataFrame, findings: DataFrame, run: str) -> DataFrame:
    """One nested row for each run: children aggregated first, then left joins; no lookup per run."""
    v = verifications.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("phase", "workload", "status"))).alias("verifications"))
    f = findings.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("fingerprint", "confidence"))).alias("findings"), F.max("confidence").alias("top_confidence"))
    out = runs.join(v, run, "left").join(f, run, "left")
    empty = lambda c: F.coalesce(F.size(c), F.lit(0))
    return out.withColumn("verification_count", empty("verifications")).withColumn("finding_count", empty("findings"))


def markdown(report: DataFrame, run: str) -> DataFrame:
    """Markdown text of each report."""
    lines = F.concat(F.array(F.concat(F.lit("# Run "), F.col(run).cast("string"))), F.transform(F.coalesce("verifications", F.array().cast("array<struct<phase:string,workload:string,status:string>>")), lambda v: F.concat(F.lit("- "), v["phase"], F.lit(" "), v["workload"], F.lit(": "), v["status"])))
    return report.select(run, F.concat_ws("\n", lines).alias("markdown"))
