"""Gate ladders: the lowest ceiling of a failed gate is the permitted level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("report", "recommend", "generate_patch", "open_pr")
TOP_LEVEL = 3


def gate(code: str, passed: Column, ceiling: int | Column) -> Column:
    limit = F.lit(ceiling) if isinstance(ceiling, int) else ceiling
    return F.struct(F.lit(code).alias("code"), F.coalesce(passed, F.lit(False)).alias("passed"), limit.cast("int").alias("ceiling"))


def level_of(gates: Column) -> Column:
    """Lowest ceiling of the failed gates, the top level without any."""
    return F.coalesce(F.array_min(F.transform(F.filter(gates, lambda g: ~g["passed"]), lambda g: g["ceiling"])), F.lit(TOP_LEVEL))


def autonomy(df: DataFrame, policy: Column, with_inputs: bool = True) -> DataFrame:
    """Gates, level and action of each decision.

    Inputs: scores of ``scoring``, ``confirmed_regression``, ``patch_matches``,
    ``statuses`` (array), ``fix_identity``, ``patch_binding``,
    ``required`` and ``observed`` workload ids, ``identity_failures`` (count).
    ``with_inputs`` false leaves out the gates on remediation inputs.
    """
    c = F.col
    confidence = F.least("debt_confidence", "remediation_confidence") if with_inputs else F.lit(0.0)
    df = df.withColumn("confidence", confidence)
    risk = c("remediation_risk") if with_inputs else F.lit(None).cast("double")
    complete = (F.size("debt_missing") == 0) & (F.size("remediation_missing") == 0) & (c("context_completeness") == 1) if with_inputs else F.lit(False)
    gates = [
        gate("debt_priority", (c("debt_risk") >= 0.2) | c("confirmed_regression"), 0),
        gate("recommend_confidence", c("confidence") >= 0.5, 0),
        gate("remediation_assessed", F.lit(with_inputs), 1),
        gate("complete_context", complete, 1),
        gate("patch_confidence", c("confidence") >= 0.75, 1),
        gate("patch_risk", risk <= 0.4, 1),
    ]
    if with_inputs:
        gates += [gate(f"bounded_{n}", c(n) < 0.8, 1) for n in ("blast_radius", "criticality", "patch_size")]
        gates += [gate(f"no_{n}", c(n) == 0, 1) for n in ("schema_migration_risk", "data_migration_risk")]
        gates.append(gate("patch_reversible", c("reversibility") >= 0.5, 1))
        gates += [gate(f"pr_{n}", c(n) >= 0.8, 2) for n in ("coverage", "reversibility", "verification_strength")]
    present = F.size("statuses") > 0
    gates += [
        gate("pr_confidence", c("confidence") >= 0.9, 2),
        gate("pr_risk", risk <= 0.2, 2),
        gate("patch_identity", c("patch_matches"), 2),
        gate("verification_present", present, 2),
        gate("verification_passed", present & F.forall("statuses", lambda s: s == "passed"), 2),
        gate("fix_identity", present & c("fix_identity"), 2),
        gate("verified_patch_binding", present & c("patch_matches") & c("patch_binding"), 2),
        gate("required_workloads", (F.size("required") > 0) & (F.size(F.array_except("required", "observed")) == 0), 2),
        gate("candidate_regression_evidence", c("confirmed_regression"), 2),
        gate("evidence_identity", c("identity_failures") == 0, 0),
    ]
    df = df.withColumn("_gates", F.array(*gates)).withColumn("level_before_policy", level_of(c("_gates")))
    last = gate("policy_ceiling", c("level_before_policy") <= policy, policy)
    df = df.withColumn("gates", F.concat("_gates", F.array(last))).drop("_gates").withColumn("level", level_of(c("gates")))
    failed = F.transform(F.filter("gates", lambda g: ~g["passed"]), lambda g: g["code"])
    return df.withColumn("action", F.element_at(F.array(*map(F.lit, ACTIONS)), c("level") + 1)).withColumn("failed_gates", failed)


def composed(level: Column, classification: Column) -> Column:
    """Anything but a regression may only be reported."""
    return F.when(classification == "runtime_regression", level).otherwise(0)


def fix_identity_reason(run_ok: Column, base_ok: Column, hash_ok: Column, workload_ok: Column, attempt_ok: Column) -> Column:
    """First of the five ordered identity faults of a fix request; null when all agree."""
    names = ("analysis_run_id", "base_commit", "patch_hash", "workload_id", "verification_attempt_id")
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(zip(names, (run_ok, base_ok, hash_ok, workload_ok, attempt_ok), strict=True))):
        out = F.when(~ok, f"{name}_mismatch").otherwise(out)
    return out


def publication(verified: Column, decided: Column, patched: Column, action: Column, level: Column) -> Column:
    """struct(dry_run, publish): eligibility for publication."""
    dry = verified & decided & patched
    return F.struct(dry.alias("dry_run"), (dry & (action == "open_pr") & (level >= TOP_LEVEL)).alias("publish"))
