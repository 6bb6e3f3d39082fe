"""Null-aware weighted scores in exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "decimal(18,16)"
# Feature weights of the debt and remediation scores.
PRINCIPAL = (("complexity", "0.35"), ("coverage_deficit", "0.35"), ("estimated_patch_size", "0.30"))
INTEREST = (("churn", "0.30"), ("graph_centrality", "0.25"), ("runtime_impact", "0.25"), ("path_criticality", "0.20"))
REMEDIATION = (("blast_radius", "0.20"), ("criticality", "0.15"), ("coverage", "0.15"), ("reversibility", "0.15"), ("verification_strength", "0.15"), ("patch_size", "0.10"), ("schema_migration_risk", "0.05"), ("data_migration_risk", "0.05"))
PROTECTIVE = ("coverage", "reversibility", "verification_strength")


def unit(x: Column) -> Column:
    """A [0, 1] value as exact decimal text, not as its binary expansion."""
    return x.cast("string").cast(UNIT)


def _total(terms: list[Column]) -> Column:
    out = F.lit(0).cast("decimal(38,20)")
    for t in terms:
        out = (out + t).cast("decimal(38,20)")
    return F.least(out, F.lit(1).cast("decimal(38,20)"))


def _known(names: list[str], of: int) -> Column:
    return sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) / F.lit(float(of))


def missing(names: list[str]) -> Column:
    """Names of the null features, in order."""
    return F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())


def debt_score(df: DataFrame) -> DataFrame:
    """Debt score; an unknown feature adds nothing and lowers the confidence."""
    value = lambda n: F.coalesce(unit(F.col(n)), F.lit(0).cast(UNIT))
    weight = lambda w: F.lit(w).cast("decimal(4,2)")
    names = [n for n, _ in (*PRINCIPAL, *INTEREST)]
    out = df.withColumn("_p", _total([value(n) * weight(w) for n, w in PRINCIPAL])).withColumn("_g", _total([value(n) * weight(w) for n, w in INTEREST]))
    out = out.withColumn("_i", _total([(F.col("_p").cast(UNIT) * value(n)).cast("decimal(30,20)") * weight(w) for n, w in INTEREST]))
    half = F.lit("0.5").cast("decimal(2,1)")
    out = out.withColumn("_d", _total([(F.col("_p") * half), (F.col("_i") * half)])).withColumn("debt_completeness", _known(names, 7))
    contributions = F.array(*[F.struct(F.lit(n).alias("feature"), unit(F.col(n)).alias("observed"), F.lit(w).alias("weight"), (value(n) * weight(w)).alias("contribution"), F.col(n).isNull().alias("missing")) for n, w in (*PRINCIPAL, *INTEREST)])
    return out.withColumns(
        {
            "principal": F.col("_p").cast("double"), "interest_rate": F.col("_g").cast("double"), "interest": F.col("_i").cast("double"), "debt_risk": F.col("_d").cast("double"),
            "debt_confidence": F.col("debt_completeness") * F.coalesce(F.col("evidence_confidence").cast("double"), F.lit(0.0)),
            "debt_missing": missing([*names, "evidence_confidence"]), "debt_contributions": contributions,
        }
    ).drop("_p", "_g", "_i", "_d")


def remediation_score(df: DataFrame) -> DataFrame:
    """Remediation risk; an unknown feature counts as the worst case."""
    one = F.lit(1).cast(UNIT)
    possible = F.greatest(*[F.coalesce((unit(F.col(n)) > 0).cast("int"), F.lit(1)) for n in ("schema_migration_risk", "data_migration_risk")]) == 1

    def risk(n: str) -> Column:
        seen = unit(F.col(n))
        x = F.when(seen.isNull(), one).otherwise((one - seen).cast(UNIT) if n in PROTECTIVE else seen)
        return F.when(possible & (x < F.lit("0.5").cast(UNIT)), F.lit("0.5").cast(UNIT)).otherwise(x) if n == "reversibility" else x

    names = [n for n, _ in REMEDIATION]
    total = _total([risk(n) * F.lit(w).cast("decimal(4,2)") for n, w in REMEDIATION])
    known = _known(names, 8)
    zero = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            "remediation_risk": total.cast("double"), "remediation_completeness": known,
            "remediation_confidence": known * zero("context_completeness") * zero("evidence_confidence"),
            "remediation_missing": missing([*names, "context_completeness", "evidence_confidence"]), "migration_possible": possible,
        }
    )
