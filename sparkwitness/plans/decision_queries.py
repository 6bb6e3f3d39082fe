"""Queries over scores, gates, predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as g
from ..operators import predict as pd
from ..operators import scoring as sc
from ..session import table
from .registry import query

_DEBT = ("complexity", "coverage_deficit", "estimated_patch_size", "churn", "graph_centrality", "runtime_impact", "path_criticality")
_SAFE = ("blast_radius", "criticality", "coverage", "reversibility", "verification_strength", "patch_size", "schema_migration_risk", "data_migration_risk", "context_completeness")


def features(spark, sf):
    """Scoring features: digits of the part key in [0, 1]; some are null, by modulus."""
    t, k = table(spark, sf, "part"), F.col("p_partkey")
    columns = [((k * (i + 3)) % 101 / 100).alias(n) for i, n in enumerate(_DEBT)] + [((k * (i + 11)) % 51 / 50).alias(n) for i, n in enumerate(_SAFE)]
    out = t.select("p_partkey", *columns, (F.lit(0.5) + (k % 51) / 100).alias("evidence_confidence"))
    null = {"complexity": 7, "churn": 11, "coverage": 13, "schema_migration_risk": 5, "reversibility": 17, "evidence_confidence": 19}
    out = out.withColumns({n: F.when(k % m != 0, F.col(n)) for n, m in null.items()})
    zero = lambda n, m: F.when(k % m == 1, F.lit(0.0)).otherwise(F.col(n))
    one = lambda n: F.when(k % 3 == 1, F.lit(1.0)).otherwise(F.col(n))
    return out.withColumns({"schema_migration_risk": zero("schema_migration_risk", 3), "data_migration_risk": zero("data_migration_risk", 3), "context_completeness": one("context_completeness"), "coverage": one("coverage"), "verification_strength": one("verification_strength"), "reversibility": one("reversibility"), "evidence_confidence": one("evidence_confidence")})


def _features_sql():
    null = {"complexity": 7, "churn": 11, "coverage": 13, "schema_migration_risk": 5, "reversibility": 17, "evidence_confidence": 19}
    base = {n: f"(p_partkey * {i + 3} % 101)" for i, n in enumerate(_DEBT)} | {n: f"(p_partkey * {i + 11} % 51 * 2)" for i, n in enumerate(_SAFE)} | {"evidence_confidence": "(50 + p_partkey % 51)"}
    out = []
    for n, e in base.items():
        e = f"CASE WHEN p_partkey % {null[n]} <> 0 THEN {e} END" if n in null else e
        if n in ("schema_migration_risk", "data_migration_risk"):
            e = f"CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE {e} END"
        if n in ("context_completeness", "coverage", "verification_strength", "reversibility", "evidence_confidence"):
            e = f"CASE WHEN p_partkey % 3 = 1 THEN 100 ELSE {e} END"
        out.append(f"({e})::BIGINT AS {n}")
    return f"f AS (SELECT p_partkey, {', '.join(out)} FROM part)"  # all in hundredths, so that sums are exact


_P = "(35 * coalesce(complexity, 0) + 35 * coverage_deficit + 30 * estimated_patch_size)"
_G = "(30 * coalesce(churn, 0) + 25 * graph_centrality + 25 * runtime_impact + 20 * path_criticality)"
_DEBT_SQL = f"""d AS (SELECT *, {_P} / 10000.0::DOUBLE AS principal, {_G} / 10000.0::DOUBLE AS interest_rate, ({_P}::HUGEINT * {_G})::DOUBLE / 1e8 AS interest,
(({_P}::HUGEINT * 10000 + {_P}::HUGEINT * {_G})::DOUBLE / 2e8) AS debt_risk, (7 - (complexity IS NULL)::INT - (churn IS NULL)::INT) / 7.0::DOUBLE AS debt_completeness FROM f),
d2 AS (SELECT *, debt_completeness * coalesce(evidence_confidence / 100.0::DOUBLE, 0) AS debt_confidence, list_filter([CASE WHEN complexity IS NULL THEN 'complexity' END, CASE WHEN churn IS NULL THEN 'churn' END, CASE WHEN evidence_confidence IS NULL THEN 'evidence_confidence' END], lambda x: x IS NOT NULL) AS debt_missing FROM d)"""


@query("a11_debt_score", f"WITH {_features_sql()}, {_DEBT_SQL} SELECT p_partkey, round(principal,9) AS principal, round(interest_rate,9) AS interest_rate, round(interest,9) AS interest, round(debt_risk,9) AS debt_risk, round(debt_confidence,9) AS debt_confidence, debt_missing FROM d2")
def a11(spark, sf):
    """Debt score with exact decimals and null rules."""
    s = sc.debt_score(features(spark, sf))
    return s.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("principal", "interest_rate", "interest", "debt_risk", "debt_confidence")], "debt_missing")


_R = "(20 * blast_radius + 15 * criticality + 15 * (100 - coalesce(coverage, 0)) + 15 * greatest(100 - coalesce(reversibility, 0), CASE WHEN coalesce(schema_migration_risk, 1) > 0 OR data_migration_risk > 0 THEN 50 ELSE 0 END) + 15 * (100 - verification_strength) + 10 * patch_size + 5 * coalesce(schema_migration_risk, 100) + 5 * data_migration_risk)"
_REM_SQL = f"""r AS (SELECT *, {_R} / 10000.0::DOUBLE AS remediation_risk, (8 - (coverage IS NULL)::INT - (reversibility IS NULL)::INT - (schema_migration_risk IS NULL)::INT) / 8.0::DOUBLE AS known FROM d2),
r2 AS (SELECT *, known * (context_completeness / 100.0::DOUBLE) * coalesce(evidence_confidence / 100.0::DOUBLE, 0) AS remediation_confidence FROM r)"""


@query("a12_remediation_score", f"WITH {_features_sql()}, {_DEBT_SQL}, {_REM_SQL} SELECT p_partkey, round(remediation_risk,9) AS remediation_risk, round(known,9) AS remediation_completeness, round(remediation_confidence,9) AS remediation_confidence, coalesce(schema_migration_risk, 1) > 0 OR data_migration_risk > 0 AS migration_possible FROM r2")
def a12(spark, sf):
    """Remediation risk, worst case for unknown features, migration floor."""
    s = sc.remediation_score(features(spark, sf))
    return s.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("remediation_risk", "remediation_completeness", "remediation_confidence")], "migration_possible")


def decisions(spark, sf, with_inputs=True):
    k = F.col("p_partkey")
    df = sc.remediation_score(sc.debt_score(features(spark, sf))).withColumns(
        {
            "confirmed_regression": k % 2 == 1, "patch_matches": k % 10 != 0, "statuses": F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 8 == 0, F.array(F.lit("passed"), F.lit("failed"))).otherwise(F.array(F.lit("passed"))),
            "fix_identity": k % 12 != 0, "patch_binding": k % 14 != 0, "required": F.array(F.lit("w1")), "observed": F.when(k % 15 == 0, F.array(F.lit("w2"))).otherwise(F.array(F.lit("w1"), F.lit("w2"))), "identity_failures": F.when(k % 40 == 0, 1).otherwise(0),
        }
    )
    return g.autonomy(df, F.when(k % 6 == 0, 1).otherwise(3), with_inputs)


_GATES_SQL = [
    ("debt_risk >= 0.2 OR p_partkey % 2 = 1", 0), ("confidence >= 0.5", 0), ("len(debt_missing) = 0 AND coverage IS NOT NULL AND reversibility IS NOT NULL AND schema_migration_risk IS NOT NULL AND context_completeness = 100", 1),
    ("confidence >= 0.75", 1), ("remediation_risk <= 0.4", 1), ("blast_radius < 80", 1), ("criticality < 80", 1), ("patch_size < 80", 1), ("coalesce(schema_migration_risk = 0, false)", 1), ("data_migration_risk = 0", 1),
    ("coalesce(reversibility >= 50, false)", 1), ("coalesce(coverage >= 80, false)", 2), ("coalesce(reversibility >= 80, false)", 2), ("verification_strength >= 80", 2), ("confidence >= 0.9", 2), ("remediation_risk <= 0.2", 2),
    ("p_partkey % 10 <> 0", 2), ("p_partkey % 9 <> 0", 2), ("p_partkey % 9 <> 0 AND p_partkey % 8 <> 0", 2), ("p_partkey % 9 <> 0 AND p_partkey % 12 <> 0", 2), ("p_partkey % 9 <> 0 AND p_partkey % 10 <> 0 AND p_partkey % 14 <> 0", 2),
    ("p_partkey % 15 <> 0", 2), ("p_partkey % 2 = 1", 2), ("p_partkey % 40 <> 0", 0),
]
_LEVEL_SQL = "least(3, " + ", ".join(f"CASE WHEN {cond} THEN 3 ELSE {ceiling} END" for cond, ceiling in _GATES_SQL) + ")"
_FAILED_SQL = " + ".join(f"CASE WHEN {cond} THEN 0 ELSE 1 END" for cond, _ in _GATES_SQL)


@query(
    "a14_autonomy_gates",
    f"""WITH {_features_sql()}, {_DEBT_SQL}, {_REM_SQL}, c AS (SELECT *, least(round(debt_confidence, 12), round(remediation_confidence, 12)) AS confidence FROM r2),
l AS (SELECT *, {_LEVEL_SQL} AS before, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 3 END AS policy, {_FAILED_SQL} AS failed FROM c),
m AS (SELECT *, CASE WHEN before <= policy THEN before ELSE least(before, policy) END AS level FROM l)
SELECT p_partkey, before AS level_before_policy, level, ['report', 'recommend', 'generate_patch', 'open_pr'][level + 1] AS action, failed + CASE WHEN before <= policy THEN 0 ELSE 1 END AS failed_count, 26 AS gate_count FROM m""",
)
def a14(spark, sf):
    """26 gates with remediation inputs, lowest failed ceiling, policy last."""
    return decisions(spark, sf).select("p_partkey", "level_before_policy", "level", "action", F.size("failed_gates").alias("failed_count"), F.size("gates").alias("gate_count"))


@query(
    "a14_gates_without_inputs",
    f"WITH {_features_sql()}, {_DEBT_SQL} SELECT p_partkey, 0 AS level, 17 AS gate_count, debt_risk >= 0.2 OR p_partkey % 2 = 1 AS has_priority FROM d2",
)
def a14_without(spark, sf):
    """17 gates without remediation inputs; the confidence is then 0 and nothing is permitted."""
    return decisions(spark, sf, with_inputs=False).select("p_partkey", "level", F.size("gates").alias("gate_count"), (~F.array_contains("failed_gates", "debt_priority")).alias("has_priority"))


@query(
    "a15_composition_and_publication",
    f"""WITH {_features_sql()}, {_DEBT_SQL}, {_REM_SQL}, c AS (SELECT *, least(round(debt_confidence, 12), round(remediation_confidence, 12)) AS confidence FROM r2),
l AS (SELECT *, least({_LEVEL_SQL}, CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 3 END) AS level FROM c)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN level ELSE 0 END AS composed_level, p_partkey % 8 <> 0 AND p_partkey % 10 <> 0 AS dry_run, p_partkey % 8 <> 0 AND p_partkey % 10 <> 0 AND level = 3 AS publish,
CASE WHEN p_partkey % 21 = 0 THEN 'analysis_run_id_mismatch' WHEN p_partkey % 12 = 0 THEN 'patch_hash_mismatch' WHEN p_partkey % 14 = 0 THEN 'workload_id_mismatch' END AS fix_fault FROM l""",
)
def a15(spark, sf):
    """Composition cap, fix identity faults, publication eligibility."""
    k = F.col("p_partkey")
    e = g.publication(k % 8 != 0, F.lit(True), F.col("patch_matches"), F.col("action"), F.col("level"))
    fault = g.fix_identity_reason(k % 21 != 0, F.lit(True), F.col("fix_identity"), F.col("patch_binding"), F.lit(True))
    kind = F.when(k % 4 == 1, "runtime_regression").otherwise("clean")
    return decisions(spark, sf).withColumn("e", e).select("p_partkey", g.composed(F.col("level"), kind).alias("composed_level"), "e.dry_run", "e.publish", fault.alias("fix_fault"))


@query(
    "a13_measured_features",
    """WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS reached, count(DISTINCT l_orderkey) AS changed, sum(l_quantity) AS touched, bool_or(l_returnflag = 'R') AS served,
count(DISTINCT CASE WHEN l_linestatus = 'O' AND l_partkey % 50 < 10 THEN l_partkey % 50 END) AS passed FROM lineitem GROUP BY 1)
SELECT l_suppkey, least(reached / 10.0::DOUBLE, 1.0) AS graph_centrality, CASE WHEN served THEN 1.0 ELSE 0.4 END AS path_criticality, least(greatest(changed, 1) / 5.0::DOUBLE, 1.0) AS estimated_patch_size, least(touched / 200.0::DOUBLE, 1.0) AS patch_size, round(passed / 10.0::DOUBLE, 6) AS verification_strength FROM s""",
)
def a13(spark, sf):
    """Features measured from graph, patch and verification; ten workloads are required."""
    from ..functions.scalars import saturate

    s = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("reached"), F.count_distinct("l_orderkey").alias("changed"), F.sum("l_quantity").alias("touched"), F.bool_or(F.col("l_returnflag") == "R").alias("served"), F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 50)).alias("passed"))
    required = F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))
    return s.select("l_suppkey", saturate(F.col("reached"), 10).alias("graph_centrality"), F.when(F.col("served"), 1.0).otherwise(0.4).cast("double").alias("path_criticality"), saturate(F.greatest("changed", F.lit(1)), 5).alias("estimated_patch_size"), saturate(F.col("touched"), 200).alias("patch_size"), F.round(F.size(F.array_intersect("passed", required)) / F.lit(10.0), 6).alias("verification_strength"))


def predicted(spark, sf):
    """Predicted items: long documents, by language; a few of a kind that nothing observes."""
    t = table(spark, sf, "documents").where("n_chars > 1500")
    kind = F.when(F.col("doc_id") % 9 == 0, "ungraded").otherwise(F.col("lang"))
    return t.select(F.col("source").alias("repo"), kind.alias("kind"), F.col("doc_id").alias("key"), F.least(F.col("n_chars") / 8000.0, F.lit(1.0)).alias("score"))


def observed(spark, sf):
    """Observed items: documents with quality 1."""
    t = table(spark, sf, "labels").where("quality = 1").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return t.select(F.col("source").alias("repo"), F.col("lang").alias("kind"), F.col("doc_id").alias("key"))


_EVAL_SQL = """p AS (SELECT source AS repo, CASE WHEN doc_id % 9 = 0 THEN 'ungraded' ELSE lang END AS kind, doc_id AS key, least(n_chars / 8000.0::DOUBLE, 1.0) AS score FROM documents WHERE n_chars > 1500),
o AS (SELECT source AS repo, lang AS kind, doc_id AS key FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
lab AS (SELECT coalesce(p.repo, o.repo) AS repo, coalesce(p.kind, o.kind) AS kind, coalesce(p.key, o.key) AS key, CASE WHEN p.key IS NOT NULL AND o.key IS NOT NULL THEN 'true_positive' WHEN p.key IS NOT NULL THEN 'false_positive' ELSE 'false_negative' END AS label, p.score
FROM (SELECT * FROM p WHERE kind <> 'ungraded') p FULL JOIN o ON p.repo = o.repo AND p.kind = o.kind AND p.key = o.key)"""


@query("j05_impact_labels", f"WITH {_EVAL_SQL} SELECT repo, kind, key, label FROM lab")
def j05(spark, sf):
    """Labels by full outer join of predicted and observed."""
    return pd.impact_labels(predicted(spark, sf), observed(spark, sf), "repo", ("en", "de", "fr", "es")).select("repo", "kind", "key", "label")


@query(
    "a18_impact_evaluation",
    f"""WITH {_EVAL_SQL}, e AS (SELECT repo, count(*) FILTER (label = 'true_positive') AS tp, count(*) FILTER (label IN ('true_positive', 'false_positive')) AS graded_items, count(*) FILTER (label IN ('true_positive', 'false_negative')) AS observed_items, coalesce(avg(score), 0) AS mean_score FROM lab GROUP BY 1),
q AS (SELECT e.*, coalesce(n, 0) - graded_items AS ungraded_items, CASE WHEN graded_items > 0 THEN tp / graded_items::DOUBLE ELSE 1.0 END AS precision, CASE WHEN observed_items > 0 THEN tp / observed_items::DOUBLE ELSE 1.0 END AS recall FROM e LEFT JOIN (SELECT repo, count(*) AS n FROM p GROUP BY 1) n ON n.repo = e.repo)
SELECT repo, tp, graded_items, observed_items, ungraded_items, round(mean_score, 6) AS mean_score, round(precision, 6) AS precision, round(recall, 6) AS recall, round(1 - recall, 6) AS false_negative_rate, round(abs(mean_score - precision), 6) AS calibration_error FROM q""",
)
def a18(spark, sf):
    """Precision, recall, calibration of each group."""
    e = pd.evaluate(predicted(spark, sf), observed(spark, sf), "repo", ("en", "de", "fr", "es"))
    return e.select("repo", "tp", "graded_items", "observed_items", "ungraded_items", *[F.round(c, 6).alias(c) for c in ("mean_score", "precision", "recall", "false_negative_rate", "calibration_error")])


@query("a17_changed_file_baseline", "SELECT 'file' AS kind, k AS key, 1.0::DOUBLE AS score FROM (SELECT source || '/' || lang AS k FROM documents WHERE lang = 'de' UNION SELECT source || '/' || lang FROM documents WHERE n_chars > 5000 UNION SELECT source || '/' || lang FROM documents WHERE source = 'src3')")
def a17(spark, sf):
    """Changed files as predicted items of score 1."""
    t = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", "lang"))
    return pd.changed_file_baseline(t.where("lang = 'de'"), t.where("n_chars > 5000"), t.where("source = 'src3'"), "path")


@query("a19_observed_impact", "SELECT o_custkey AS key, arg_min(o_orderpriority, o_orderkey) AS reason FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def a19(spark, sf):
    """Failed workloads as observed items, first reason wins."""
    t = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("reason"), "o_orderkey")
    return pd.first_reason(t, ["key"], "o_orderkey")
