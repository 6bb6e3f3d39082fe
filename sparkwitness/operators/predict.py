"""Impact prediction and its evaluation against what was observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .graph import degree_centrality


def node_score(confidence: Column, centrality: Column, changed: Column) -> Column:
    return clamp(F.lit(0.55) * confidence + F.lit(0.25) * F.coalesce(centrality, F.lit(0.0)) + F.lit(0.20) * F.when(changed, 1.0).otherwise(0.0))


def item_kind(node_type: Column) -> Column:
    return F.when(node_type.isin("ENDPOINT", "DATABASE_TABLE"), "service").when(node_type.isin("FUNCTION", "CLASS", "TEST"), "symbol").otherwise("runtime_path")


def prediction_confidence(completeness: Column, known: Column) -> Column:
    return clamp(completeness * (F.lit(0.5) + F.lit(0.5) * known / F.lit(6.0)))


def predicted_items(reached: DataFrame, centrality: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, key, score, reason, provenance) of reached nodes; the last of equal (kind, key) by (distance, id) wins."""
    path = F.col("edge_path") if "edge_path" in reached.columns else F.array().cast("array<string>")
    j = reached.join(centrality, "id", "left").join(nodes.select("id", "changed"), "id")
    j = j.select(
        item_kind(F.col("node_type")).alias("kind"), "key", node_score(F.col("confidence"), F.col("centrality"), F.col("changed")).alias("score"),
        F.format_string("reachable at distance %d", F.col("distance")).alias("reason"), F.concat(F.array(F.lit("graph-traversal")), path).alias("provenance"), F.struct("distance", "id").alias("ord"),
    )
    return j.groupBy("kind", "key").agg(*[F.max_by(c, "ord").alias(c) for c in ("score", "reason", "provenance")])


def workload_items(workloads: DataFrame) -> DataFrame:
    """Items of selected workloads (position, workload_id, confidence, reason); the last of an id wins."""
    score = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) != 0, 1.0).otherwise(0.5)
    j = workloads.select(F.lit("workload").alias("kind"), F.col("workload_id").alias("key"), score.alias("score"), "reason", F.array(F.lit("workload-registry")).alias("provenance"), "position")
    return j.groupBy("kind", "key").agg(*[F.max_by(c, "position").alias(c) for c in ("score", "reason", "provenance")])


def impact_prediction(nodes: DataFrame, edges: DataFrame, reached: DataFrame, paths: DataFrame, completeness: float, workloads: DataFrame, signals: dict[str, float | None] | None = None, missing: dict[str, str] | None = None) -> DataFrame:
    """One row: items in (kind, key) order, required workloads, risk signals, features, confidence, omitted context.

    ``reached`` is the traversal's output, ``paths`` (path) the changed files.
    ``signals`` gives history, coverage and ownership where they are known;
    ``missing`` says why one is not ("omitted" without a word).
    """
    known = {n: (signals or {}).get(n) for n in ("history", "coverage", "ownership")}
    centrality = degree_centrality(nodes, edges)
    items = predicted_items(reached, centrality, nodes).unionByName(workload_items(workloads))
    order = F.array_sort(F.collect_list(F.struct("kind", "key", "score", "reason", "provenance")))
    out = items.agg(order.alias("items"), F.array_sort(F.collect_set(F.when(F.col("kind") == "workload", F.col("key")))).alias("required_workload_ids"))
    sizes = nodes.agg(F.count(F.lit(1)).alias("all")).crossJoin(reached.agg(F.count(F.lit(1)).alias("hit")))
    sizes = sizes.crossJoin(centrality.agg(F.max("centrality").alias("top"))).crossJoin(paths.agg(F.coalesce(F.bool_or(F.col("path").rlike(r"[^/]\.py$")), F.lit(False)).alias("python")))
    number = lambda v: F.lit(v).cast("double")
    features = {
        "reachability": clamp(F.col("hit") / F.greatest(F.lit(1), F.col("all"))), "centrality": F.col("top"), "changed_file_type": F.when(F.col("python"), 1.0).otherwise(0.0),
        "history_churn": number(known["history"]), "coverage_signal": number(known["coverage"]), "ownership_signal": number(known["ownership"]),
    }
    count = sum((f.isNotNull().cast("int") for f in features.values()), F.lit(0))
    omitted = sorted({(missing or {}).get(n, f"{n}:omitted") for n, v in known.items() if v is None} | ({"graph:incomplete"} if completeness < 1 else set()))
    risk = F.struct(number(completeness).alias("graph_completeness"), number(float(completeness < 1 or known["coverage"] is None)).alias("validation_required"))
    return out.crossJoin(F.broadcast(sizes)).select(
        "items", "required_workload_ids", risk.alias("risk_signals"), F.struct(*[f.alias(n) for n, f in features.items()]).alias("features"),
        prediction_confidence(number(completeness), count).alias("confidence"), F.array(*map(F.lit, omitted)).cast("array<string>").alias("omitted_context"), F.lit("impact-v1").alias("predictor_revision"),
    )


def changed_file_baseline(added: DataFrame, modified: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Baseline predictor: every changed file with score 1."""
    union = added.select(key).union(modified.select(key)).union(deleted.select(key)).distinct()
    return union.select(F.lit("file").alias("kind"), F.col(key).alias("key"), F.lit(1.0).alias("score"))


def impact_labels(predicted: DataFrame, observed: DataFrame, group: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(group, kind, key, label, score): true positives, false positives and false negatives."""
    keys = [group, "kind", "key"]
    if kinds:
        predicted, observed = predicted.where(F.col("kind").isin(*kinds)), observed.where(F.col("kind").isin(*kinds))
    a = predicted.groupBy(*keys).agg(F.max("score").alias("score")).withColumn("p", F.lit(True))
    b = observed.select(*keys).distinct().withColumn("o", F.lit(True))
    label = F.when(F.col("p") & F.col("o"), "true_positive").when(F.col("p"), "false_positive").otherwise("false_negative")
    return a.join(b, keys, "full_outer").select(*keys, label.alias("label"), "score")


def evaluate(predicted: DataFrame, observed: DataFrame, group: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Precision, recall, false-negative rate and calibration of each group.

    Nothing predicted: precision 1 and mean score 0; nothing observed: recall 1.
    """
    labels = impact_labels(predicted, observed, group, kinds)
    n = lambda *names: F.count_if(F.col("label").isin(*names))
    total = predicted.groupBy(group).agg(F.count_distinct("kind", "key").alias("all_items"))
    out = labels.groupBy(group).agg(n("true_positive").alias("tp"), n("true_positive", "false_positive").alias("graded_items"), n("true_positive", "false_negative").alias("observed_items"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))
    out = out.join(total, group, "left").withColumn("ungraded_items", F.coalesce("all_items", F.lit(0)) - F.col("graded_items"))
    share = lambda d: F.when(F.col(d) > 0, F.col("tp") / F.col(d)).otherwise(1.0)
    out = out.withColumn("precision", share("graded_items")).withColumn("recall", share("observed_items"))
    return out.withColumns({"false_negative_rate": 1 - F.col("recall"), "calibration_error": F.abs(F.col("mean_score") - F.col("precision"))}).drop("all_items")


def first_reason(observed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Observed items without repeats; the first reason wins."""
    return observed.groupBy(*keys).agg(F.min_by("reason", order).alias("reason"))
