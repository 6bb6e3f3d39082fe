"""Runtime names to graph nodes: exact, then normalized, ambiguity kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalized_name

ELIGIBLE = ("FUNCTION", "CLASS", "ENDPOINT", "DATABASE_TABLE")


def correlate(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(runtime_name, status, method, symbol_key, graph_node_id, confidence, candidates).

    One exact match resolves with 1.0, several are ambiguous and end the search;
    else one normalized match resolves with 0.8.
    """
    keys = nodes.where(F.col("node_type").isin(*ELIGIBLE)).select("id", "key").withColumn("norm", normalized_name(F.col("key")))
    ordered = F.array_sort(F.collect_list(F.struct("id", "key")))
    exact = keys.groupBy(F.col("key").alias("_key")).agg(ordered.alias("e"))
    loose = keys.groupBy(F.col("norm").alias("_norm")).agg(ordered.alias("l"))
    j = names.select("runtime_name").distinct().withColumn("_n", normalized_name(F.col("runtime_name")))
    j = j.join(exact, F.col("runtime_name") == F.col("_key"), "left").join(loose, F.col("_n") == F.col("_norm"), "left")
    found = F.coalesce("e", "l")
    method = F.when(F.size("e") == 1, "exact").when(F.size("e") > 1, "ambiguous").when(F.size("l") == 1, "normalized").when(F.size("l") > 1, "ambiguous").otherwise("unresolved")
    j = j.withColumn("method", method).withColumn("f", found)
    sure = F.col("method").isin("exact", "normalized")
    one = F.get("f", F.lit(0))
    return j.select(
        "runtime_name", F.when(sure, "resolved").otherwise(F.col("method")).alias("status"), "method", F.when(sure, one["key"]).alias("symbol_key"), F.when(sure, one["id"]).alias("graph_node_id"),
        F.when(F.col("method") == "exact", 1.0).when(F.col("method") == "normalized", 0.8).otherwise(0.0).alias("confidence"),
        F.when(F.col("method") == "ambiguous", F.transform("f", lambda x: x["key"])).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
