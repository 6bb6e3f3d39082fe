"""Recorded artifacts as sources and sinks: summaries, coverage, registries, journals, graph payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import is_safe_relative
from ..tables import lookup, settled

# Where a summary keeps each metric.
_METRICS = {"p50_ms": ("http_req_duration", "med"), "p95_ms": ("http_req_duration", "p(95)"), "p99_ms": ("http_req_duration", "p(99)"), "throughput": ("http_reqs", "rate"), "error_rate": ("http_req_failed", "rate"), "query_count": ("database_queries", "med")}
REGISTRY = "workload_id long, workload_type string, priority int, definition_path string"
MAX_REGISTRY_BYTES, CHURN_COMMITS = 64 * 1024, 20


def load_samples(summaries: DataFrame, json: str) -> DataFrame:
    """Six doubles of each load summary, from the nested layout or the flat one."""
    kind = "metrics map<string, struct<values: map<string, double>>>"
    nested = F.from_json(F.col(json), kind)["metrics"]
    flat = F.from_json(F.col(json), "metrics map<string, map<string, string>>")["metrics"]

    def one(metric: str, field: str):
        direct = flat[metric]
        value = F.coalesce(direct[field], direct["value"]) if metric == "http_req_failed" else direct[field]
        return F.coalesce(nested[metric]["values"][field], value.try_cast("double"))

    return summaries.withColumns({name: one(*where) for name, where in _METRICS.items()})


def coverage_signal(reports: DataFrame, changed: DataFrame, run: str) -> DataFrame:
    """Mean covered share of the changed files of each run."""
    files = reports.select(run, F.explode(F.from_json("coverage", "map<string, struct<summary: struct<percent_covered: double>>>")).alias("file", "r"))
    use = files.join(changed, [run, "file"], "left_semi")
    return use.groupBy(run).agg(F.avg(F.col("r.summary.percent_covered") / 100).alias("coverage"))


def churn_signal(commits: DataFrame, run: str, *order: str) -> DataFrame:
    """Share of the 20 latest commits that a run has."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(*[F.desc(c) for c in order]))
    top = commits.withColumn("_n", n).where(F.col("_n") <= CHURN_COMMITS)
    return top.groupBy(run).agg(F.least(F.count(F.lit(1)) / F.lit(float(CHURN_COMMITS)), F.lit(1.0)).alias("churn"))


def owner_patterns(lines: DataFrame, text: str) -> DataFrame:
    """Patterns of an owners file: the first word of lines with owners, comments left out, ``*`` stripped at both ends."""
    words = F.split(F.trim(text), r"\s+")
    return lines.where(~F.trim(text).startswith("#") & (F.size(words) > 1)).select(F.regexp_replace(words[0], r"^\*+|\*+$", "").alias("pattern")).distinct()


def _floor_power(length: Column) -> Column:
    """The greatest power of two up to a length."""
    return F.pow(F.lit(2), F.length(F.bin(length)) - 1).cast("int")


def _windows(text: Column, size: int) -> Column:
    """All pieces (head, at) of a length."""
    starts = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
    all_of = F.transform(starts, lambda i: F.struct(F.substring(text, i, F.lit(size)).alias("head"), i.alias("at")))
    return F.when(F.char_length(text) >= size, all_of).otherwise(F.array().cast("array<struct<head:string,at:int>>"))


def ownership_signal(paths: DataFrame, patterns: DataFrame, path: str) -> DataFrame:
    """Adds ``owned``: whether any pattern is part of the path; false for a null path.

    Paths meet patterns by equality only.  A pattern's head is its beginning of
    the greatest power of two that fits; a path's windows of these lengths are
    joined with the heads, each of which names the lengths of its patterns
    (fewer than its own), and the pieces of those lengths are joined with the
    patterns.  So any number of patterns is dealt over the tasks, and a head
    that many patterns share does not multiply them.
    """
    known = settled(patterns.select("pattern").where("pattern is not null").distinct().withColumn("n", F.char_length("pattern")))
    has_empty = bool(known.where("n = 0").limit(1).count())
    size = _floor_power(F.col("n"))
    heads = known.where("n > 0").groupBy(F.substring("pattern", F.lit(1), size).alias("head"), size.alias("size")).agg(F.collect_set("n").alias("lengths"))
    sizes = sorted(r["size"] for r in heads.select("size").distinct().collect())  # powers of two
    each = settled(paths.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("p")).agg(F.count(F.lit(1)).alias("w")))
    total = each.agg(F.sum("w")).first()[0] or 0
    if has_empty or not sizes:
        return paths.withColumn("owned", F.col(path).isNotNull() & F.lit(has_empty))
    places = F.flatten(F.array(*[_windows(F.col("p"), b) for b in sizes]))
    windows = settled(each.select("p", F.explode(places).alias("x")).select("p", "x.head", "x.at"))
    fan = windows.groupBy("head").agg(F.count(F.lit(1)).alias("m"))
    near = lookup(windows, fan.join(heads, "head").select("head", "lengths", "m"), ["head"], "m", windows.count()).select("p", "at", F.explode("lengths").alias("n"))
    pieces = settled(near.where(F.col("at") + F.col("n") - 1 <= F.char_length("p")).select("p", F.substring("p", F.col("at"), F.col("n")).alias("pattern")).distinct())
    found = pieces.groupBy("pattern").agg(F.count(F.lit(1)).alias("m")).join(known.select("pattern"), "pattern")
    hits = lookup(pieces, found, ["pattern"], "m", pieces.count()).select("p").distinct()
    judged = each.join(hits.withColumn("owned", F.lit(True)), "p", "left").select(F.col("p").alias(path), "w", F.coalesce("owned", F.lit(False)).alias("owned"))
    none = paths.where(F.col(path).isNull()).withColumn("owned", F.lit(False))
    return lookup(paths.where(F.col(path).isNotNull()), judged, [path], "w", total).unionByName(none)


def registry(raw: DataFrame, json: str) -> DataFrame:
    """Typed registry entries; an entry that is too large or has an unsafe path is flagged."""
    e = raw.withColumn("e", F.from_json(F.col(json), REGISTRY))
    bad = (F.octet_length(json) > MAX_REGISTRY_BYTES) | F.col("e").isNull() | ~is_safe_relative(F.col("e.definition_path"))
    return e.select("e.*", F.coalesce(bad, F.lit(True)).alias("rejected"))


def write_once(requests: DataFrame, uri: str, digest: str, order: str) -> DataFrame:
    """new for the first write of a URI, identical for equal content, conflict for other content."""
    first = requests.groupBy(uri).agg(F.min(F.struct(order, digest)).alias("_first"))
    j = requests.join(first, uri)
    outcome = F.when(F.col(order) == F.col(f"_first.{order}"), "new").when(F.col(digest) == F.col(f"_first.{digest}"), "identical").otherwise("conflict")
    return j.withColumn("outcome", outcome).drop("_first")


def canonical_graph(edges: DataFrame, key: str) -> DataFrame:
    """Compact JSON of each graph with sorted edges, nodes and keys."""
    e = F.array_sort(F.collect_list(F.struct("source", "target")))
    n = F.array_sort(F.collect_set("source"))
    return edges.groupBy(key).agg(F.to_json(F.struct(e.alias("edges"), n.alias("nodes"))).alias("payload"))


def tree_entries(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """Files below a folder with their content, by Spark's own reader."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return f.select(F.regexp_replace("path", "^.*?://*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.try_to_binary(F.base64("content"), F.lit("base64")).cast("string").alias("source"))


def integrity_faults(artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Artifacts whose stored content has another digest than recorded."""
    s = stored.select("path", F.col("sha256").alias("actual"))
    return artifacts.join(s, "path").where("sha256 <> actual")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines journal; a malformed record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def output_head(logs: DataFrame, text: str, limit: int) -> DataFrame:
    """Bounded head, digest and size of recorded output; the whole output stays where it is."""
    return logs.withColumns({"head": F.substring(text, 1, limit), "digest": F.sha2(text, 256), "bytes": F.octet_length(text).cast("long"), "truncated": F.char_length(text) > limit})
