"""Property graph: merge, centrality, resolution joins, bounded traversal, context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import lookup, ordered, settled, with_previous

OUT_STEPS = ("CALLS", "TESTED_BY", "READS_FROM", "WRITES_TO", "SERVES_ENDPOINT")
CODE_TYPES = ("FUNCTION", "CLASS")


def merge_nodes(facts: DataFrame) -> DataFrame:
    """Facts merged by id: greatest confidence, any change, sorted distinct evidence and locations.

    Path and line come from the first location in string order.
    """
    m = facts.groupBy("id").agg(F.max("confidence").alias("confidence"), F.bool_or("changed").alias("changed"), F.array_sort(F.collect_set("evidence")).alias("evidence"), F.array_sort(F.collect_set("location")).alias("locations"))
    first = F.get("locations", F.lit(0))
    return m.withColumn("path", F.regexp_extract(first, r"^(.*):\d+$", 1)).withColumn("line", F.regexp_extract(first, r":(\d+)$", 1).cast("int"))


def merge_edges(facts: DataFrame) -> DataFrame:
    """Facts merged by (source, target, edge_type)."""
    return facts.groupBy("source", "target", "edge_type").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("evidence")).alias("evidence"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In plus out degree, parallel edges counted, over n - 1; above 1 it is flagged."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    total = nodes.agg(F.count(F.lit(1)).alias("n"))
    j = nodes.select("id").join(degree, "id", "left").crossJoin(F.broadcast(total))  # one row
    value = F.when(F.col("n") > 1, F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return j.select("id", value.alias("centrality"), (value > 1).alias("contract_violation"))


def completeness(change: Column, parsed: Column, eligible: Column, resolved: Column, attempted: Column) -> Column:
    """Product of the shares, an empty denominator counting as 1, limited to [0, 1]."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), change * share(parsed, eligible) * share(resolved, attempted)))


def steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Allowed impact steps (src, dst, edge_type, dir, step_confidence)."""
    kind = nodes.select(F.col("id").alias("_id"), "node_type")
    out = edges.join(kind, F.col("source") == F.col("_id"))
    allowed = (F.col("node_type").isin(*CODE_TYPES) & F.col("edge_type").isin(*OUT_STEPS)) | ((F.col("node_type") == "ENDPOINT") & (F.col("edge_type") == "VALIDATED_BY"))
    forward = out.where(allowed).select(F.col("source").alias("src"), F.col("target").alias("dst"), "edge_type", F.lit(0).alias("dir"), F.col("confidence").alias("step_confidence"))
    into = edges.where("edge_type = 'CALLS'").join(kind, F.col("target") == F.col("_id")).where(F.col("node_type").isin(*CODE_TYPES))
    backward = into.select(F.col("target").alias("src"), F.col("source").alias("dst"), "edge_type", F.lit(1).alias("dir"), F.col("confidence").alias("step_confidence"))
    return forward.unionByName(backward)


def _first_of(found: DataFrame, room: int) -> tuple[DataFrame, int, bool]:
    """The first ``room`` rows of a level, their number, and whether there were more.

    ``found`` is in queue order by (rk, id).  The order is that of a table
    sorted by ranges; only counts come to the driver.
    """
    level = ordered(found, "rk", "id")
    many = level.count()
    if many > room:
        level = with_previous(level, []).where(F.col("_pos") <= room).drop("_pos")
    return level.withColumn("rk", F.col("_seq")).drop("_seq", "_part"), min(many, room), many > room


def traverse(nodes: DataFrame, edges: DataFrame, max_depth: int = 3, max_nodes: int = 64) -> tuple[DataFrame, list[str]]:
    """Impact traversal from the changed nodes: first visit wins in queue order.

    Returns the reached nodes (id, node_type, key, distance, edge_path,
    confidence) and the diagnostics.  The queue is a table: a node's place in it
    is its rank ``rk`` in its level, which follows from the place of the node
    that it was found from and from its own id, as a node's steps are taken in
    the order of their targets.  Each level is a join with the steps, a
    partially aggregated minimum (the first visit), an anti join with what was
    reached, and a sort by ranges; a level ends where the cap is reached.
    """
    moves = settled(steps(nodes, edges))
    fan = settled(moves.groupBy("src").agg(F.count(F.lit(1)).alias("_fan")))
    n_moves = fan.agg(F.sum("_fan")).first()[0] or 0
    path = F.array().cast("array<string>")
    first = nodes.where("changed").select(F.lit(0).cast("long").alias("rk"), "id", F.lit(0).alias("distance"), path.alias("edge_path"), "confidence")
    front, count, truncated = _first_of(first, max_nodes)
    notes, room, reached = [] if count or truncated else ["no_changed_graph_nodes"], max_nodes - count, front
    for depth in range(1, max_depth + 1):
        # Once the cap is reached and passed, no later level adds a row or a note.
        if not count or truncated and not room:
            break
        at = front.select(F.col("id").alias("src"), "rk", "edge_path", "confidence").join(fan, "src")
        visits = lookup(moves, at, ["src"], "_fan", n_moves)
        won = visits.groupBy("dst").agg(F.min(F.struct("rk", "edge_type", "dir", "step_confidence", "edge_path", "confidence")).alias("s"))
        new = won.join(reached.select(F.col("id").alias("dst")), "dst", "left_anti").select(
            "s.rk", F.col("dst").alias("id"), F.lit(depth).alias("distance"), F.concat("s.edge_path", F.array("s.edge_type")).alias("edge_path"), F.least("s.confidence", "s.step_confidence").alias("confidence")
        )
        front, count, more = _first_of(new, room)
        truncated, room, reached = truncated or more, room - count, reached.unionByName(front)
    if truncated:
        notes.append("traversal_node_limit")
    return nodes.select("id", "node_type", "key").join(reached.drop("rk"), "id"), sorted(notes)


def distances(nodes: DataFrame, edges: DataFrame, depth: int, settle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distance of all nodes within ``depth`` steps of a changed one, without a node cap.

    With a ``settle`` that writes, steps and levels are made once; without, each
    level makes all earlier ones again.
    """
    moves = settle(steps(nodes, edges).select("src", "dst"))
    reached = nodes.where("changed").select("id", F.lit(0).alias("distance"))
    front = reached
    for d in range(1, depth + 1):
        new = moves.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        front = settle(new.select("id", F.lit(d).alias("distance")))
        reached = reached.unionByName(front)
    return reached


def context(reached: DataFrame) -> DataFrame:
    """One row of typed keys in (distance, id) order, and reasons by key, later ones winning."""
    ordered = lambda cond: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("distance", "id", "key")))), lambda x: x["key"]))
    kind = F.col("node_type")
    parts = {
        "changed_symbols": F.col("distance") == 0, "affected_symbols": kind.isin(*CODE_TYPES), "affected_tests": kind == "TEST", "affected_endpoints": kind == "ENDPOINT",
        "affected_data_dependencies": kind == "DATABASE_TABLE", "load_scenarios": kind == "LOAD_SCENARIO",
    }
    return reached.agg(*[ordered(c).alias(n) for n, c in parts.items()], F.max("distance").alias("max_distance"))


def induced(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges with both ends reached, one for each (source, target, edge_type)."""
    ids = reached.select(F.col("id"))
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return inside.select("source", "target", "edge_type").distinct()


def resolve_calls(calls: DataFrame, aliases: DataFrame, definitions: DataFrame) -> DataFrame:
    """Call names to definitions: by alias first, else by the exact name; unresolved stay null."""
    a = aliases.select(F.col("alias").alias("name"), F.col("target").alias("aliased"))
    d = definitions.select(F.col("name").alias("d_name"), F.col("id").alias("definition"))
    j = calls.join(a, "name", "left").withColumn("wanted", F.coalesce("aliased", "name"))
    return j.join(d, F.col("wanted") == F.col("d_name"), "left").select("caller", "name", "definition")


def prefixes(name: Column) -> Column:
    """All dotted prefixes of a name."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def longest_module(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """The longest known dotted prefix of each import; ambiguous modules do not count."""
    sure = modules.groupBy("module").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").drop("c")
    wide = imports.withColumn("module", F.explode(prefixes(F.col("name"))))
    best = wide.join(sure, "module").groupBy("name").agg(F.max_by(F.struct("module", "id"), F.length("module")).alias("m"))
    return imports.select("name").distinct().join(best, "name", "left").select("name", F.col("m.module").alias("module"), F.col("m.id").alias("id"))


#: Lines are numbered below 2**_LEVELS.
_LEVELS = 32


def _segments(first: Column, last: Column) -> Column:
    """The aligned segments (level, at) that make up first..last: at most two of each size 2**level."""
    found = []
    for k in range(_LEVELS):
        a, b = F.shiftright(first + (1 << k) - 1, k), F.shiftright(last + 1, k)
        found.append(F.when((a < b) & (a % 2 == 1), F.struct(F.lit(k).alias("level"), a.alias("at"))))
        found.append(F.when((a < b) & (b % 2 == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("at"))))
    return F.array_compact(F.array(*found))


def owners_of_lines(intervals: DataFrame, scopes: DataFrame) -> DataFrame:
    """Owning scope of each changed line: the innermost one that holds it.

    ``intervals`` (file, start, count) name the lines, ``scopes`` (file, symbol,
    first, last, depth) their candidates.  A scope is cut into aligned segments,
    at most 2 * 32 however long it is, and a line lies in one segment of each
    size, so that the join is on (file, level, at); only sizes that occur are
    joined.  A scope that ends before it begins holds no line.
    """
    lines = intervals.where("count > 0").select("file", F.explode(F.sequence(F.col("start").cast("long"), (F.col("start") + F.col("count") - 1).cast("long"))).alias("line")).distinct()
    cut = settled(scopes.select("file", "symbol", "depth", F.explode(_segments(F.col("first").cast("long"), F.col("last").cast("long"))).alias("s")).select("file", "symbol", "depth", "s.level", "s.at"))
    levels = sorted(r["level"] for r in cut.select("level").distinct().collect())  # at most 32
    if not levels:
        return lines.where(F.lit(False)).withColumn("symbol", F.lit(None).cast("string"))
    at = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("line", k).alias("at")) for k in levels])
    places = lines.select("file", "line", F.explode(at).alias("s")).select("file", "line", "s.level", "s.at")
    best = cut.groupBy("file", "level", "at").agg(F.max(F.struct("depth", "symbol")).alias("inner"))
    return places.join(best, ["file", "level", "at"]).groupBy("file", "line").agg(F.max("inner").alias("inner")).select("file", "line", F.col("inner.symbol").alias("symbol"))


def occurrence_names(symbols: DataFrame, key: str, *order: str) -> DataFrame:
    """key, key#2, key#3 … in page order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return symbols.withColumn("name", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), n.cast("string"))))
