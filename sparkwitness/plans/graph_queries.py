"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import predict as pd
from ..session import table
from ..tables import settled
from . import proxies as p
from .registry import ORACLE, query


def _plain(df):
    return df


@query(
    "g14_node_merge",
    """WITH f AS (SELECT l_suppkey AS id, l_discount * 10 AS confidence, l_returnflag = 'R' AS changed, l_linestatus AS evidence, 'src/' || (l_partkey % 7)::VARCHAR || '.py:' || l_linenumber::VARCHAR AS location FROM lineitem),
m AS (SELECT id, max(confidence) AS confidence, bool_or(changed) AS changed, list_sort(list_distinct(list(evidence))) AS evidence, list_sort(list_distinct(list(location))) AS locations FROM f GROUP BY 1)
SELECT id, round(confidence, 6) AS confidence, changed, evidence, len(locations) AS places, regexp_extract(locations[1], '^(.*):[0-9]+$', 1) AS path, regexp_extract(locations[1], ':([0-9]+)$', 1)::INT AS line FROM m""",
)
def g14(spark, sf):
    """Node facts merged on their id."""
    t = table(spark, sf, "lineitem")
    facts = t.select(F.col("l_suppkey").alias("id"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_returnflag") == "R").alias("changed"), F.col("l_linestatus").alias("evidence"), F.concat(F.lit("src/"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py:"), F.col("l_linenumber").cast("string")).alias("location"))
    return gr.merge_nodes(facts).select("id", F.round("confidence", 6).alias("confidence"), "changed", "evidence", F.size("locations").alias("places"), "path", "line")


@query("g14_edge_merge", "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS edge_type, max(l_discount) AS confidence, list_sort(list_distinct(list(l_linestatus))) AS evidence FROM lineitem GROUP BY 1, 2, 3")
def g14_edges(spark, sf):
    """Edge facts merged on (source, target, type)."""
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("edge_type"), F.col("l_discount").alias("confidence"), F.col("l_linestatus").alias("evidence"))
    return gr.merge_edges(t)


_CENTRALITY_SQL = "cen AS (SELECT n.id, coalesce(d.c, 0) / ((SELECT count(*) FROM nodes) - 1)::DOUBLE AS centrality FROM nodes n LEFT JOIN (SELECT id, count(*) AS c FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1) d ON d.id = n.id)"


@query("g12_degree_centrality", f"WITH {p.NODES_SQL}, {p.EDGES_SQL}, {_CENTRALITY_SQL} SELECT id, round(centrality, 9) AS centrality, centrality > 1 AS contract_violation FROM cen")
def g12(spark, sf):
    """Degree centrality, raw, with a flag where it passes 1."""
    return gr.degree_centrality(p.nodes(spark, sf), p.edges(spark, sf)).select("id", F.round("centrality", 9).alias("centrality"), "contract_violation")


@query(
    "g13_completeness",
    """SELECT l_suppkey, round(greatest(0.0, least(1.0, 0.9::DOUBLE * (CASE WHEN count(*) FILTER (l_returnflag <> 'N') = 0 THEN 1.0 ELSE count(*) FILTER (l_returnflag = 'A') / count(*) FILTER (l_returnflag <> 'N')::DOUBLE END)
* (CASE WHEN count(*) FILTER (l_quantity > 60) = 0 THEN 1.0 ELSE 0.5 END))), 9) AS completeness, round(avg((l_linestatus = 'O')::INT), 9) AS scanned FROM lineitem GROUP BY 1""",
)
def g13(spark, sf):
    """Completeness as a product of shares, empty denominators counting as 1."""
    t = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("parsed"), F.count_if(F.col("l_returnflag") != "N").alias("eligible"), F.count_if(F.col("l_quantity") > 60).alias("attempted"), F.avg((F.col("l_linestatus") == "O").cast("int")).alias("scanned"))
    c = gr.completeness(F.lit(0.9), F.col("parsed").cast("double"), F.col("eligible").cast("double"), F.col("attempted") / 2.0, F.col("attempted").cast("double"))
    return t.select("l_suppkey", F.round(c, 9).alias("completeness"), F.round("scanned", 9).alias("scanned"))


@query("a01_impact_traversal", f"WITH {p.traversal_sql()} SELECT id, node_type, key, distance, edge_path, confidence, diagnostics FROM reached, notes")
def a01(spark, sf):
    """Bounded traversal in queue order."""
    reached, notes = gr.traverse(p.nodes(spark, sf), p.edges(spark, sf))
    return reached.withColumn("diagnostics", F.lit(",".join(notes)))


@query(
    "a01_distances",
    f"""WITH RECURSIVE {p.NODES_SQL}, {p.EDGES_SQL},
st AS (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE split_part(source, ':', 1) IN ('function', 'class') AND edge_type IN ('CALLS', 'READS_FROM', 'SERVES_ENDPOINT') OR edge_type = 'VALIDATED_BY'
  UNION SELECT target, source FROM edges WHERE edge_type = 'CALLS'),
walk(id, d) AS (SELECT id, 0 FROM nodes WHERE changed UNION SELECT st.dst, walk.d + 1 FROM walk JOIN st ON st.src = walk.id WHERE walk.d < 2)
SELECT id, min(d) AS distance FROM walk GROUP BY 1""",
)
def a01_distances(spark, sf):
    """A1 without its cap: distances within two steps."""
    return gr.distances(p.nodes(spark, sf), p.edges(spark, sf), 2, _plain)


@query("a01_distances_to_bound", ORACLE["a01_distances"].replace("walk.d < 2", "walk.d < 3"))
def a01_bound(spark, sf):
    """A1 without its cap, to its own bound of three steps."""
    return gr.distances(p.nodes(spark, sf), p.edges(spark, sf), 3, settled)


@query(
    "j19_impact_subgraph",
    f"""WITH {p.NODES_SQL}, {p.EDGES_SQL}, near AS (SELECT id FROM nodes WHERE changed UNION SELECT target FROM edges JOIN nodes ON nodes.id = source AND changed)
SELECT DISTINCT source, target, edge_type FROM edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)""",
)
def j19(spark, sf):
    """Edges with both ends near a change (J19 and A34 are ``j19_traversal_subgraph``)."""
    nodes, edges = p.nodes(spark, sf), p.edges(spark, sf)
    changed = nodes.where("changed").select("id")
    near = changed.unionByName(edges.join(changed, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))).distinct()
    return gr.induced(edges, near)


@query("j19_traversal_subgraph", f"WITH {p.traversal_sql()} SELECT DISTINCT source, target, edge_type FROM edges WHERE source IN (SELECT id FROM reached) AND target IN (SELECT id FROM reached)")
def j19_traversal(spark, sf):
    """Edges with both ends among A1's reached nodes."""
    nodes, edges = p.nodes(spark, sf), p.edges(spark, sf)
    return gr.induced(edges, gr.traverse(nodes, edges)[0])


def _keys_sql(condition: str) -> str:
    """Keys in (distance, id) order, each at its first place."""
    return f"(SELECT coalesce(list(key ORDER BY distance, id), []) FROM (SELECT key, distance, id, row_number() OVER (PARTITION BY key ORDER BY distance, id) AS n FROM reached WHERE {condition}) WHERE n = 1)"


@query(
    "a02_repository_context",
    f"""WITH {p.traversal_sql()} SELECT {_keys_sql("distance = 0")} AS changed_symbols, {_keys_sql("node_type IN ('FUNCTION', 'CLASS')")} AS affected_symbols, {_keys_sql("node_type = 'TEST'")} AS affected_tests,
{_keys_sql("node_type = 'ENDPOINT'")} AS affected_endpoints, {_keys_sql("node_type = 'DATABASE_TABLE'")} AS affected_data_dependencies, {_keys_sql("node_type = 'LOAD_SCENARIO'")} AS load_scenarios, (SELECT max(distance) FROM reached) AS max_distance""",
)
def a02(spark, sf):
    """Typed keys of the reached nodes in traversal order."""
    reached, _ = gr.traverse(p.nodes(spark, sf), p.edges(spark, sf))
    return gr.context(reached)


@query(
    "a16_impact_prediction",
    f"""WITH {p.NODES_SQL}, {p.EDGES_SQL}, {_CENTRALITY_SQL}, r AS (SELECT n.*, 0 AS distance FROM nodes n WHERE changed OR node_type IN ('ENDPOINT', 'LOAD_SCENARIO')),
s AS (SELECT CASE WHEN node_type IN ('ENDPOINT', 'DATABASE_TABLE') THEN 'service' WHEN node_type IN ('FUNCTION', 'CLASS', 'TEST') THEN 'symbol' ELSE 'runtime_path' END AS kind, key,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55 * confidence + 0.25 * centrality + 0.20 * changed::INT)) AS score, r.id FROM r JOIN cen ON cen.id = r.id)
SELECT kind, key, round(arg_max(score, id), 9) AS score, 'reachable at distance 0' AS reason FROM s GROUP BY 1, 2""",
)
def a16(spark, sf):
    """Scores of given nodes, last of a key wins (A16 is ``a16_prediction_of_traversal``)."""
    nodes = p.nodes(spark, sf)
    reached = nodes.where("changed or node_type in ('ENDPOINT', 'LOAD_SCENARIO')").select("id", "node_type", "key", "confidence", F.lit(0).alias("distance"))
    items = pd.predicted_items(reached, gr.degree_centrality(nodes, p.edges(spark, sf)), nodes)
    return items.select("kind", "key", F.round("score", 9).alias("score"), "reason")


@query("a16_prediction_of_traversal")
def a16_traversal(spark, sf):
    """A1's reached nodes scored by G12, with workloads, features and confidence (tests compare it with a plain version)."""
    nodes, edges = p.nodes(spark, sf), p.edges(spark, sf)
    reached, _ = gr.traverse(nodes, edges)
    workloads = table(spark, sf, "region").select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("workload_id"), (F.col("r_regionkey") % 2 / 2.0).alias("confidence"), F.lit("registered").alias("reason"))
    paths = nodes.where("changed").select(F.concat(F.col("key"), F.lit(".py")).alias("path"))
    return pd.impact_prediction(nodes, edges, reached, paths, 0.9, workloads)


@query(
    "a16_traversal_items",
    f"""WITH {p.traversal_sql()}, {_CENTRALITY_SQL},
item AS (SELECT CASE WHEN node_type IN ('ENDPOINT', 'DATABASE_TABLE') THEN 'service' WHEN node_type IN ('FUNCTION', 'CLASS', 'TEST') THEN 'symbol' ELSE 'runtime_path' END AS kind, key,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.55 * confidence + 0.25 * centrality + 0.20 * changed::INT)) AS score, 'reachable at distance ' || distance::VARCHAR AS reason, list_prepend('graph-traversal', edge_path) AS provenance, distance, r.id
  FROM reached r JOIN cen ON cen.id = r.id)
SELECT kind, key, round(score, 9) AS score, reason, provenance FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY distance DESC, id DESC) AS n FROM item) WHERE n = 1""",
)
def a16_items(spark, sf):
    """Items of A1's reached nodes as rows, each with its score, reason and path."""
    nodes, edges = p.nodes(spark, sf), p.edges(spark, sf)
    return pd.predicted_items(gr.traverse(nodes, edges)[0], gr.degree_centrality(nodes, edges), nodes).withColumn("score", F.round("score", 9))


@query(
    "a16_traversal_summary",
    f"""WITH {p.traversal_sql()}, {_CENTRALITY_SQL}, f AS (SELECT greatest(0.0, least(1.0, (SELECT count(*) FROM reached) / (SELECT count(*) FROM nodes)::DOUBLE)) AS reachability, (SELECT max(centrality) FROM cen) AS centrality,
  CASE WHEN (SELECT count(*) FROM nodes WHERE changed) > 0 THEN 1.0 ELSE 0.0 END AS changed_file_type)
SELECT (SELECT list('w' || r_regionkey::VARCHAR ORDER BY 'w' || r_regionkey::VARCHAR) FROM region) AS required_workload_ids, round(reachability, 9) AS reachability, round(centrality, 9) AS centrality, changed_file_type::DOUBLE AS changed_file_type, 0.25::DOUBLE AS history_churn,
  round(0.9::DOUBLE * (0.5 + 0.5 * 4 / 6.0), 9) AS confidence, ['coverage:omitted', 'graph:incomplete', 'ownership:omitted'] AS omitted_context, 0.9::DOUBLE AS graph_completeness, 1.0::DOUBLE AS validation_required, 'impact-v1' AS predictor_revision FROM f""",
)
def a16_summary(spark, sf):
    """Features, confidence, risk signals and omissions of the prediction from A1's reached nodes."""
    nodes, edges = p.nodes(spark, sf), p.edges(spark, sf)
    workloads = table(spark, sf, "region").select(F.col("r_regionkey").alias("position"), F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("workload_id"), F.lit(0.5).alias("confidence"), F.lit("registered").alias("reason"))
    paths = nodes.where("changed").select(F.concat(F.col("key"), F.lit(".py")).alias("path"))
    out = pd.impact_prediction(nodes, edges, gr.traverse(nodes, edges)[0], paths, 0.9, workloads, {"history": 0.25})
    rounded = lambda c: F.round(f"features.{c}", 9).alias(c)
    return out.select("required_workload_ids", rounded("reachability"), rounded("centrality"), "features.changed_file_type", "features.history_churn", F.round("confidence", 9).alias("confidence"), "omitted_context", "risk_signals.graph_completeness", "risk_signals.validation_required", "predictor_revision")


@query(
    "j11_call_resolution",
    """WITH calls AS (SELECT o_orderkey AS caller, 'Customer#' || lpad((o_custkey + o_custkey % 3 * 500)::VARCHAR, 9, '0') AS name FROM orders), alias AS (SELECT 'Customer#' || lpad((c_custkey + 1600)::VARCHAR, 9, '0') AS alias, c_name AS target FROM customer WHERE c_acctbal < 0)
SELECT caller, calls.name, d.c_custkey AS definition FROM calls LEFT JOIN alias ON alias.alias = calls.name LEFT JOIN customer d ON d.c_name = coalesce(alias.target, calls.name)""",
)
def j11(spark, sf):
    """Call names resolved by alias, else exactly."""
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    calls = table(spark, sf, "orders").select(F.col("o_orderkey").alias("caller"), name(F.col("o_custkey") + F.col("o_custkey") % 3 * 500).alias("name"))
    c = table(spark, sf, "customer")
    return gr.resolve_calls(calls, c.where("c_acctbal < 0").select(name(F.col("c_custkey") + 1600).alias("alias"), F.col("c_name").alias("target")), c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id")))


_IMPORTS_SQL = """imp AS (SELECT DISTINCT replace(p_name, ' ', '.') || '.' || p_brand AS name FROM part), mods AS (SELECT split_part(p_name, ' ', 1) AS module, min(p_partkey) AS id FROM part GROUP BY 1
UNION ALL SELECT replace(p_name, ' ', '.') AS module, p_partkey AS id FROM part WHERE p_size = 3)"""


@query(
    "j12_longest_module",
    f"""WITH {_IMPORTS_SQL}, sure AS (SELECT module, min(id) AS id FROM mods GROUP BY 1 HAVING count(*) = 1),
hit AS (SELECT name, arg_max(module, length(module)) AS module, arg_max(id, length(module)) AS id FROM imp JOIN sure ON name = module OR starts_with(name, module || '.') GROUP BY 1)
SELECT imp.name, hit.module, hit.id FROM imp LEFT JOIN hit ON hit.name = imp.name""",
)
def j12(spark, sf):
    """Longest dotted prefix among unambiguous modules, by exploded prefixes."""
    t = table(spark, sf, "part")
    dotted = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    imports = t.select(F.concat(dotted, F.lit("."), F.col("p_brand")).alias("name")).distinct()
    roots = t.groupBy(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("module")).agg(F.min("p_partkey").alias("id"))
    return gr.longest_module(imports, roots.unionByName(t.where("p_size = 3").select(dotted.alias("module"), F.col("p_partkey").alias("id"))))


@query(
    "j14_line_owners",
    """WITH iv AS (SELECT s_nationkey AS file, (s_suppkey % 40 + 1)::INT AS start, (s_suppkey % 4)::INT AS n FROM supplier), lines AS (SELECT DISTINCT file, start + i AS line FROM iv, generate_series(0, n - 1) g(i) WHERE n > 0),
sc AS (SELECT n_nationkey AS file, 'module' AS symbol, 1 AS first, 44 AS last, 0 AS depth FROM nation UNION ALL SELECT n_nationkey, 'outer', 5, 30, 1 FROM nation UNION ALL SELECT n_nationkey, 'inner', 10, 10 + n_nationkey % 9, 2 FROM nation)
SELECT lines.file, line, arg_max(symbol, depth) AS symbol FROM lines JOIN sc ON sc.file = lines.file AND line BETWEEN first AND last GROUP BY 1, 2""",
)
def j14(spark, sf):
    """Changed lines to the innermost scope, as an equi join on lines."""
    iv = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("file"), (F.col("s_suppkey") % 40 + 1).cast("int").alias("start"), (F.col("s_suppkey") % 4).cast("int").alias("count"))
    n = table(spark, sf, "nation")
    one = lambda s, a, b, d: n.select(F.col("n_nationkey").alias("file"), F.lit(s).alias("symbol"), F.lit(a).alias("first"), b.cast("int").alias("last"), F.lit(d).alias("depth"))
    scopes = one("module", 1, F.lit(44), 0).unionByName(one("outer", 5, F.lit(30), 1)).unionByName(one("inner", 10, 10 + F.col("n_nationkey") % 9, 2))
    return gr.owners_of_lines(iv, scopes)


@query("w09_occurrence_names", "SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '#' || n::VARCHAR END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)")
def w09(spark, sf):
    """Numbering of repeated keys."""
    return gr.occurrence_names(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "name")


@query("j18_scenario_endpoints", "SELECT s_suppkey, n_nationkey AS endpoint, n_nationkey IS NULL AS unresolved FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 4")
def j18(spark, sf):
    """Load-scenario calls to endpoints, unresolved ones flagged."""
    n = table(spark, sf, "nation").where("n_regionkey < 4").select("n_nationkey")
    j = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.col("n_nationkey").alias("endpoint"), F.col("n_nationkey").isNull().alias("unresolved"))


@query("j23_unevidenced_symbols", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j23(spark, sf):
    """Changed symbols without evidence, by anti join."""
    ev = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey").join(ev, "c_custkey", "left_anti")
