"""Queries over workload planning and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import planning as pl
from ..session import table
from .registry import query

_ENTRIES = """e AS (SELECT p_brand AS brand, p_partkey AS workload_id, p_size AS priority, (p_partkey % 4 + 1)::INT AS rank, floor(p_retailprice / 10) AS cost,
CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 0.8 ELSE 1.0 END AS completeness, p_partkey % 6 = 0 AS fallback, p_partkey % 4 <> 3 AS eligible FROM part)"""
_FOLD = """list_reduce(list_prepend({'w': -1::BIGINT, 'c': 0.0::DOUBLE, 'u': 0.0::DOUBLE, 's': []::BIGINT[], 'o': []::BIGINT[]}, list(struct_pack(w := workload_id, c := cost::DOUBLE, u := 0.0::DOUBLE, s := []::BIGINT[], o := []::BIGINT[]) ORDER BY priority, rank, workload_id)),
lambda a, x: CASE WHEN len(a.s) >= 8 OR a.u + x.c > 300 THEN {'w': x.w, 'c': x.c, 'u': a.u, 's': a.s, 'o': list_append(a.o, x.w)} ELSE {'w': x.w, 'c': x.c, 'u': a.u + x.c, 's': list_append(a.s, x.w), 'o': a.o} END)"""


def entries(spark, sf):
    """Registry entries: parts, one registry for each brand."""
    kind = F.element_at(F.array(*map(F.lit, pl.TYPE_ORDER)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_partkey").alias("workload_id"), F.col("p_size").alias("priority"), pl.type_rank(kind).alias("rank"), F.floor(F.col("p_retailprice") / 10).cast("double").alias("cost"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), 0.8).otherwise(1.0).alias("completeness"), (F.col("p_partkey") % 6 == 0).alias("fallback"), (F.col("p_partkey") % 4 != 3).alias("eligible"),
    )


@query("w07_greedy_budget", f"WITH {_ENTRIES}, f AS (SELECT brand, {_FOLD} AS f FROM e GROUP BY 1) SELECT brand, f.s AS selected, len(f.o) AS over_budget, f.u AS used FROM f")
def w07(spark, sf):
    """Greedy selection in (priority, type, id) order, skipping what does not fit."""
    return pl.greedy_selection(entries(spark, sf), "brand").select("brand", "selected", F.col("skipped").alias("over_budget"), "used")


_MATCH = "CASE kind WHEN 'exact' THEN evidence = value WHEN 'prefix' THEN starts_with(evidence, value) ELSE contains(lower(evidence), lower(value)) END"
_CRITERIA = """cr AS (SELECT p_partkey AS workload_id, o AS ord, CASE o WHEN 0 THEN 'symbol' ELSE 'test' END AS source, CASE o WHEN 0 THEN p_type ELSE split_part(p_name, ' ', 2) END AS value, CASE o WHEN 0 THEN 'exact' ELSE ['prefix', 'contains'][(p_partkey % 2 + 1)::INT] END AS kind FROM part, (VALUES (0), (1)) v(o)),
ev AS (SELECT DISTINCT run_id, source, evidence FROM (SELECT p_brand AS run_id, 'symbol' AS source, p_type AS evidence FROM part WHERE p_size = 7 UNION ALL SELECT p_brand, 'test', upper(split_part(p_name, ' ', 2)) || '_x' FROM part WHERE p_size = 13 UNION ALL SELECT p_brand, 'test', split_part(p_name, ' ', 2) || '_y' FROM part WHERE p_size = 29))"""


def criteria(spark, sf):
    t = table(spark, sf, "part")
    second = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    first = t.select(F.col("p_partkey").alias("workload_id"), F.lit(0).alias("ord"), F.lit("symbol").alias("source"), F.col("p_type").alias("value"), F.lit("exact").alias("match"))
    return first.unionByName(t.select(F.col("p_partkey").alias("workload_id"), F.lit(1).alias("ord"), F.lit("test").alias("source"), second.alias("value"), F.when(F.col("p_partkey") % 2 == 0, "prefix").otherwise("contains").alias("match")))


def evidence(spark, sf):
    t = table(spark, sf, "part")
    second = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    one = lambda size, source, v: t.where(F.col("p_size") == size).select(F.col("p_brand").alias("run_id"), F.lit(source).alias("source"), v.alias("value"))
    return one(7, "symbol", F.col("p_type")).unionByName(one(13, "test", F.concat(F.upper(second), F.lit("_x")))).unionByName(one(29, "test", F.concat(second, F.lit("_y"))))


@query(
    "j15_criterion_match",
    f"""WITH {_CRITERIA}, m AS (SELECT run_id, workload_id, arg_min(struct_pack(s := cr.source, e := evidence), struct_pack(o := ord, e := evidence)) AS b FROM cr JOIN ev ON ev.source = cr.source AND {_MATCH} GROUP BY 1, 2)
SELECT run_id, workload_id, b.s AS source, b.e AS evidence FROM m""",
)
def j15(spark, sf):
    """First criterion that matches, then the smallest evidence."""
    return pl.first_match(criteria(spark, sf), evidence(spark, sf))


@query(
    "a06_workload_plan",
    f"""WITH {_ENTRIES}, {_CRITERIA}, m AS (SELECT DISTINCT run_id AS brand, workload_id FROM cr JOIN ev ON ev.source = cr.source AND {_MATCH}),
j AS (SELECT e.*, CASE WHEN completeness < 1 AND NOT (fallback AND eligible) THEN 'incomplete_graph' WHEN completeness >= 1 AND m.workload_id IS NULL THEN 'node_evidence' END AS omitted FROM e LEFT JOIN m ON m.brand = e.brand AND m.workload_id = e.workload_id),
f AS (SELECT brand, {_FOLD} AS f FROM j WHERE omitted IS NULL GROUP BY 1), i AS (SELECT brand, min(completeness) AS completeness, count(*) FILTER (omitted = 'incomplete_graph') AS incomplete_graph, count(*) FILTER (omitted = 'node_evidence') AS node_evidence FROM j GROUP BY 1)
SELECT i.brand, coalesce(len(f.s), 0) AS selected, coalesce(len(f.o), 0) AS over_budget, coalesce(f.u, 0) AS used, incomplete_graph, node_evidence,
CASE WHEN coalesce(len(f.s), 0) = 0 AND coalesce(len(f.o), 0) > 0 THEN 'budget_exhausted' WHEN completeness < 1 AND coalesce(len(f.s), 0) = 0 THEN 'incomplete_no_fallback' WHEN completeness < 1 THEN 'incomplete_with_fallback' WHEN coalesce(len(f.s), 0) > 0 THEN 'planned' ELSE 'complete_no_applicable' END AS state,
CASE WHEN completeness < 1 AND coalesce(len(f.s), 0) = 0 THEN 0.0 WHEN completeness < 1 THEN completeness * 0.5 ELSE completeness END::DOUBLE AS confidence FROM i LEFT JOIN f ON f.brand = i.brand""",
)
def a06(spark, sf):
    """Plan of each registry with omissions, budget and state."""
    own = entries(spark, sf)
    pairs = own.select(F.col("brand").alias("run_id"), "workload_id")
    matched = pl.first_match(criteria(spark, sf), evidence(spark, sf), pairs).withColumnRenamed("run_id", "brand")
    out = pl.plan(own, matched, "brand")
    return out.select("brand", F.size("selected").alias("selected"), "over_budget", "used", "incomplete_graph", "node_evidence", "state", "confidence")


@query("g08_duplicate_ids", "SELECT p_name AS workload_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 30")
def g08(spark, sf):
    """Ids that occur more often than allowed."""
    return table(spark, sf, "part").groupBy(F.col("p_name").alias("workload_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 30")


@query(
    "w08_context_bundle",
    """WITH i AS (SELECT conv_id, turn, role, strlen(text) AS b, ceil(strlen(text) / 4.0)::BIGINT AS t FROM conversations),
f AS (SELECT conv_id, list_reduce(list_prepend({'k': -1::BIGINT, 'f': '', 'b': 0::BIGINT, 't': 0::BIGINT, 'fs': []::VARCHAR[], 'ub': 0::BIGINT, 'ut': 0::BIGINT, 'inc': []::BIGINT[], 'om': []::VARCHAR[]}, list(struct_pack(k := turn, f := role, b := b::BIGINT, t := t, fs := []::VARCHAR[], ub := 0::BIGINT, ut := 0::BIGINT, inc := []::BIGINT[], om := []::VARCHAR[]) ORDER BY turn)),
 lambda a, x: CASE WHEN len(list_distinct(list_append(a.fs, x.f))) > 1 OR a.ub + x.b > 700 OR a.ut + x.t > 150 THEN {'k': x.k, 'f': x.f, 'b': x.b, 't': x.t, 'fs': a.fs, 'ub': a.ub, 'ut': a.ut, 'inc': a.inc, 'om': list_append(a.om, x.k::VARCHAR || ':' || concat_ws(', ', CASE WHEN len(list_distinct(list_append(a.fs, x.f))) > 1 THEN 'file-count' END, CASE WHEN a.ub + x.b > 700 THEN 'byte-size' END, CASE WHEN a.ut + x.t > 150 THEN 'token-count' END))}
 ELSE {'k': x.k, 'f': x.f, 'b': x.b, 't': x.t, 'fs': list_distinct(list_append(a.fs, x.f)), 'ub': a.ub + x.b, 'ut': a.ut + x.t, 'inc': list_append(a.inc, x.k), 'om': a.om} END) AS f FROM i GROUP BY 1)
SELECT conv_id, f.inc AS included, f.om AS omitted, f.ub AS bytes, f.ut AS tokens, len(f.fs) AS files FROM f""",
)
def w08(spark, sf):
    """Bundle of each conversation under file, byte and token budgets."""
    items = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("turn").alias("key"), F.col("role").alias("file"), "text")
    return pl.bundle(items, "conv_id", 1, 700, 150)


@query(
    "p06_byte_cap_and_p05_file_cap",
    """WITH f AS (SELECT source, lpad(doc_id::VARCHAR, 6, '0') AS path, n_chars AS size FROM documents),
c AS (SELECT source, list_reduce(list_prepend({'p': '', 's': 0::BIGINT, 'u': 0::BIGINT, 'k': []::VARCHAR[]}, list(struct_pack(p := path, s := size::BIGINT, u := 0::BIGINT, k := []::VARCHAR[]) ORDER BY path)), lambda a, x: CASE WHEN a.u + x.s > 20000 THEN {'p': x.p, 's': x.s, 'u': a.u, 'k': a.k} ELSE {'p': x.p, 's': x.s, 'u': a.u + x.s, 'k': list_append(a.k, x.p)} END) AS f FROM f GROUP BY 1),
d AS (SELECT source, count(*) FILTER (rn > 10) AS diagnostics FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY path) AS rn FROM f) GROUP BY 1)
SELECT c.source, f.u AS used, f.k AS kept, diagnostics FROM c JOIN d ON d.source = c.source""",
)
def p06(spark, sf):
    """File-count cap with diagnostics, and a byte cap that skips what does not fit."""
    f = table(spark, sf, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("path"), F.col("n_chars").alias("size"))
    rn = F.row_number().over(Window.partitionBy("source").orderBy("path"))
    over = f.withColumn("rn", rn).groupBy("source").agg(F.count_if(F.col("rn") > 10).alias("diagnostics"))
    return pl.byte_cap(f, "source", 20_000).join(over, "source")


@query(
    "w14_truncation",
    """WITH l AS (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN len(v) > 5 THEN list_append(v[1:5], (len(v) - 5)::VARCHAR || ' more') ELSE v END AS shown FROM l""",
)
def w14(spark, sf):
    """First values and how many are left out."""
    v = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(v.alias("v")).select("o_custkey", pl.truncated(F.col("v"), 5).alias("shown"))
