"""Queries that apply the scalar functions, predicates and set operators to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import scalars as s
from ..operators import contracts as ct
from ..session import table
from .registry import query


@query(
    "f01_numeric_scalars",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_discount * 15 - 0.3)) AS clamped,
least(l_quantity / 10.0::DOUBLE, 1.0) AS by_ten, least(l_quantity / 5.0::DOUBLE, 1.0) AS by_five, least(l_extendedprice / 200.0::DOUBLE, 1.0) AS by_lines,
CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.4 END AS criticality FROM lineitem""",
)
def f01(spark, sf):
    """clamping and saturating normalizers."""
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", s.clamp(F.col("l_discount") * 15 - 0.3).alias("clamped"), s.saturate(F.col("l_quantity"), 10).alias("by_ten"), s.saturate(F.col("l_quantity"), 5).alias("by_five"), s.saturate(F.col("l_extendedprice"), 200).alias("by_lines"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.4).cast("double").alias("criticality"))


@query(
    "f04_identity_keys",
    """SELECT doc_id, substr(sha256(text), 1, 16) AS short16, substr(sha256(text), 1, 20) AS short20, sha256(concat_ws(chr(31), doc_id::VARCHAR, lang, source, n_chars::VARCHAR)) AS dedup_key,
sha256('{"id":' || doc_id::VARCHAR || ',"lang":"' || lang || '","source":"' || source || '"}') AS json_key,
'pub-' || substr(sha256(source || ':' || lang), 1, 20) AS publication_id, 'rel-' || substr(sha256(source || ':' || lang), 1, 16) AS release_id FROM documents""",
)
def f04(spark, sf):
    """Digests, dedup keys, canonical JSON keys, derived ids."""
    t = table(spark, sf, "documents")
    return t.select(
        "doc_id", s.digest(F.col("text"), 16).alias("short16"), s.digest(F.col("text"), 20).alias("short20"),
        s.dedup_key(F.col("doc_id").cast("string"), F.col("lang"), F.col("source"), F.col("n_chars").cast("string")).alias("dedup_key"),
        s.digest(s.canonical_json(lang=F.col("lang"), source=F.col("source"), id=F.col("doc_id"))).alias("json_key"),
        s.publication_id(F.col("source"), F.col("lang")).alias("publication_id"), s.release_id(F.col("source"), F.col("lang")).alias("release_id"),
    )


@query("f07_hash_sampling", "SELECT event_id, (('0x' || substr(sha256(event_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE) < 0.25 AS sampled, false AS never, true AS always FROM events")
def f07(spark, sf):
    """deterministic sampling by hash."""
    k = F.col("event_id").cast("string")
    return table(spark, sf, "events").select("event_id", s.sampled(k, 0.25).alias("sampled"), s.sampled(k, 0).alias("never"), s.sampled(k, 1).alias("always"))


@query(
    "f10_sql_table_extraction",
    r"""SELECT doc_id, kind, unnest(list_sort(list_distinct(list_transform(regexp_extract_all(text, p, 1), lambda x: lower(x))))) AS table_name FROM documents,
(VALUES ('READS_FROM', '(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)'), ('WRITES_TO', '(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?|DROP\s+TABLE(?:\s+IF\s+EXISTS)?)\s+([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)')) v(kind, p)""",
)
def f10(spark, sf):
    """tables that SQL text reads and writes."""
    t = table(spark, sf, "documents")
    side = lambda kind, c: t.select("doc_id", F.lit(kind).alias("kind"), F.explode(c).alias("table_name"))
    return side("READS_FROM", s.read_tables(F.col("text"))).unionByName(side("WRITES_TO", s.written_tables(F.col("text"))))


@query(
    "f11_http_call_paths",
    r"""WITH c AS (SELECT page_id, 'const r = http.get("' || url || '"); http.post(`${__ENV.BASE_URL}/cart/' || page_id::VARCHAR || '?x=1`); http.put(`${other}/y`)' AS code FROM pages),
u AS (SELECT page_id, unnest(regexp_extract_all(code, 'http\.(?:delete|get|head|options|patch|post|put|trace)\s*\(\s*["''`]([^"''`]*)["''`]', 1)) AS u FROM c),
b AS (SELECT page_id, regexp_replace(regexp_replace(u, '^\$\{[^{}]*\bBASE_URL\b[^{}]*\}', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '') AS u FROM u)
SELECT page_id, regexp_extract(u, '^([^?#]*)', 1) AS path FROM b WHERE starts_with(u, '/') AND NOT contains(u, '${') AND NOT contains(u, '}')""",
)
def f11(spark, sf):
    """literal HTTP calls, base URL stripped, path only."""
    t = table(spark, sf, "pages")
    code = F.concat(F.lit('const r = http.get("'), F.col("url"), F.lit('"); http.post(`${__ENV.BASE_URL}/cart/'), F.col("page_id").cast("string"), F.lit("?x=1`); http.put(`${other}/y`)"))
    return t.select("page_id", F.explode(s.http_paths(code)).alias("path"))


@query(
    "f12_names_and_routes",
    """WITH b AS (SELECT c_custkey, 'pkg/' || replace(c_name, '#', '.v') || '/' || (CASE WHEN c_custkey % 3 = 0 THEN '__init__.py' ELSE 'mod.py' END) AS path, c_name FROM customer)
SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS normalized, 'api/' || c_custkey::VARCHAR AS route,
'pkg.' || replace(replace(c_name, '#', '.v'), '.', '%2E') || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.mod' END AS module,
CASE WHEN c_custkey % 3 = 0 THEN 'pkg.' || replace(replace(c_name, '#', '.v'), '.', '%2E') ELSE 'pkg.' || replace(replace(c_name, '#', '.v'), '.', '%2E') END AS base FROM b""",
)
def f12(spark, sf):
    """Normalized names, routes, modules, relative import bases."""
    t = table(spark, sf, "customer")
    path = F.concat(F.lit("pkg/"), F.replace(F.col("c_name"), F.lit("#"), F.lit(".v")), F.when(F.col("c_custkey") % 3 == 0, "/__init__.py").otherwise("/mod.py"))
    module = s.module_name(path)
    return t.select("c_custkey", s.normalized_name(F.col("c_name")).alias("normalized"), s.route_join(F.lit("api//"), F.concat(F.lit("/"), F.col("c_custkey").cast("string"))).alias("route"), module.alias("module"), s.relative_base(module, F.lit(1), F.col("c_custkey") % 3 == 0).alias("base"))


@query(
    "f14_text_measures",
    r"""SELECT conv_id, turn, ceil(strlen(text) / 4.0)::BIGINT AS tokens, coalesce(CASE WHEN turn % 3 = 0 THEN turn END, turn + 1) AS used,
CASE turn % 4 WHEN 0 THEN 'provider_timeout' WHEN 1 THEN 'rate_limit_or_quota_exhausted' WHEN 2 THEN 'invalid_api_key' ELSE 'provider_error:Odd' END AS reason, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'runs/' || conv_id::VARCHAR || '.json' END AS path,
len(string_split(substr(text, 1, (turn * 7)::INT), chr(10))) AS line, printf('reached at distance %d via %s', turn, role || ' -> CALLS') AS why FROM conversations""",
)
def f14(spark, sf):
    """Token estimates, usage, reasons, paths, line numbers."""
    t = table(spark, sf, "conversations")
    uri = F.concat(F.when(F.col("turn") % 4 == 0, "file:///other/").otherwise("file:///data/"), F.lit("runs/"), F.col("conv_id").cast("string"), F.lit(".json"))
    kind = F.when(F.col("turn") % 4 == 0, "ReadTimeout").otherwise("Odd")
    code = F.element_at(F.array(F.lit(500), F.lit(429), F.lit(403), F.lit(500)), (F.col("turn") % 4 + 1).cast("int"))
    return t.select(
        "conv_id", "turn", s.token_estimate(F.col("text")).alias("tokens"), s.used_tokens(F.when(F.col("turn") % 3 == 0, F.col("turn")), F.col("turn"), F.lit(1)).alias("used"),
        s.reason_code(kind, code).alias("reason"), s.local_path(uri, "/data").alias("path"), s.line_of_offset(F.col("text"), (F.col("turn") * 7).cast("int")).alias("line"),
        s.reason_path(F.array("role", F.lit("CALLS")), F.col("turn")).alias("why"),
    )


@query(
    "f22_ages_and_retention",
    """SELECT event_id, (epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(ts)) // 1000000 AS age_seconds, ts >= TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 30 DAY AS retained, ts + INTERVAL 1 DAY > TIMESTAMP '2024-06-01 00:00:00' AS before_deadline,
CASE WHEN event_type = 'error' THEN map(['event', 'value'], [event_id::VARCHAR, event_type]) ELSE map(['event'], [event_id::VARCHAR]) END::VARCHAR AS attributes FROM events""",
)
def f22(spark, sf):
    """ages, retention cutoff, deadline, optional map keys."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    t = table(spark, sf, "events")
    m = s.present(event=F.col("event_id"), value=F.when(F.col("event_type") == "error", F.col("event_type")))
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))
    seconds = lambda c: F.expr(f"timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', {c})")
    return t.select("event_id", F.floor(F.expr("timestampdiff(MICROSECOND, ts, timestamp_ntz '2024-06-01 00:00:00')") / 1000000).cast("long").alias("age_seconds"), (F.col("ts") >= now - F.expr("interval 30 days")).alias("retained"), (F.col("ts") + F.expr("interval 1 day") > now).alias("before_deadline"), shown.alias("attributes"))


@query("f19_json_key", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def f19(spark, sf):
    """key of a JSON text column."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_PATHS = ["app.py", "loadtests/checkout.js", "web/app.js", "tests/test_a.py", ".github/workflows/ci.yml", "../up.py", "/abs.py", "src/.env", "requirements-dev.txt", "fixtures/data.json", "C:/x.py", "policies/autonomy.json"]


@query(
    "p01_path_predicates",
    r"""WITH b AS (SELECT s_suppkey, ['app.py','loadtests/checkout.js','web/app.js','tests/test_a.py','.github/workflows/ci.yml','../up.py','/abs.py','src/.env','requirements-dev.txt','fixtures/data.json','C:/x.py','policies/autonomy.json'][(s_suppkey % 12 + 1)::INT] AS path FROM supplier)
SELECT s_suppkey, path, path LIKE '%.py' OR path = 'loadtests/checkout.js' AS scope, path = 'tests/test_a.py' AS test,
path IN ('loadtests/checkout.js','tests/test_a.py') AS protected, path NOT IN ('../up.py','/abs.py','C:/x.py') AS safe,
path = 'requirements-dev.txt' AS dependency, path = '.github/workflows/ci.yml' AS workflow, path IN ('fixtures/data.json', 'loadtests/checkout.js') AS fixture, path = 'loadtests/checkout.js' AS scenario FROM b""",
)
def p01(spark, sf):
    """Path predicates."""
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("s_suppkey") % 12 + 1).cast("int"))
    t = table(spark, sf, "supplier").select("s_suppkey", path.alias("path"))
    c = F.col("path")
    return t.select("s_suppkey", "path", pr.in_scope(c).alias("scope"), pr.is_test(c).alias("test"), pr.is_protected(c).alias("protected"), pr.is_safe_relative(c).alias("safe"), pr.is_dependency_file(c).alias("dependency"), pr.is_workflow(c).alias("workflow"), pr.is_fixture(c).alias("fixture"), pr.is_load_scenario(c, F.array(F.lit("x = 1"))).alias("scenario"))


@query(
    "p07_matches_and_secrets",
    r"""SELECT doc_id, lang = 'en' AS exact, starts_with(source, 'src1') AS prefix, contains(lower(text), 'the') AS contains, regexp_matches(text, '(?i)(\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9_]{30,}|sk-[A-Za-z0-9_-]{20,})\b|\b(api[_-]?key|access[_-]?token|secret[_-]?key)\s*[:=]\s*[''"]?[A-Za-z0-9_./+=-]{12,})') AS credential FROM documents""",
)
def p07(spark, sf):
    """Evidence matches, credential pattern."""
    t = table(spark, sf, "documents")
    return t.select("doc_id", pr.matches(F.lit("exact"), F.lit("en"), F.col("lang")).alias("exact"), pr.matches(F.lit("prefix"), F.lit("src1"), F.col("source")).alias("prefix"), pr.matches(F.lit("contains"), F.lit("THE"), F.col("text")).alias("contains"), pr.has_credential(F.col("text")).alias("credential"))


@query(
    "p08_attribute_sanitizing",
    """SELECT event_id, json_extract_string(props, '$.k') AS workload, event_type AS phase, 2 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS redactions FROM events""",
)
def p08(spark, sf):
    """Attribute allow list, sensitive words, size limits, redaction count."""
    big = F.when(F.col("event_id") % 5 == 0, F.repeat(F.lit("x"), 300)).otherwise(F.lit("ok"))
    attributes = F.create_map(F.lit("workload_id"), F.get_json_object("props", "$.k"), F.lit("phase"), F.col("event_type"), F.lit("session_token"), F.lit("a@b"), F.lit("unknown"), F.lit("1"), F.lit("entrypoint"), big)
    t = table(spark, sf, "events").select("event_id", pr.sanitize(attributes).alias("c"))
    return t.select("event_id", F.col("c.kept")["workload_id"].alias("workload"), F.col("c.kept")["phase"].alias("phase"), F.col("c.redactions").alias("redactions"))


@query(
    "p12_test_removal_and_uris",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'test_b' ELSE 'test_a,test_b' END AS removed, s_suppkey % 3 = 0 AS skips, s_suppkey % 4 = 0 AS uri_secret, s_suppkey % 5 = 0 AS secret_key FROM supplier""",
)
def p12(spark, sf):
    """Removed tests, skip markers, secrets in URIs and keys."""
    k = F.col("s_suppkey")
    removed = F.array(F.lit("def test_a():"), F.lit("    async def test_b(x):"), F.lit("def helper():"))
    added = F.array(F.when(k % 2 == 0, "def test_a():").otherwise("def other():"), F.when(k % 3 == 0, "@pytest.mark.skip").otherwise("pass"))
    uri = F.when(k % 4 == 0, "https://u:p@host/x").otherwise("https://host/x?y=1")
    meta = F.create_map(F.when(k % 5 == 0, "api_key").otherwise("commit"), F.lit("v"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(pr.removed_tests(removed, added), ",").alias("removed"), pr.skips_tests(added).alias("skips"), pr.uri_has_secret(uri).alias("uri_secret"), pr.secret_like_key(meta).alias("secret_key"))


@query(
    "p14_contract_quarantine",
    """SELECT event_id, concat_ws(',', CASE WHEN event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type' END, CASE WHEN value IS NULL OR NOT value BETWEEN 0 AND 100 THEN 'value' END, CASE WHEN user_id < 0 THEN 'user_id' END) AS violations
FROM events WHERE event_type IS NULL OR event_type NOT IN ('click', 'view', 'purchase', 'signup') OR value IS NULL OR NOT value BETWEEN 0 AND 100 OR user_id < 0""",
)
def p14(spark, sf):
    """Enum and range validation into a quarantine frame."""
    t = table(spark, sf, "events")
    bad = F.concat_ws(",", F.when(F.col("event_type").isNull() | ~F.col("event_type").isin("click", "view", "purchase", "signup"), "event_type"), F.when(F.col("value").isNull() | ~F.col("value").between(0, 100), "value"), F.when(F.col("user_id") < 0, "user_id"))
    return t.select("event_id", bad.alias("violations")).where("violations <> ''")


_CONTRACT = {
    "event_type": ct.Rule(values=("click", "view", "purchase", "signup")), "value": ct.Rule(low=0, high=60), "note": ct.Rule(optional=True),
    "user": ct.Rule(fields={"id": ct.Rule(low=5), "tier": ct.Rule(values=("a", "b"))}),
}


@query(
    "p14_nested_contracts",
    """WITH j AS (SELECT *, list_filter([CASE WHEN event_type IS NULL THEN 'event_type:missing' WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'event_type:enum' END, CASE WHEN event_id % 11 = 0 THEN 'value:type' WHEN NOT value BETWEEN 0 AND 60 THEN 'value:range' END,
  CASE WHEN event_id % 13 = 0 THEN 'user:missing' WHEN user_id < 5 THEN 'user.id:range' END, CASE WHEN event_id % 13 <> 0 AND event_id % 3 = 2 THEN 'user.tier:enum' END, CASE WHEN event_id % 13 <> 0 AND event_id % 17 = 0 THEN 'user.extra:unknown' END, CASE WHEN event_id % 7 = 0 THEN 'source:unknown' END], lambda x: x IS NOT NULL) AS violations FROM events)
SELECT event_id, violations FROM j WHERE len(violations) > 0""",
)
def p14_nested(spark, sf):
    """Nested JSON contracts with enums, ranges, missing and unknown fields; the faulty records with their faults."""
    k = F.col("event_id")
    user = F.struct(F.col("user_id").alias("id"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (k % 3 + 1).cast("int")).alias("tier"), F.when(k % 17 == 0, 1).alias("extra"))
    value = F.when(k % 11 == 0, "many").otherwise(F.col("value").cast("string"))
    record = F.to_json(F.struct("event_type", value.alias("value"), F.when(k % 13 != 0, user).alias("user"), F.when(k % 7 == 0, "web").alias("source")))
    return ct.quarantine(table(spark, sf, "events").select("event_id", record.alias("record")), "record", _CONTRACT)[1].select("event_id", "violations")


@query(
    "u01_set_operators",
    """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 2000)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""",
)
def u01(spark, sf):
    """Unions, differences and intersections of key sets."""
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("k"))
    tag = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return tag("union", a.union(b).distinct()).union(tag("except", a.subtract(b))).union(tag("intersect", a.intersect(b)))


@query(
    "u06_array_sets_and_maps",
    """SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS statuses, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS last_priority,
coalesce(max(CASE WHEN o_orderstatus = 'P' THEN 'right' END), 'left') AS merged FROM orders GROUP BY 1""",
)
def u06(spark, sf):
    """Ordered distinct values, last-wins dedup, right-wins map merge."""
    t = table(spark, sf, "orders")
    g = t.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_priority"), F.max(F.when(F.col("o_orderstatus") == "P", "right")).alias("right"))
    left, right = F.create_map(F.lit("v"), F.lit("left")), F.create_map(F.lit("v"), F.col("right"))
    return g.select("o_custkey", "statuses", "last_priority", F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))["v"].alias("merged"))


@query(
    "f15_indentation",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 11 WHEN 1 THEN ((s_suppkey % 11) // 8 + 1) * 8 WHEN 2 THEN ((s_suppkey % 11) // 8 + 1) * 8 + 2 ELSE 1 END::INT AS width FROM supplier""",
)
def f15(spark, sf):
    """indentation with tabs and form feeds."""
    k = F.col("s_suppkey")
    tail = F.element_at(F.array(F.lit("x = 1"), F.lit("\tx"), F.lit("\t  # note"), F.lit("\t\f y")), (k % 4 + 1).cast("int"))
    line = F.concat(F.expr("repeat(' ', cast(s_suppkey % 11 as int))"), tail)
    return table(spark, sf, "supplier").select("s_suppkey", s.indentation(line).alias("width"))


@query("f24_diff_text", r"""SELECT n_nationkey, 'diff --git a/' || n_name || ' b/' || n_name || chr(10) || '--- a/' || n_name || chr(10) || '+++ b/' || n_name || chr(10) || '@@ -1,1 +1,2 @@' || chr(10) || '-old' || chr(10) || '+' || n_name || chr(10) || '+end' || chr(10) AS diff FROM nation""")
def f24(spark, sf):
    """text of a diff of one hunk."""
    n = F.col("n_name")
    return table(spark, sf, "nation").select("n_nationkey", s.diff_text(n, F.array(F.lit("old")), F.array(n, F.lit("end"))).alias("diff"))
