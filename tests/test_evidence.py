"""Golden rows, metamorphic checks and plain models of the evidence operators."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from sparkwitness.functions import predicates as pr
from sparkwitness.functions import scalars as sc
from sparkwitness.operators import correlate, gates, graph, history, measure, parse, planning, predict, release, scoring, telemetry
from sparkwitness.plans import proxies
from sparkwitness.plans.catalog import QUERIES


def rows(df, *order):
    return [r.asDict(True) for r in df.orderBy(*order).collect()]


# ------------------------------------------------------------- measurements


def summary(spark, *r):
    return spark.createDataFrame(list(r), "run string, p50_ms double, p95_ms double, p99_ms double, query_count double, throughput double, error_rate double, cv double, repetitions long").drop("p99_ms")


def one(run, queries, p95, cv=0.0, n=5):
    return (run, p95 / 2, p95, p95, queries, 1.0, 0.0, cv, n)


def test_median_and_population_variation(spark):
    s = spark.createDataFrame([("r", 20.0), ("r", 30.0)], "run string, p95_ms double")
    out = measure.summarize(s, "run", metrics=("p95_ms",)).first()
    assert (out["p95_ms"], out["cv"], out["repetitions"]) == (25.0, 0.2, 2)


@pytest.mark.parametrize(
    "left,right,status,reason",
    [
        (one("r", 2.0, 20.0), one("r", 51.0, 25.0), "failed", "query_regression"),
        (one("r", 2.0, 20.0), one("r", 51.0, 25.0, cv=0.3), "failed", "query_regression"),
        (one("r", 2.0, 20.0), one("r", 2.0, 20.0, cv=0.3), "inconclusive", "noisy"),
        (one("r", 2.0, 20.0), one("r", 2.0, 40.0), "failed", "latency_regression"),
        (one("r", 2.0, 20.0), one("r", 2.0, 20.0, n=6), "inconclusive", "sample_count"),
        (one("r", 2.0, 20.0), one("r", 2.0, 20.0), "passed", "none"),
    ],
)
def test_verdict_ladder(spark, left, right, status, reason):
    out = measure.compare(summary(spark, left), summary(spark, right), "run").first()
    assert (out["status"], out["reason"]) == (status, reason)
    if right[4] == 51.0:
        assert out["query_delta"] == 49.0 and out["query_ratio"] == 25.5


def test_ratio_sentinels(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (6.0, 2.0)], "c double, b double")
    assert [r[0] for r in df.select(measure.ratio(F.col("c"), F.col("b"))).collect()] == [1.0, 1e308, 3.0]


def test_three_way(spark):
    kinds = [("passed", "failed"), ("failed", "passed"), ("passed", "passed"), ("inconclusive", "failed")]
    a = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(kinds)], "run int, status string")
    b = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(kinds)], "run int, status string")
    out = rows(measure.three_way(a, b, "run"), "run")
    assert [(r["status"], r["classification"]) for r in out] == [("passed", "improvement"), ("failed", "regression"), ("failed", "no_material_change"), ("inconclusive", "inconclusive")]


# ------------------------------------------------------------- scores and gates

DEBT = ("complexity", "coverage_deficit", "estimated_patch_size", "churn", "graph_centrality", "runtime_impact", "path_criticality", "evidence_confidence")


def debt(spark, values):
    return scoring.debt_score(spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in DEBT))).first()


def test_debt_golden(spark):
    r = debt(spark, (0.8, 0.4, 0.2, 0.6, 0.7, 0.9, 1.0, 0.9))
    assert (r["principal"], r["interest_rate"], r["interest"], r["debt_risk"], r["debt_confidence"]) == (0.48, 0.78, 0.3744, 0.4272, 0.9)
    r = debt(spark, (0.5,) * 8)
    assert (r["principal"], r["interest"], r["debt_risk"]) == (0.5, 0.25, 0.375)
    r = debt(spark, (0.4, 0.4, 0.4, 0.0, 0.0, 0.0, 0.0, 1.0))
    assert r["principal"] == 0.4
    r = debt(spark, (None,) * 8)
    assert r["debt_risk"] == 0.0 and len(r["debt_missing"]) == 8 and r["debt_confidence"] == 0.0


SAFE = ("blast_radius", "criticality", "coverage", "reversibility", "verification_strength", "patch_size", "schema_migration_risk", "data_migration_risk", "context_completeness", "evidence_confidence")


def remediation(spark, values):
    return scoring.remediation_score(spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in SAFE))).first()


def test_remediation_null_rules(spark):
    r = remediation(spark, (None,) * 10)
    assert r["remediation_risk"] == 1.0 and len(r["remediation_missing"]) == 10
    base = [0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0]
    assert remediation(spark, base)["remediation_risk"] == 0.0
    for value, risk in ((0.2, 0.085), (1.0, 0.125), (None, 0.125)):
        assert remediation(spark, base[:6] + [value] + base[7:])["remediation_risk"] == risk


def decision(spark, **over):
    base = dict.fromkeys(DEBT, 0.5) | dict(zip(SAFE, (0.1, 0.1, 1.0, 1.0, 1.0, 0.1, 0.0, 0.0, 1.0, 1.0), strict=True)) | {"evidence_confidence": 1.0} | over
    df = scoring.remediation_score(scoring.debt_score(spark.createDataFrame([tuple(base.values())], ", ".join(f"{n} double" for n in base))))
    df = df.withColumns({"confirmed_regression": F.lit(True), "patch_matches": F.lit(True), "statuses": F.array(F.lit("passed")), "fix_identity": F.lit(True), "patch_binding": F.lit(True), "required": F.array(F.lit("w")), "observed": F.array(F.lit("w")), "identity_failures": F.lit(0)})
    return df


def test_gates_golden_and_monotone(spark):
    full = gates.autonomy(decision(spark), F.lit(3)).first()
    assert (full["level"], full["action"], len(full["gates"])) == (3, "open_pr", 26)
    assert len(gates.autonomy(decision(spark), F.lit(3), with_inputs=False).first()["gates"]) == 17
    assert gates.autonomy(decision(spark), F.lit(1)).first()["level"] == 1
    rng = random.Random(4)
    for _ in range(4):  # taking evidence away never raises autonomy
        name = rng.choice(SAFE[2:9])
        assert gates.autonomy(decision(spark, **{name: None}), F.lit(3)).first()["level"] <= full["level"]


# ------------------------------------------------------------- graph


def plain_traversal(nodes, edges, depth, cap):
    types = {n: t for n, t, *_ in nodes}
    conf = {n: c for n, _, _, c, _ in nodes}
    reached, queue, cut = {}, deque(), False
    for n, *_, changed in sorted(nodes):
        if changed:
            if len(reached) >= cap:
                cut = True
                break
            reached[n] = (0, [], conf[n])
            queue.append(n)
    while queue:
        n = queue.popleft()
        d, path, c = reached[n]
        if d >= depth:
            continue
        moves = []
        for s, t, e, k in edges:
            if s == n and (types[n] in graph.CODE_TYPES and e in graph.OUT_STEPS or types[n] == "ENDPOINT" and e == "VALIDATED_BY"):
                moves.append((t, e, 0, k))
            if t == n and e == "CALLS" and types[n] in graph.CODE_TYPES:
                moves.append((s, e, 1, k))
        for t, e, _, k in sorted(moves, key=lambda m: m[:3]):
            if t in reached:
                continue
            if len(reached) >= cap:
                cut = True
                continue
            reached[t] = (d + 1, [*path, e], min(c, k))
            queue.append(t)
    return reached, cut


@pytest.mark.parametrize("seed", range(5))
def test_traversal_equals_a_plain_queue(spark, seed):
    rng = random.Random(seed)
    kinds = ["FUNCTION", "CLASS", "ENDPOINT", "DATABASE_TABLE", "LOAD_SCENARIO", "TEST"]
    nodes = [(f"n{i:02d}", rng.choice(kinds), f"k{i}", rng.randint(5, 10) / 10, rng.random() < 0.15) for i in range(25)]
    edges = list({(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}", rng.choice([*graph.OUT_STEPS, "VALIDATED_BY", "IMPORTS"])) for _ in range(70)})
    edges = [(*e, rng.randint(5, 10) / 10) for e in edges]
    depth, cap = rng.randint(1, 4), rng.choice([3, 8, 64])
    want, cut = plain_traversal(nodes, edges, depth, cap)
    n = spark.createDataFrame(nodes, "id string, node_type string, key string, confidence double, changed boolean")
    e = spark.createDataFrame(edges, "source string, target string, edge_type string, confidence double")
    got, notes = graph.traverse(n, e, depth, cap)
    assert {r["id"]: (r["distance"], list(r["edge_path"]), r["confidence"]) for r in got.collect()} == want
    assert ("traversal_node_limit" in notes) == cut and ("no_changed_graph_nodes" in notes) == (not want)


GOLDEN_NODES = [("f:pay", "FUNCTION", "Store.checkout", 0.9, True), ("t:r", "TEST", "test_receipt", 0.9, False), ("f:app", "FUNCTION", "store.app.checkout", 0.9, False), ("e:c", "ENDPOINT", "POST /checkout", 0.9, False), ("l:c", "LOAD_SCENARIO", "loadtests/checkout.js", 0.9, False), ("d:p", "DATABASE_TABLE", "broken_store.products", 0.9, False)]
GOLDEN_EDGES = [("f:pay", "t:r", "TESTED_BY"), ("f:app", "f:pay", "CALLS"), ("f:app", "e:c", "SERVES_ENDPOINT"), ("e:c", "l:c", "VALIDATED_BY"), ("f:pay", "d:p", "READS_FROM")]


def test_golden_graph_and_context(spark):
    n = spark.createDataFrame(GOLDEN_NODES, "id string, node_type string, key string, confidence double, changed boolean")
    e = spark.createDataFrame([(*x, 0.8) for x in GOLDEN_EDGES], "source string, target string, edge_type string, confidence double")
    got, notes = graph.traverse(n, e)
    far = got.where("id = 'l:c'").first()
    assert (far["distance"], far["edge_path"], far["confidence"], notes) == (3, ["CALLS", "SERVES_ENDPOINT", "VALIDATED_BY"], 0.8, [])
    c = graph.context(got).first()
    assert c["changed_symbols"] == ["Store.checkout"] and c["affected_symbols"] == ["Store.checkout", "store.app.checkout"] and c["affected_tests"] == ["test_receipt"]
    assert c["affected_endpoints"] == ["POST /checkout"] and c["affected_data_dependencies"] == ["broken_store.products"] and c["max_distance"] == 3
    two, notes = graph.traverse(n, e, max_nodes=2)
    assert two.count() == 2 and notes == ["traversal_node_limit"]
    none, notes = graph.traverse(n.withColumn("changed", F.lit(False)), e)
    assert none.count() == 0 and notes == ["no_changed_graph_nodes"]


def test_subgraph_and_distances_reach_the_bound(spark):
    sf = "/root/testdata/sf0.001"
    edges = {(r["source"], r["target"], r["edge_type"]) for r in proxies.edges(spark, sf).collect()}
    facts = [[tuple(r) for r in df.collect()] for df in (proxies.nodes(spark, sf).select("id", "node_type", "key", "confidence", "changed"), proxies.edges(spark, sf).select("source", "target", "edge_type", "confidence"))]
    reached, _ = plain_traversal(*facts, 3, 64)
    got = {(r["source"], r["target"], r["edge_type"]) for r in QUERIES["j19_traversal_subgraph"](spark, sf).collect()}
    assert got and got == {e for e in edges if e[0] in reached and e[1] in reached}
    whole, _ = plain_traversal(*facts, 3, 10**9)
    far = {r["id"]: r["distance"] for r in QUERIES["a01_distances_to_bound"](spark, sf).collect()}
    assert far == {i: d for i, (d, *_) in whole.items()} and any(i.startswith("load_scenario:") for i in far)


def plain_prediction(nodes, edges, reached, paths, completeness, workloads, signals):
    """Items by (kind, key), features, confidence and omitted context, as the reference states them."""
    kind = {"ENDPOINT": "service", "DATABASE_TABLE": "service", "FUNCTION": "symbol", "CLASS": "symbol", "TEST": "symbol"}
    by = {n[0]: n for n in nodes}
    central = {i: sum((s == i) + (t == i) for s, t, *_ in edges) / (len(nodes) - 1) for i in by}
    items = {}
    for i, (d, path, confidence) in sorted(reached.items(), key=lambda x: (x[1][0], x[0])):
        _, node_type, key, _, changed = by[i]
        score = max(0.0, min(1.0, 0.55 * confidence + 0.25 * central[i] + 0.2 * changed))
        items[kind.get(node_type, "runtime_path"), key] = (pytest.approx(score), f"reachable at distance {d}", ["graph-traversal", *path])
    for _, w, confidence, reason in workloads:
        items["workload", w] = (1.0 if confidence else 0.5, reason, ["workload-registry"])
    features = [min(1.0, len(reached) / len(nodes)), max(central.values()), float(any(p.endswith(".py") for p in paths)), *(signals.get(n) for n in ("history", "coverage", "ownership"))]
    omitted = sorted([f"{n}:omitted" for n in ("history", "coverage", "ownership") if n not in signals] + ["graph:incomplete"] * (completeness < 1))
    return items, features, completeness * (0.5 + 0.5 * sum(f is not None for f in features) / 6), omitted


@pytest.mark.parametrize("seed,completeness,signals", [(0, 0.8, {}), (1, 1.0, {"coverage": 0.4, "history": 0.25}), (2, 1.0, {"ownership": 1.0}), (None, 1.0, {})])
def test_impact_prediction_equals_a_plain_version(spark, seed, completeness, signals):
    nodes, edges = GOLDEN_NODES, [(*x, 0.8) for x in GOLDEN_EDGES]
    if seed is not None:
        rng = random.Random(seed)
        nodes = [(f"n{i:02d}", rng.choice(["FUNCTION", "CLASS", "ENDPOINT", "DATABASE_TABLE", "LOAD_SCENARIO", "TEST"]), f"k{i % 19}", rng.randint(5, 10) / 10, i % 8 == 0) for i in range(25)]
        edges = sorted({(f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}", rng.choice([*graph.OUT_STEPS, "VALIDATED_BY"])) for _ in range(70)})
        edges = [(*e, rng.randint(5, 10) / 10) for e in edges]
    workloads = [(0, "w2", 0.7, "first"), (1, "w1", 0.0, "none"), (2, "w2", 0.0, "last")]
    paths = ["a/b.py", "c.md"] if completeness < 1 else ["c.md"]
    n = spark.createDataFrame(nodes, "id string, node_type string, key string, confidence double, changed boolean")
    e = spark.createDataFrame(edges, "source string, target string, edge_type string, confidence double")
    w = spark.createDataFrame(workloads, "position long, workload_id string, confidence double, reason string")
    got = predict.impact_prediction(n, e, graph.traverse(n, e)[0], spark.createDataFrame([(x,) for x in paths], "path string"), completeness, w, signals).first()
    items, features, confidence, omitted = plain_prediction(nodes, edges, plain_traversal(nodes, edges, 3, 64)[0], paths, completeness, workloads, signals)
    assert [(r["kind"], r["key"]) for r in got["items"]] == sorted(items)
    assert {(r["kind"], r["key"]): (r["score"], r["reason"], r["provenance"]) for r in got["items"]} == items
    assert list(got["features"]) == [f if f is None else pytest.approx(f) for f in features] and got["confidence"] == pytest.approx(confidence)
    assert got["omitted_context"] == omitted and got["required_workload_ids"] == ["w1", "w2"]
    assert tuple(got["risk_signals"]) == (completeness, float(completeness < 1 or "coverage" not in signals))
    if seed is None:
        assert ("runtime_path", "loadtests/checkout.js") in items and items["runtime_path", "loadtests/checkout.js"][1] == "reachable at distance 3"


def test_merge_and_locations_sort_as_text(spark):
    f = spark.createDataFrame([("a", 0.5, False, "x", "m.py:9"), ("a", 0.9, True, "y", "m.py:10")], "id string, confidence double, changed boolean, evidence string, location string")
    r = graph.merge_nodes(f).first()
    assert (r["confidence"], r["changed"], r["evidence"], r["line"]) == (0.9, True, ["x", "y"], 10)


# ------------------------------------------------------------- folds, planning, history


def test_greedy_skips_and_goes_on(spark):
    e = spark.createDataFrame([("g", 1, 1, 1, 200.0), ("g", 2, 2, 1, 150.0), ("g", 3, 3, 1, 100.0)], "g string, workload_id long, priority int, rank int, cost double")
    r = planning.greedy_selection(e, "g").first()
    assert (r["selected"], r["over_budget"], r["used"]) == ([1, 3], [2], 300.0)


def test_byte_cap_skips_and_goes_on(spark):
    f = spark.createDataFrame([("g", "a", 5), ("g", "b", 50), ("g", "c", 5)], "g string, path string, size long")
    assert planning.byte_cap(f, "g", 10).first()["kept"] == ["a", "c"]


def test_chain_detects_tampering(spark):
    r = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "x")], "rel long, seq long, body string")
    ch = release.chain(r, "rel", "seq", "body")
    assert {x["rel"]: x["fault"] for x in release.verify_chain(ch, "rel").collect()} == {1: None, 2: None}
    bad = ch.withColumn("body", F.when(F.col("body") == "b", "z").otherwise(F.col("body")))
    assert {x["rel"]: x["fault"] for x in release.verify_chain(bad, "rel").collect()} == {1: "record was modified", 2: None}
    gone = ch.where("not (rel = 1 and sequence = 1)")
    assert {x["rel"]: x["fault"] for x in release.verify_chain(gone, "rel").collect()}[1] == "chain is broken"


def test_canary_golden(spark):
    cols = "release_id string, validation_passed boolean, telemetry_available boolean, telemetry_age_seconds int, sample_count int, window_minimum int, error_rate double, latency_ms double, verifications int, traces int, observed_at int, deadline_at int"
    ok = ("ok", True, True, 1, 9, 5, 0.01, 100.0, 1, 1, 2, 1)
    cases = {"ok": {}, "err": {6: 0.25}, "slow": {7: 900.0}, "stale": {3: None}, "few": {4: 3}, "early": {10: 0}, "untraced": {9: 0}, "invalid": {1: False, 2: False}}
    df = spark.createDataFrame([tuple(name if i == 0 else change.get(i, v) for i, v in enumerate(ok)) for name, change in cases.items()], cols)
    got = {r["release_id"]: r["action"] for r in release.canary(df, release.Policy()).collect()}
    assert got == {"ok": "promote", "err": "rollback", "slow": "rollback", "stale": "pause", "few": "pause", "early": "pause", "untraced": "pause", "invalid": "rollback"}


def test_status_precedence_and_last_decision(spark):
    e = spark.createDataFrame([("r", 0, "released", None), ("r", 1, "promoted", "promote"), ("r", 2, "rolled_back", None), ("q", 0, "released", None)], "rel string, i int, event string, decision string")
    assert {x["rel"]: (x["status"], x["decision"], x["observations"]) for x in release.summary(e, "rel", "i").collect()} == {"r": ("rolled_back", "promote", 3), "q": ("released", None, 1)}


def test_replay_equals_a_plain_fold(spark):
    rng = random.Random(1)
    runs = {r: [rng.choices(["ok", "failed", "declined", "duplicate_patch", "time_budget_exceeded"], [80, 14, 3, 2, 1])[0] for _ in range(30)] for r in range(20)}
    order = ["context", "diagnose", "patch", "validate", "verify", "decide"]
    want = {}
    for r, outcomes in runs.items():
        stage, attempts, failed, pending, reason = "context", 0, False, None, None
        for o in outcomes:
            if stage == "stopped":
                break
            attempts += stage == "context"
            if stage == "decide":
                reason = pending or ("verified" if o == "ok" and not failed else "decision_declined" if o == "declined" else "max_attempts" if attempts >= 3 else None)
                stage, failed = ("stopped" if reason else "context"), False
            else:
                failed |= o != "ok"
                pending = o if o in ("duplicate_patch", "time_budget_exceeded") else pending
                stage = order[order.index(stage) + 1] if o == "ok" else "decide"
        want[r] = (stage, attempts, reason)
    df = spark.createDataFrame([(r, i, o) for r, os in runs.items() for i, o in enumerate(os)], "run int, i int, outcome string")
    assert {x["run"]: (x["stage"], x["attempts"], x["reason"]) for x in history.replay(df, "run", "i").collect()} == want
    assert len({reason for *_, reason in want.values()}) > 3


def test_correlation_stops_at_ambiguous_exact(spark):
    n = spark.createDataFrame([("a", "FUNCTION", "Foo"), ("b", "CLASS", "Foo"), ("c", "FUNCTION", "bar_baz"), ("d", "TEST", "only.test")], "id string, node_type string, key string")
    names = spark.createDataFrame([("Foo",), ("BarBaz",), ("only.test",)], "runtime_name string")
    assert {r["runtime_name"]: (r["method"], r["confidence"], len(r["candidates"])) for r in correlate.correlate(names, n).collect()} == {"Foo": ("ambiguous", 0.0, 2), "BarBaz": ("normalized", 0.8, 0), "only.test": ("unresolved", 0.0, 0)}


def test_evaluation_edges(spark):
    p = spark.createDataFrame([("r", "symbol", "a", 0.5)], "run string, kind string, key string, score double")
    o = spark.createDataFrame([("r", "symbol", "a"), ("r", "workload", "w"), ("q", "symbol", "z")], "run string, kind string, key string")
    out = {x["run"]: (x["precision"], x["recall"], x["calibration_error"]) for x in predict.evaluate(p, o, "run").collect()}
    assert out == {"r": (1.0, 0.5, 0.5), "q": (1.0, 0.0, 1.0)}


def test_sanitize_caps_and_redacts(spark):
    many = {f"k{i}": "v" for i in range(3)} | {"entrypoint": "x" * 300, "user_token": "t", "phase": "fix"}
    df = spark.createDataFrame([(many,)], "m map<string,string>").select(pr.sanitize(F.col("m")).alias("s"))
    s = df.first()["s"]
    assert s["kept"] == {"phase": "fix"} and s["redactions"] == 5


def test_sampler_bounds_and_span_cap(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"))
    n = df.where(sc.sampled(F.col("k"), 0.5)).count()
    assert 60 < n < 140 and df.where(sc.sampled(F.col("k"), 0)).count() == 0 and df.where(sc.sampled(F.col("k"), 1)).count() == 200
    s = spark.range(10).select(F.lit("r").alias("run"), "id", F.lit("ok").alias("status"))
    assert telemetry.record(s, "run", ["id"], 1, 4).where("recorded = 'limited'").count() == 6


# ------------------------------------------------------------- parsing


def test_loop_scan_rules():
    src = "def f(cursor):\n    for x in cursor.execute('q'):\n        pass\n    else:\n        cursor.execute('a')\n    while 1:\n        cursor.execute('b')\n        def g(conn):\n            conn.execute('c')\nfor y in z:\n    conn.execute('d')\n"
    found = [(f[2], f[3]) for f in parse.source_facts("m.py", src) if f[1] == "loop_query"]
    assert found == [("m.f", 7)]


def test_scopes_take_decorators_and_deeper_comments():
    src = "@a(\n  1)\n@b\ndef f():\n    x = 1\n\n    # inside\n  # also inside\n# outside\ny = 2\n\ndef f():\n\tpass\n"
    found = [(x[2], x[3], x[4]) for x in parse.source_facts("m.py", src) if x[1] == "function"]
    assert found == [("m.f", 1, 8), ("m.f#2", 12, 13)]


def test_diff_text_round_trip(spark):
    d = spark.range(1).select(sc.diff_text(F.lit("a/b.py"), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("z"))).alias("d")).first()["d"]
    files, faults = parse.parse_diff(d)
    assert not faults and files[0]["removed"] == ["x", "y"] and files[0]["added"] == ["z"] and files[0]["new_path"] == "a/b.py"


def test_diff_faults_and_counts():
    good = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n-a\n+b\n+c\n"
    files, faults = parse.parse_diff(good)
    assert not faults and files[0]["added"] == ["b", "c"] and files[0]["removed"] == ["a"]
    assert parse.parse_diff("")[1] == ["empty or no final newline", "no changed file"]
    assert "hunk counts differ" in parse.parse_diff(good.replace("+1,2", "+1,3"))[1]
    assert "rename or copy" in parse.parse_diff("diff --git a/x b/y\nrename from x\nrename to y\n")[1]


def test_delete_reads_and_writes(spark):
    df = spark.createDataFrame([("DELETE FROM Carts; select 1 from a join B.c",)], "q string")
    r = df.select(sc.read_tables(F.col("q")).alias("r"), sc.written_tables(F.col("q")).alias("w")).first()
    assert (r["r"], r["w"]) == (["a", "b.c", "carts"], ["carts"])


# ------------------------------------------------------------- streaming


def test_stream_equals_batch(spark, tmp_path):
    from sparkwitness.streaming import canary

    ev = spark.range(60).select((F.col("id") % 4).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(1700000000 + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    path = str(tmp_path / "events")
    ev.orderBy("event_id").coalesce(1).write.parquet(path)
    stream = canary.event_stream(spark, path, ev.schema)
    got = canary.drain(canary.canary_windows(stream, lateness="0 seconds"), "canary_out", "complete", str(tmp_path / "c1"))
    batch = ev.groupBy(F.col("user_id").alias("release_id"), F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("sample_count"), F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate"), F.max("value").alias("latency_ms"))
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.select(*got.columns).collect()))
    capped = canary.drain(canary.capped_spans(canary.event_stream(spark, path, ev.schema), 10), "capped_out", "append", str(tmp_path / "c2"))
    assert capped.where("recorded = 'limited'").count() == 20


# ------------------------------------------------------------- sources


def test_tree_and_integrity(spark, tmp_path):
    from sparkwitness.sources import artifacts

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.py").write_text("x = 1\n")
    (tmp_path / "n.txt").write_text("no")
    tree = artifacts.tree_entries(spark, str(tmp_path))
    r = tree.first()
    assert tree.count() == 1 and r["path"].endswith("/a/m.py") and r["size"] == 6 and r["source"] == "x = 1\n"
    recorded = tree.select("path", F.lit("other").alias("sha256"))
    assert artifacts.integrity_faults(recorded, tree).count() == 1 and artifacts.integrity_faults(tree.select("path", "sha256"), tree).count() == 0


def test_recorded_journal_is_read_strictly(spark, tmp_path):
    from sparkwitness.sources import artifacts

    (tmp_path / "j.json").write_text('{"release_id":"r","sequence":0,"body":"a"}\n{"release_id":"r","sequence":1,"body":"b"}\n')
    schema = "release_id string, sequence long, body string"
    assert sorted(x["body"] for x in artifacts.read_journal(spark, str(tmp_path), schema).collect()) == ["a", "b"]
    (tmp_path / "k.json").write_text('{"release_id":\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        artifacts.read_journal(spark, str(tmp_path), schema).collect()


def test_registry_and_write_once(spark):
    from sparkwitness.sources import artifacts

    raw = spark.createDataFrame([('{"workload_id":1,"workload_type":"k6","priority":1,"definition_path":"a/b.js"}',), ('{"workload_id":2,"definition_path":"/abs"}',), ("not json",)], "entry string")
    assert [r["rejected"] for r in artifacts.registry(raw, "entry").collect()] == [False, True, True]
    w = spark.createDataFrame([("u", "s1", 1), ("u", "s1", 2), ("u", "s2", 3)], "uri string, sha string, ord int")
    assert [r["outcome"] for r in artifacts.write_once(w, "uri", "sha", "ord").orderBy("ord").collect()] == ["new", "identical", "conflict"]
