"""Operators that stand groups of any size, against plain versions, with the sizes that split them set low."""

import hashlib
import random
import subprocess
import time
from collections import deque
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sparkwitness import tables
from sparkwitness.operators import contracts, graph, history, planning, release
from sparkwitness.plans import graph_queries
from sparkwitness.sources import artifacts, objects
from sparkwitness.sources.journal import Journal
from sparkwitness.streaming import state

NODE = "id string, node_type string, key string, confidence double, changed boolean"
EDGE = "source string, target string, edge_type string, confidence double"


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables keep their ranges, so that groups span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ------------------------------------------------------------- order and joins


def test_prefix_sums_and_previous_span_ranges(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    o = tables.ordered(df, "g", "o")
    assert o.select("_part").distinct().count() > 1
    want, seen, last = {}, {}, {}
    for g, i, v in rows:
        n, s = seen.get(g, (0, 0))
        want[g, i] = (s, n + 1, last.get(g))
        seen[g], last[g] = (n + 1, s + v), v
    sums = {(r["g"], r["o"]): r["s"] for r in tables.prefix_sums(o, ["g"], {"s": F.col("v")}).collect()}
    before = {(r["g"], r["o"]): (r["_pos"], r["_before_v"]) for r in tables.with_previous(o, ["g"], "v").collect()}
    assert sums == {k: s for k, (s, _, _) in want.items()} and before == {k: w[1:] for k, w in want.items()}


def test_lookup_takes_hot_and_null_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(600)] + [(f"k{i}", i) for i in range(400)] + [(None, 7), ("lost", 8)], "k string, i long")
    one = rows.where("k is null or k <> 'lost'").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("i").alias("top"))
    got = tables.lookup(rows, one, ["k"], "w", rows.count())
    assert got.count() == 1001 and got.columns == ["k", "i", "top"]
    assert {(r["k"], r["top"]) for r in got.collect()} == {("hot", 599), (None, 7), *[(f"k{i}", i) for i in range(400)]}


# ------------------------------------------------------------- traversal


def plain_queue(nodes, edges, depth, cap):
    """First visits by a queue, with the steps of each node looked up."""
    kind, conf, out, into = {n: t for n, t, *_ in nodes}, {n: c for n, _, _, c, _ in nodes}, {}, {}
    for s, t, e, k in edges:
        if kind[s] in graph.CODE_TYPES and e in graph.OUT_STEPS or kind[s] == "ENDPOINT" and e == "VALIDATED_BY":
            out.setdefault(s, []).append((t, e, 0, k))
        if e == "CALLS" and kind[t] in graph.CODE_TYPES:
            into.setdefault(t, []).append((s, e, 1, k))
    starts = sorted(n for n, *_, changed in nodes if changed)
    reached = {n: (0, [], conf[n]) for n in starts[:cap]}
    queue, cut = deque(starts[:cap]), len(starts) > cap
    while queue:
        n = queue.popleft()
        d, path, c = reached[n]
        for t, e, _, k in sorted(out.get(n, []) + into.get(n, []), key=lambda m: m[:3]) if d < depth else []:
            if t not in reached:
                if len(reached) >= cap:
                    cut = True
                else:
                    reached[t] = (d + 1, [*path, e], min(c, k))
                    queue.append(t)
    return reached, cut


@pytest.mark.parametrize("cap", [700, 1_000_000])
def test_traversal_of_many_nodes(spark, cap):
    """Levels of thousands of nodes and a hub with a third of all edges; the cap falls into a level."""
    rng = random.Random(4)
    nodes = [(f"n{i:05d}", "FUNCTION" if i == 7 else rng.choice(["FUNCTION", "CLASS", "ENDPOINT", "TEST"]), f"k{i}", rng.randint(5, 10) / 10, i % 97 == 0) for i in range(4_000)]
    pairs = {(f"n{rng.randrange(4_000):05d}", f"n{7 if rng.random() < 0.33 else rng.randrange(4_000):05d}", rng.choice(["CALLS", *graph.OUT_STEPS, "VALIDATED_BY"])) for _ in range(9_000)}
    edges = [(*e, rng.randint(5, 10) / 10) for e in sorted(pairs)]
    want, cut = plain_queue(nodes, edges, 3, cap)
    got, notes = graph.traverse(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), 3, cap)
    assert {r["id"]: (r["distance"], list(r["edge_path"]), r["confidence"]) for r in got.collect()} == want
    assert ("traversal_node_limit" in notes) == cut and len(want) > 600


# ------------------------------------------------------------- intervals


def test_owners_of_lines_equal_plain(spark):
    rng = random.Random(3)
    scopes = []
    for f in "ab":
        for i in range(12):
            first = rng.randrange(1, 200)
            scopes.append((f, f"s{i}", first, first + rng.choice([0, 3, 40, -2, 120]), i))
    cuts = [(rng.choice("abc"), rng.randrange(1, 260), rng.randrange(0, 9)) for _ in range(40)]
    want = {}
    for f, start, n in cuts:
        for line in range(start, start + n):
            inside = [(d, s) for g, s, a, b, d in scopes if g == f and a <= line <= b]
            if inside:
                want[f, line] = max(inside)[1]
    got = graph.owners_of_lines(spark.createDataFrame(cuts, "file string, start int, count int"), spark.createDataFrame(scopes, "file string, symbol string, first int, last int, depth int"))
    assert {(r["file"], r["line"]): r["symbol"] for r in got.collect()} == want


def test_long_scopes_are_few_rows(spark):
    s = spark.createDataFrame([(1, 10_000_000), (17, 1 << 30), (5, 5), (9, 8)], "first long, last long")
    sizes = {r["first"]: r["x"] for r in s.select("first", graph._segments(F.col("first"), F.col("last")).alias("x")).collect()}
    assert all(len(x) <= 64 for x in sizes.values()) and len(sizes[5]) == 1 and sizes[9] == []
    assert sum(1 << x["level"] for x in sizes[1]) == 10_000_000
    far = graph.owners_of_lines(spark.createDataFrame([("f", 9_999_999, 3)], "file string, start long, count long"), spark.createDataFrame([("f", "m", 1, 10_000_000, 0)], "file string, symbol string, first long, last long, depth int"))
    assert sorted(r["line"] for r in far.collect()) == [9_999_999, 10_000_000]


# ------------------------------------------------------------- budgets


def plain_greedy(rows, budget):
    """Limits exceeded by each entry of a fold in order."""
    out = {}
    for g in {r[0] for r in rows}:
        used, n, files = [0] * len(budget.costs), 0, set()
        for _, o, k, f, *costs in sorted(r for r in rows if r[0] == g):
            over = [budget.files[2]] if budget.files and len(files | {f}) > budget.files[1] else []
            over += [name for (_, limit, name), u, c in zip(budget.costs, used, costs) if u + c > limit]
            over += [budget.count[1]] if budget.count and n >= budget.count[0] else []
            if not over:
                n, files, used = n + 1, files | {f}, [u + c for u, c in zip(used, costs)]
            out[g, o, k] = over
    return out


BUDGETS = [planning.Budget((("x", 100, "X"),)), planning.Budget((("x", 200, "X"), ("y", 150, "Y")), files=("f", 2, "F")), planning.Budget((("x", 50, "X"),), (8, "N"))]


@pytest.mark.parametrize("seed,budget", list(enumerate(BUDGETS)))
def test_rounds_choose_as_the_fold_does(spark, monkeypatch, seed, budget):
    rng = random.Random(seed)
    rows = [(rng.choice("aab"), rng.randrange(50), i, rng.choice("pqrst"), rng.choice([0, 1, 3, 7, rng.randrange(60)]), rng.randrange(40)) for i in range(300)]
    df, want = spark.createDataFrame(rows, "g string, o long, k long, f string, x long, y long"), plain_greedy(rows, budget)
    for fold in (10**6, 150):  # all groups folded; the larger one in rounds
        monkeypatch.setattr(planning, "FOLD_ENTRIES", fold)
        assert {(r["g"], r["o"], r["k"]): r["exceeded"] for r in planning.greedy(df, "g", ["o", "k"], budget).collect()} == want


def test_rounds_grow_with_the_logarithm_of_the_budget(spark, monkeypatch):
    """Each small entry is followed by one that is as large as what was left before it: a round for each would be 60."""
    rows, left = [], 60
    for i in range(60):
        rows += [("g", 2 * i, 1), ("g", 2 * i + 1, left)]
        left -= 1
    calls = []
    monkeypatch.setattr(planning, "FOLD_ENTRIES", 1)
    sums = planning.prefix_sums
    monkeypatch.setattr(planning, "prefix_sums", lambda *a: calls.append(1) or sums(*a))
    out = planning.greedy(spark.createDataFrame(rows, "g string, o long, x long"), "g", ["o"], planning.Budget((("x", 60, "X"),)))
    assert out.where("size(exceeded) = 0").count() == 60 and len(calls) <= 8


# ------------------------------------------------------------- journals and state machines


def test_long_journal_is_linear(spark):
    def seconds(n):
        t = time.time()
        j = release.chain(spark.range(n).select(F.lit("r").alias("rel"), F.col("id").alias("seq"), F.col("id").cast("string").alias("body")), "rel", "seq", "body")
        last = j.orderBy(F.desc("sequence")).first()["record_hash"]
        return time.time() - t, last

    seconds(1_000)
    small, _ = seconds(20_000)
    large, last = seconds(200_000)
    h = ""
    for i in range(200_000):
        h = hashlib.sha256(f"{h}\x1f{i}".encode()).hexdigest()
    assert last == h and large < 20 * small + 5


def test_chain_of_null_and_equal_records(spark):
    j = release.chain(spark.createDataFrame([(None, 0, None), (None, 1, "a"), ("x", 0, "a"), ("x", 0, "a")], "rel string, seq long, body string"), "rel", "seq", "body")
    got = {(r["rel"], r["previous_hash"], r["record_hash"]) for r in j.collect()}
    first, second = hashlib.sha256(b"\x1f").hexdigest(), hashlib.sha256(b"\x1fa").hexdigest()
    assert (None, "", first) in got and (None, first, hashlib.sha256(f"{first}\x1fa".encode()).hexdigest()) in got
    assert ("x", "", second) in got and ("x", second, hashlib.sha256(f"{second}\x1fa".encode()).hexdigest()) in got
    assert {r["rel"]: r["fault"] for r in release.verify_chain(j, "rel").collect()} == {None: None, "x": "sequence has a gap"}


def test_replay_of_long_runs_is_composed(spark, monkeypatch):
    """Runs far longer than a block give the state of a plain fold."""
    monkeypatch.setattr(history, "COMPOSED", 8)
    rng = random.Random(5)
    rows, want = [], {}
    for run in range(6):
        state = history.Stage()
        for i in range(400 if run < 2 else rng.randrange(1, 20)):
            o = rng.choices(["ok", "failed", "declined", "duplicate_patch", None], [94, 4, 1, 0.5, 0.5])[0]
            rows.append((run, i, o))
            state = state.after(o or "failed", 50)
        want[run] = (state.stage, state.attempts, state.reason)
    df = spark.createDataFrame(rows, "run int, i int, outcome string")
    assert {r["run"]: (r["stage"], r["attempts"], r["reason"]) for r in history.replay(df, "run", "i", 50).collect()} == want


def test_transitions_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i, rng.choice(["queued", "running", "succeeded"])) for i in range(300)]
    last, want = {}, set()
    for k, i, s in rows:
        b = last.get(k)
        if b and b != s and (b, s) not in history.TRANSITIONS:
            want.add((k, i, b, s))
        last[k] = s
    got = history.transition_faults(spark, spark.createDataFrame(rows, "k string, i long, status string").repartition(5), "k", "i")
    assert {(r["k"], r["i"], r["before"], r["status"]) for r in got.collect()} == want


def test_lifecycle_ends_at_the_first_decision(spark):
    rows = [("a", 1, "pause"), ("a", 2, "promote"), ("a", 3, "rollback"), ("b", 1, "pause"), (None, 1, "rollback"), (None, 2, "pause")]
    got = release.lifecycle(spark.createDataFrame(rows, "r string, o long, action string"), "r", "o")
    assert {(r["r"], r["o"]) for r in got.collect()} == {("a", 1), ("a", 2), ("b", 1), (None, 1)}


# ------------------------------------------------------------- ownership


@pytest.mark.parametrize("seed", range(3))
def test_ownership_equals_plain(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab/.") for _ in range(n))
    known = [word(rng.choice([1, 2, 3, 5, 8, 13, 20])) for _ in range(12)] if seed else [word(7) for _ in range(40)] + ["src/é"]
    paths = [word(rng.randrange(0, 30)) for _ in range(120)] + ["src/é.py", None, "", *known] + ["hot/path"] * 90
    got = artifacts.ownership_signal(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(k,) for k in [*known, None]], "pattern string"), "path").collect()
    assert len(got) == len(paths)
    for r in got:
        assert r["owned"] == (r["path"] is not None and any(k in r["path"] for k in known))


def test_ownership_without_patterns_and_with_an_empty_one(spark):
    paths = spark.createDataFrame([("a",), (None,)], "path string")
    none, empty = spark.createDataFrame([], "pattern string"), spark.createDataFrame([("",)], "pattern string")
    assert {r["path"]: r["owned"] for r in artifacts.ownership_signal(paths, none, "path").collect()} == {"a": False, None: False}
    assert {r["path"]: r["owned"] for r in artifacts.ownership_signal(paths, empty, "path").collect()} == {"a": True, None: False}


def test_many_patterns_with_one_head(spark):
    """Patterns that begin alike do not multiply the paths that begin so."""
    patterns = spark.range(20_000).select(F.concat(F.lit("src/app/module"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("pattern"))
    paths = spark.range(3_000).select(F.concat(F.lit("src/app/module"), F.lpad((F.col("id") * 11).cast("string"), 6, "0"), F.lit(".py")).alias("path"))
    assert artifacts.ownership_signal(paths, patterns, "path").where("owned").count() == len([i for i in range(3_000) if i * 11 < 20_000])


# ------------------------------------------------------------- objects


def test_listing_equals_a_stored_tree(spark, tmp_path, monkeypatch):
    """Ids equal those that the version control tool itself gives to the same files."""
    monkeypatch.setattr(objects, "_JOINED", 3)
    rng = random.Random(1)
    files = {f"{d}{n}": "".join(rng.choice("xyz\n") for _ in range(rng.randrange(30))) for d in ("", "a/", "a.b/", "a/b/", "ab/c/d/") for n in ("one.py", "b.txt", "é.md", "zz")}
    root = tmp_path / "r"
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "a" / "one.py").chmod(0o755)
    run = lambda *a: subprocess.run(["git", "-c", "core.quotepath=off", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True).stdout
    run("init", "-q")
    run("add", ".")
    top = run("write-tree").decode().strip()
    want = {tuple(line.split(None, 2)) + (path,) for line, _, path in (x.partition("\t") for x in run("ls-tree", "-r", "-t", "-z", top).decode().split("\0") if x)} | {("040000", "tree", top, "")}
    df = spark.createDataFrame([("100755" if p == "a/one.py" else "100644", p, t.encode()) for p, t in files.items()] + [("100644", None, b"x")], "mode string, path string, content binary")
    assert {tuple(r) for r in objects.listing(df, mode="mode").collect()} == want


def test_listing_of_nothing_and_of_repeats(spark):
    schema = "path string, content binary"
    assert objects.listing(spark.createDataFrame([], schema)).count() == 0
    got = objects.listing(spark.createDataFrame([("a", b"1"), ("a", b"1"), ("b", None)], schema)).collect()
    assert sorted(r["path"] for r in got) == ["", "a", "b"] and next(r["oid"] for r in got if r["path"] == "b") == hashlib.sha1(b"blob 0\0").hexdigest()


def test_blobs_of_mixed_encodings(spark):
    cases = {
        "a": (b"x = 1\r\ny = 2\n", "utf-8", "x = 1\ny = 2\n"), "b": (b"\xef\xbb\xbfhi", "utf-8-sig", "hi"), "c": ("# -*- coding: latin-1 -*-\né".encode("latin-1"), "iso-8859-1", "# -*- coding: latin-1 -*-\né"),
        "d": ("#!/bin/sh\n# vim: set fileencoding=cp1252 :\n€".encode("cp1252"), "cp1252", "#!/bin/sh\n# vim: set fileencoding=cp1252 :\n€"), "e": (b"", "utf-8", ""), "f": (None, "utf-8", ""),
        "g": (b"\xff\xfe", None, None), "h": (b"# coding: nothing\n", None, None), "i": (b"ok\nok\nok\n\xff", None, None), "j": (b"\xef\xbb\xbf# coding: latin-1\n", None, None),
    }
    got = {r["path"]: r for r in objects.read_blobs(spark.createDataFrame([("r", p, c) for p, (c, *_) in cases.items()], "repo string, path string, content binary"), "repo").collect()}
    for p, (content, encoding, text) in cases.items():
        assert (got[p]["encoding"], got[p]["source"]) == (encoding, text) and got[p]["size"] == len(content or b"")
        assert got[p]["code"] == (None if encoding else "source_encoding_error")


def test_blob_limits_skip_and_go_on(spark):
    files = [("r", "a", b"x" * 60), ("r", "b", b"x" * 200), ("r", "c", b"\xff" * 30), ("r", "d", b"x" * 30), ("r", "e", b"x" * 10), (None, "a", b"y")]
    got = {(r["repository"], r["path"]): r["code"] for r in objects.read_blobs(spark.createDataFrame(files, "repo string, path string, content binary"), "repo", max_blob=100, max_total=100).collect()}
    assert got == {("r", "a"): None, ("r", "b"): "blob_size_limit", ("r", "c"): "source_encoding_error", ("r", "d"): "total_size_limit", ("r", "e"): None, (None, "a"): None}


# ------------------------------------------------------------- journals of several writers


RECORD, KEYS = "release_id string, sequence long, body string", ["release_id", "sequence"]


def test_journal_takes_one_record_a_key(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), RECORD, KEYS)
    assert j.read().count() == 0 and j.version() == 0
    assert j.append(spark.createDataFrame([("r", 0, "a"), ("r", 1, "b"), ("r", 1, "a2"), (None, None, None)], RECORD)) == 1
    second = spark.createDataFrame([("r", 1, "forged"), ("r", 2, "c"), (None, None, "x"), ("r", 0, "a")], RECORD)
    assert {r["body"] for r in j.conflicts(second).collect()} == {"forged", "x"}
    assert j.append(second) == 2
    assert {tuple(r) for r in j.read().collect()} == {("r", 0, "a"), ("r", 1, "a2"), (None, None, None), ("r", 2, "c")}
    assert j.read(1).count() == 3


def test_a_writer_that_loses_looks_again(spark, tmp_path, monkeypatch):
    """Another writer commits between a writer's look and its commit; no key gets two records."""
    one, two = (Journal(spark, str(tmp_path / "j"), RECORD, KEYS) for _ in range(2))
    take, tries = Journal._take, []

    def slow(self, version, parts):
        if self is one and not tries:
            two.append(spark.createDataFrame([("r", 0, "two"), ("r", 5, "two")], RECORD))
        tries.append(version) if self is one else None
        return take(self, version, parts)

    monkeypatch.setattr(Journal, "_take", slow)
    assert one.append(spark.createDataFrame([("r", 0, "one"), ("r", 1, "one")], RECORD)) == 2 and tries == [1, 2]
    assert {(r["sequence"], r["body"]) for r in one.read().collect()} == {(0, "two"), (5, "two"), (1, "one")}


def test_writers_in_threads_and_a_failed_task(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), RECORD, KEYS)
    batches = [spark.range(20).select(F.lit("r").alias("release_id"), (F.col("id") + 5 * w).alias("sequence"), F.lit(f"w{w}").alias("body")) for w in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = sorted(pool.map(lambda df: Journal(spark, j.path, RECORD, KEYS).append(df), batches))
    assert versions == [1, 2, 3, 4]
    rows = j.read().collect()
    assert len(rows) == len({r["sequence"] for r in rows}) == 35
    broken = batches[0].withColumn("body", F.when(F.col("sequence") > 3, F.raise_error(F.lit("lost"))).otherwise("x")).withColumn("sequence", F.col("sequence") + 100)
    with pytest.raises(Exception, match="lost"):
        j.append(broken)
    assert j.version() == 4 and j.read().count() == 35


# ------------------------------------------------------------- state of streams


def event_files(spark, path, *batches):
    """One file a batch, read in this order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "run_id string, event_id long, s long").select("run_id", "event_id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1 if i < len(batches) - 1 else 0)  # files are taken by their time
    return spark.readStream.schema("run_id string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))


def open_runs(spark, checkpoint):
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(checkpoint))
    return {r["k"] for r in state.select(F.col("key.run_id").alias("k")).collect()}


def test_cap_counts_across_batches_and_state_is_dropped(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    day = 86_400
    first = [("a", i, i) for i in range(6)] + [("b", 10 + i, 50 - i) for i in range(3)]
    second = [("a", 20 + i, 100 + i) for i in range(6)]
    third = [("c", 40, 30 * day)]
    fourth = [("a", 50, 30 * day + 5), ("c", 51, 30 * day + 9)]
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    got = state.drained(state.capped(event_files(spark, tmp_path / "in", first, second, third), 8, "0 seconds", day * 1000), at, out)
    recorded = {r["event_id"]: r["recorded"] for r in got.collect()}
    assert [recorded[i] for i in range(6)] == ["ok"] * 6 and [recorded[20 + i] for i in range(6)] == ["ok"] * 2 + ["limited"] * 4
    assert len(recorded) == 16 and open_runs(spark, at) == {"c"}  # silent runs have left
    got = state.drained(state.capped(event_files(spark, tmp_path / "in", fourth), 8, "0 seconds", day * 1000), at, out)
    assert {r["event_id"]: r["recorded"] for r in got.collect()}[50] == "ok" and open_runs(spark, at) == {"a", "c"}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_streamed_lifecycle_ends_in_a_later_batch(spark, tmp_path):
    def observed(stream):
        return stream.withColumn("action", F.when(F.col("event_id") % 10 == 3, "rollback").otherwise("pause")).withColumnRenamed("run_id", "release_id")

    files = event_files(spark, tmp_path / "in", [("a", 1, 1), ("b", 2, 1)], [("a", 3, 5), ("a", 4, 6), ("b", 5, 7)], [("a", 6, 9), ("b", 13, 9), ("b", 14, 8)])
    got = state.drained(state.lifecycle(observed(files), "0 seconds"), str(tmp_path / "c"), str(tmp_path / "o"))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 5, 13, 14]


# ------------------------------------------------------------- contracts


def test_contracts_name_every_fault(spark):
    rule = contracts.Rule
    contract = {"a": rule(values=("x", "1")), "n": rule(low=0, high=1), "o": rule(optional=True, low=5), "d": rule(fields={"e": rule(), "f": rule(fields={"g": rule(values=("k",))}, optional=True)})}
    cases = {
        '{"a":"x","n":0.5,"d":{"e":1}}': [], '{"a":"1","n":1,"o":null,"d":{"e":"","f":{"g":"k"}}}': [], '{"a":"y","n":2,"o":1,"d":{"e":null}}': ["a:enum", "n:range", "o:range", "d.e:null"],
        '{"n":"many","d":{}}': ["a:missing", "n:type", "d.e:missing"], '{"a":null,"n":null,"d":null}': ["a:null", "n:null", "d:null"], '{"a":"x","n":0,"d":[1]}': ["d:type"], '{"a":"x","n":"NaN","d":{"e":1}}': ["n:type"],
        '{"a":"x","n":0,"d":{"e":1,"f":{"g":"z","h":0},"q":1},"z":1}': ["d.f.g:enum", "d.f.h:unknown", "d.q:unknown", "z:unknown"], "no json": ["$:type"], "[]": ["$:type"], None: ["$:type"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "record string")
    good, bad = contracts.quarantine(df, "record", contract)
    assert {r["record"]: r["violations"] for r in bad.collect()} == {k: v for k, v in cases.items() if v}
    assert {r["record"] for r in good.collect()} == {k for k, v in cases.items() if not v}


def test_criteria_meet_evidence_by_pattern_and_only_for_given_pairs(spark, monkeypatch):
    """Many workloads of one pattern and many runs of one fact are one comparison; pairs limit the result."""
    criteria = spark.range(300).selectExpr("id AS workload_id", "cast(id % 2 AS int) AS ord", "'test' AS source", "concat('case', id % 2) AS value", "'prefix' AS match")
    evidence = spark.range(200).selectExpr("id AS run_id", "'test' AS source", "concat('case', id % 2, '_x') AS value")
    compared = []
    monkeypatch.setattr(planning, "settled", lambda df: compared.append(df) or tables.settled(df))
    full = {tuple(r) for r in planning.first_match(criteria, evidence).collect()}
    assert full == {(r, w, "test", f"case{w % 2}_x") for r in range(200) for w in range(300) if r % 2 == w % 2}
    assert compared[0].count() == 200  # one row for each run and pattern
    pairs = spark.range(300).selectExpr("id % 200 AS run_id", "id AS workload_id")
    assert {tuple(r) for r in planning.first_match(criteria, evidence, pairs).collect()} == {x for x in full if x[0] == x[1] % 200}


def test_distances_to_bound_make_steps_and_levels_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph_queries, "settled", lambda df: made.append(df) or tables.settled(df))
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in graph_queries.a01_bound(spark, sf).collect()}
    assert len(made) == 4  # the steps, and a level for each of three
    nodes, edges = graph_queries.p.nodes(spark, sf), graph_queries.p.edges(spark, sf)
    ways = {}
    for r in graph.steps(nodes, edges).select("src", "dst").collect():
        ways.setdefault(r["src"], set()).add(r["dst"])
    far = {r["id"]: 0 for r in nodes.where("changed").collect()}
    front = set(far)
    for d in (1, 2, 3):
        front = {x for at in front for x in ways.get(at, ())} - far.keys()
        far |= dict.fromkeys(front, d)
    assert far and got == set(far.items())
