"""Operators 11 to 13 against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwitness.llm import centroids, frames, prefixtrie, qualityrules, queries

from .test_operators import CLASH, DOCS, EDGE

# ------------------------------------------------------------------ 11


def plain_counts(text):
    """The counts of a text, one after the other."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_closed_lines": sum(bool(re.search(r'[.!?:;"][\x20\x09-\x0D]*\Z', x)) for x in lines), "n_lettered_words": sum(any(c.isalpha() for c in w) for w in words), "n_distinct_words": len(set(words)),
        "n_capitals": sum(c.isupper() for c in t), "n_digits": sum(c in "0123456789" for c in t),
    }


RULE_TEXTS = [
    None, "", " \n\t ", "a", "one two three", "x y z x y z", "a b a b a b a b", "same line.\nsame line.\n\nother line\n same line.", "a\tb\x0bc\x0cd\re\n", "# $ % | < > & * 12 34 É Ü ß é", "ends here.\r\nEnds here! \nnot here\n", "x y z " * 200,
    "Große Häuser 12 und | kleine & Dinge?", "  not a space here", "😀 😀 😀 😀 wide", "  lead and trail  ", "aaa bbb ccc ddd aaa bbb ccc eee",
]


def test_counts_equal_plain(spark):
    rng = random.Random(0)
    texts = RULE_TEXTS + ["".join(rng.choice(["a ", "b ", "c ", "dd ", ".\n", "#", "7", "É", "\n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    got = {r["id"]: r for r in qualityrules.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert {c: got[i][c] for c in qualityrules.COUNTS} == plain_counts(t), t


def plain_model(patterns, n_rules, rounds):
    """Shares and rates by plain loops over (votes, count); the weights of the states of each pattern."""
    q = qualityrules
    first = q.start(n_rules)
    shares, rates = list(first.shares), [list(r) for r in first.bad_rates]

    def weights(v):
        logs = [math.log(s) + sum(math.log(r[j]) if x < 0 else math.log(1 - r[j]) if x > 0 else 0.0 for j, x in enumerate(v)) for s, r in zip(shares, rates, strict=True)]
        w = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(w) for x in w]

    for _ in range(rounds):
        by = {v: weights(v) for v in patterns}
        new = []
        for k in range(n_rules + 1):
            row = []
            for j in range(n_rules):
                bad = sum(n * by[v][k] for v, n in patterns.items() if v[j] < 0)
                good = sum(n * by[v][k] for v, n in patterns.items() if v[j] > 0)
                rate = (bad + q.WEIGHT * first.bad_rates[k][j]) / (bad + good + q.WEIGHT)
                row.append(min(max(rate, q.LEAST_RIGHT if k == j + 1 else q.LOW), q.HIGH if k else q.MOST_WRONG))
            new.append(row)
        mass = [sum(n * by[v][k] for v, n in patterns.items()) + q.WEIGHT * first.shares[k] for k in range(n_rules + 1)]
        shares, rates = [m / sum(mass) for m in mass], new
    return {v: weights(v) for v in patterns}


def test_estimates_equal_plain(spark):
    rng = random.Random(1)
    votes = [tuple(rng.choices([1, 0, -1], [8, 2, 1])[0] for _ in range(4)) for _ in range(300)]
    df = spark.createDataFrame([(list(v),) for v in votes], "v array<int>")
    model = qualityrules.estimate(df, 4, 6)
    want = plain_model(Counter(votes), 4, 6)
    for r in df.distinct().withColumn("p", model.posterior("v")).collect():
        assert list(r["p"]) == pytest.approx(want[tuple(r["v"])], abs=1e-9)


def test_rules_find_faults_without_labels(spark):
    """Documents of three kinds of junk go, clean ones stay; no label is read."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8)))
    clean = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    docs = {i: clean(rng.randrange(6, 30)) for i in range(300)}
    junk = {300 + i: " ".join(word() + rng.choice("#$%&") * 3 for _ in range(120)) for i in range(20)} | {330 + i: "\n".join([clean(1)] * 4 + [clean(8)] + [clean(1)] * 3 + ["x y z."] * 9) for i in range(20)} | {360 + i: " | ".join(word() for _ in range(80)) for i in range(20)}
    got = {r["id"]: r["kept"] for r in qualityrules.judge(spark.createDataFrame(list((docs | junk).items()), "doc_id long, text string")).collect()}
    assert all(got[i] for i in docs) and not any(got[i] for i in junk)


def test_rules_edges(spark):
    edge = spark.createDataFrame(EDGE, DOCS).withColumns({c: F.lit("clash") for c in (*CLASH, "v", "t", "w", "h", "n_words", "p_good")})
    got = qualityrules.judge(edge).collect()
    assert len(got) == len(EDGE) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    same = [r for r in got if r["id"] == 1 and r["n_words"] == 14]
    assert len(same) == 2 and same[0]["p_good"] == same[1]["p_good"]
    empty = qualityrules.judge(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[0] == "id"


def test_a_very_long_text_is_counted_whole(spark):
    text = " ".join(f"w{i}" for i in range(300_000)) + " w1 w2 w3"
    r = qualityrules.counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"], r["n_distinct_words"]) == (300_003, 6, 300_000)


def test_rules_use_no_python(spark):
    plan = qualityrules.judge(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------------------------ 12


def plain_trie(rows):
    """Nodes of the rebuilt conversations by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "")[:64], (text or "")[:64], role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children, out = Counter(p[:-1] for p in members if p), []
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1].encode()) if p else 0)
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(whole[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def trie_of(df):
    return sorted((tuple(r) for r in prefixtrie.prefix_trie(*prefixtrie.rebuilt(*prefixtrie.numbered(df))).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_plain(spark, monkeypatch, seed):
    """Shared beginnings, copies, gaps, null and equal turns, negative ids; blocks and strings of a few rows."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    monkeypatch.setattr(prefixtrie, "CHUNK", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", "", None, "long " * 30]))
    opening = [say() for _ in range(12)]
    rows = []
    for c in [*range(-12, 45), 10**12, 10**12 + 3]:
        n = rng.randrange(0, 14)
        ts = opening[:n] if rng.random() < 0.5 else [say() for _ in range(n)]
        rows += [(c, rng.choice([i, i, i, None]) if rng.random() < 0.2 else i, *t) for i, t in enumerate(ts)]
    rows += [(7, None, "user", "a")] * 3 + [(None, 0, "user", "lost"), (3, 2, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in (*CLASH, "conv", "pos", "h", "o", "k1")})
    got = trie_of(df)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(rows)


def test_trie_of_a_deep_and_a_hot_conversation(spark, monkeypatch):
    """300 turns in one conversation and 200 copies of another: rounds by the logarithm of the depth, no node lost."""
    monkeypatch.setattr(prefixtrie, "BLOCK", 16)
    rows = [(5, i, "user", f"t{i % 7}") for i in range(300)] + [(1000 + 5 * c, i, "user", f"x{i}") for c in range(200) for i in range(4)]
    calls, settled = [], frames.settled
    monkeypatch.setattr(frames, "settled", lambda df: calls.append(1) or settled(df))
    got = trie_of(spark.createDataFrame(rows, TURNS))
    assert got == plain_trie(rows) and len(calls) < 30


def test_trie_edges(spark):
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    only_null = [(None, 1, "user", "a")]
    assert trie_of(spark.createDataFrame(only_null, TURNS)) == []
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in range(1, 400)}
    turnless = next(c for c in h if h[c] > 1 and c % 5)
    rows = [(turnless, 0, "user", "gone")]  # its only turn is replaced by those of an absent base
    assert trie_of(spark.createDataFrame(rows, TURNS)) == plain_trie(rows) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    long = [(10, 0, "user", "é" * 2_000_000), (10, 1, "user", "é" * 2_000_000 + "b"), (20, 0, "user", "é" * 2_000_000)]
    assert trie_of(spark.createDataFrame(long, TURNS)) == plain_trie(long)


# ------------------------------------------------------------------ 13


def plain_clusters(rows, k=16, rounds=3):
    """Lloyd over single vectors with Python's integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    total, by = sum(d for _, d, _ in found), Counter()
    for _, d, j in found:
        by[j] += d
    return sorted(((i, j, d, by[j], total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed,n", [(0, 200), (1, 9)])
def test_clusters_equal_plain(spark, seed, n):
    """A vector that a third of the rows have, ties, repeated and null ids, vectors of no use, few vectors."""
    rng = random.Random(seed)
    vec = lambda: [rng.choice([-1.0, -0.5, -0.015625, 0.0, 0.3, 2.25]) for _ in range(64)]
    hot = vec()
    rows = [(i, hot if i % 3 == 0 else vec(), None) for i in range(n)] + [(3, vec(), 1), (3, vec(), 1), (None, vec(), 0)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 63, 1), (903, [*[0.0] * 63, None], 1), (904, [*[0.0] * 63, float("nan")], 1), (905, [*[0.0] * 63, float("inf")], 1)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "v", "w", "cluster", "distance", "h")})
    got = sorted((tuple(r) for r in centroids.cluster(df).collect()), key=str)
    assert got == plain_clusters([(i, v) for i, v, _ in rows + bad])


def test_sums_beyond_64_bits_are_exact(spark):
    v = [100_000_000] * 64
    distinct = spark.createDataFrame([(v, 1 << 40), ([x - 1 for x in v], 1 << 40)], "v array<int>, w long")
    import numpy as np

    sums = {(r["cluster"], r["i"]): int(r["s"]) for r in centroids.weighted_sums(distinct, np.zeros((1, 64), np.int64)).collect()}
    assert sums[0, -1] == 1 << 41 and sums[0, 5] == (1 << 40) * (2 * 100_000_000 - 1)


def test_clusters_of_huge_values_and_of_nothing(spark):
    rows = [(1, [3e38] * 64, None), (2, [-3e38] * 64, None), (3, [0.0] * 64, None)]
    got = {r["id"]: (r["cluster"], r["distance"]) for r in centroids.cluster(spark.createDataFrame(rows, VECTORS), k=1).collect()}
    assert set(got) == {1, 2, 3} and all(d >= 0 for _, d in got.values())
    none = centroids.cluster(spark.createDataFrame([(1, None, None)], VECTORS))
    assert none.count() == 0 and none.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_new_queries_are_registered():
    assert {"op11_quality_rules", "op12_prefix_trie", "op13_centroids"} <= set(queries.ORACLE)
