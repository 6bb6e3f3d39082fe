"""Queries of the corpus operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, table
from . import centroids, decontaminate, fingerprints, htmlextract, langid, mixing, prefixtrie, quality, qualityrules, secrets, sketchjoin, suffixdedup, urlfilter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; the package is shipped before its first Python stage."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SHINGLES = f"""w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)"""


@query(
    "op8_jaccard_join",
    f"""WITH RECURSIVE {_SHINGLES},
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id FROM documents d
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
LEFT JOIN size ON size.doc_id = d.doc_id""",
)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketchjoin.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query("op1_suffix_dedup")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(table(spark, sf_dir, "documents"))
    text = suffixdedup.kept_text("kept")
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


@query("op5_fingerprints")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_quality")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), quality.is_held_out("id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def _lang_held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op6_language")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, held_out=_lang_held_out("doc_id")))
    return found.select(F.col("id").alias("doc_id"), _lang_held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op7_mixing",
    r"""WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS place FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM src),
lev AS (SELECT *, (total::DOUBLE * 150.0::DOUBLE / 100.0::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY cap::DOUBLE / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
water AS (SELECT arg_min(level, struct_pack(r := cap::DOUBLE / w, s := sid)) AS water FROM lev WHERE cap::DOUBLE / w >= level),
tgt AS (SELECT source, sid, source_size, least(cap::DOUBLE, coalesce(water * w, cap::DOUBLE)) AS target FROM lev, water),
k AS (SELECT d.*, t.sid, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2) ELSE 0 END::BIGINT AS epochs
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
run AS (SELECT *, target - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY sid ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM k)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN upto + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM run""",
)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query(
    "op9_decontamination",
    f"""WITH {_SHINGLES},
bw AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, sh FROM (SELECT item_id, unnest(CASE WHEN len(ws) >= 5
    THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) ELSE [] END) AS sh FROM bw)),
bn AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
hit AS (SELECT sh.doc_id, bs.item_id, count(*) AS n_found FROM sh JOIN bs ON sh.sh = bs.sh GROUP BY 1, 2),
short AS (SELECT item_id, ' ' || array_to_string(ws, ' ') || ' ' AS s FROM bw WHERE len(ws) BETWEEN 1 AND 4)
SELECT doc_id, hit.item_id, n_item, n_found, n_found::DOUBLE / n_item AS containment
FROM hit JOIN bn ON bn.item_id = hit.item_id WHERE 100 * n_found >= 80 * n_item
UNION ALL SELECT doc_id, item_id, 1::BIGINT, 1::BIGINT, 1::DOUBLE FROM w JOIN short ON contains(' ' || array_to_string(ws, ' ') || ' ', s)""",
)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


_LISTED = ", ".join(f"('{n.partition('/')[0]}', '/{n.partition('/')[2]}')" for n in urlfilter.LISTED)


@query(
    "op10_url_filter",
    rf"""WITH u AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(what, h, p) AS (VALUES {", ".join(str(r) for r in urlfilter.RULES)}),
fit AS (SELECT page_id, url, host, path, arg_max(h || p, len(h || p)) AS rule, arg_max(what, len(h || p)) AS what FROM u
    JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
listed(h, p) AS (VALUES {_LISTED})
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.what, CASE WHEN EXISTS (SELECT 1 FROM listed
    WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(CASE u.path WHEN '' THEN '/' ELSE u.path END, p)) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN (SELECT DISTINCT page_id, url, rule, what FROM fit) f ON f.page_id = u.page_id AND f.url = u.url""",
)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.default_list(spark))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op2_secrets")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents")).where("is_secret")
    return found.select(F.col("id").alias("doc_id"), "kind", "start", "end", "secret", "score")


@query("op3_main_text")
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlextract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


# CRC-32 of a decimal, bit by bit; DuckDB has no function of it.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""


@query(
    "op12_prefix_trie",
    f"""WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
cut AS (SELECT conv_id, ts, ({_CRC} % 9)::INT AS h FROM own),
whole AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, h), []), list_slice(c.ts, h + 1, len(c.ts))) AS ts FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
pre AS (SELECT conv_id, d, list_slice(ts, 1, d) AS p, d = len(ts) AS is_end FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM whole)),
node AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(p)[d].t) END AS own_saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM pre GROUP BY p, d),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.p = node.p),
up AS (SELECT list_slice(p, 1, a) AS p, n_children, own_saved FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_node)),
sums AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_node f JOIN sums s ON s.p = f.p LEFT JOIN full_node q ON f.depth > 0 AND q.p = list_slice(f.p, 1, f.depth - 1)""",
)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sizes = prefixtrie.numbered(table(spark, sf_dir, "conversations"))
    return prefixtrie.prefix_trie(*prefixtrie.rebuilt(rows, sizes))


def _lloyd_sql(rounds: int) -> str:
    """CTEs of all rounds: near0 to near<rounds> are assignments, c0 to c<rounds> centroids."""
    apart = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = []
    for i in range(rounds + 1):
        parts.append(f"near{i} AS (SELECT vid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(n, (d, n)) AS cluster, min(d) AS distance FROM (SELECT v.vid, v.vec_id, v.v, c.n, {apart} AS d FROM vecs v, c{i} c) GROUP BY vid)")
        if i < rounds:
            parts.append(f"""sum{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM near{i}) GROUP BY 1, 2),
c{i + 1} AS (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT cluster, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS v FROM sum{i} GROUP BY 1) m ON m.cluster = c.n)""")
    return ",\n".join(parts)


@query(
    "op13_centroids",
    f"""WITH vecs AS (SELECT row_number() OVER () AS vid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR)) - 1 AS n, v FROM vecs ORDER BY sha256('1:' || vec_id::VARCHAR) LIMIT 16),
{_lloyd_sql(3)},
of AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM near3 GROUP BY 1)
SELECT vec_id, near3.cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM near3) AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM near3 JOIN of ON of.cluster = near3.cluster JOIN c3 ON c3.n = near3.cluster""",
)
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _em_sql(rounds: int) -> str:
    """CTEs of all rounds: m0 to m<rounds> are models (state, share, rates), e<i> the weighted patterns."""
    n = len(qualityrules.RULES)
    q = qualityrules
    first = " UNION ALL ".join(f"SELECT {k} AS state, {share!r}::DOUBLE AS share, {rates!r}::DOUBLE[] AS rates" for k, (share, rates) in enumerate(zip(q.start(n).shares, q.start(n).bad_rates, strict=True)))
    parts = [f"m0 AS ({first})"]
    for i in range(rounds + 1):
        parts.append(f"""l{i} AS (SELECT v, n, state, ln(share) + list_sum(list_transform(v, lambda x, k: CASE WHEN x < 0 THEN ln(rates[k]) WHEN x > 0 THEN ln(1 - rates[k]) ELSE 0 END)) AS l FROM pattern, m{i}),
x{i} AS (SELECT *, exp(l - max(l) OVER (PARTITION BY v)) AS w FROM l{i}), e{i} AS (SELECT *, w / sum(w) OVER (PARTITION BY v) AS p FROM x{i})""")
        if i < rounds:
            bound = f"least(greatest((bad + {q.WEIGHT} * m0.rates[rule]) / (bad + good + {q.WEIGHT}), CASE WHEN c.state = rule THEN {q.LEAST_RIGHT} ELSE {q.LOW} END), CASE WHEN c.state = 0 THEN {q.MOST_WRONG} ELSE {q.HIGH} END)"
            parts.append(f"""c{i} AS (SELECT state, rule, coalesce(sum(z) FILTER (vote < 0), 0) AS bad, coalesce(sum(z) FILTER (vote > 0), 0) AS good, sum(z) AS all_of
  FROM (SELECT state, n * p AS z, unnest(v) AS vote, unnest(range(1, {n + 1})) AS rule FROM e{i}) GROUP BY 1, 2),
s{i} AS (SELECT c.state, any_value(all_of) FILTER (rule = 1) + {q.WEIGHT} * any_value(m0.share) AS mass, list({bound} ORDER BY rule) AS rates FROM c{i} c JOIN m0 ON m0.state = c.state GROUP BY 1),
m{i + 1} AS (SELECT state, mass / sum(mass) OVER () AS share, rates FROM s{i})""")
    return ",\n".join(parts)


_VOTES = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in qualityrules.RULES)


@query(
    "op11_quality_rules",
    rf"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM documents),
run AS (SELECT k, i, count(*) OVER (PARTITION BY k, r) AS c FROM (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS r FROM t)),
rep AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM run WHERE c > 1) GROUP BY k),
cnt AS (SELECT t.k, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;"][ 	-
]*$'))) AS n_closed_lines,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_lettered_words, len(list_distinct(w)) AS n_distinct_words, len(regexp_extract_all(t, '\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(t, '[0-9]')) AS n_digits FROM t LEFT JOIN rep ON rep.k = t.k),
voted AS (SELECT *, [{_VOTES}] AS v FROM cnt), pattern AS (SELECT v, count(*) AS n FROM voted GROUP BY 1),
{_em_sql(qualityrules.ROUNDS)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND p >= 0.5 AS kept
FROM voted JOIN e{qualityrules.ROUNDS} e ON e.v = voted.v AND e.state = 0""",
)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = qualityrules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
