"""Operator 10: URL filtering by a blocked Bloom filter before an exact hash join.

Every URL stands for lookup names, its host and each parent domain with each
leading part of its path, as far as the list has names of so many labels and
slashes.  The listed canonical names make a blocked Bloom filter, sized by
their number: one 64-bit block by one hash, five bits in it by another.  Names whose
bits are all set pass to an exact join with the list, which takes false
positives out; the others never reach a shuffle.  A filter of at most
``MOST_BLOCKS`` rows is broadcast, a larger one is a table that the distinct
names are joined with by block.  A name that many pages share is matched once
and handed back to its pages without a shuffle of them.  Rules (host, path) override the list, the longest first.  Only built-in
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

#: Bound of a broadcast filter: rows of 12 bytes.
MOST_BLOCKS = 1 << 16
NAMES_PER_BLOCK, BITS_SET = 6, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the query: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Sites that only serve spam, bets or adult pages, and the domains of the driver's pages. A site's domain differs from
#: one table to the next, so the query lists every site under every domain.
SITES = ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
#: Folders that only lead to adverts and counters, on any site of these domains.
FOLDERS = ("ads", "click", "redirect/out", "track")
#: Listed canonical names of the query: sites with all they hold, and folders.
LISTED = tuple(f"{site}.{domain}/" for site in SITES for domain in DOMAINS) + tuple(f"{domain}/{folder}/" for folder in FOLDERS for domain in DOMAINS)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _times(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def lookup_names(host: Column, path: Column, labels: Sequence[int], slashes: Sequence[int]) -> Column:
    """The (parent domain, leading path) names of a URL that have one of the numbers of labels and slashes.

    A leading path is the whole path or ends with a slash; an empty path has the
    leading path / too.  None for an empty host.
    """
    dots, whole = _times(host, "."), F.when(path == "", F.lit("/")).otherwise(path)
    steps = _times(whole, "/")
    domains = F.array(*[F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in labels])
    folders = [F.when(steps >= n, F.concat(F.substring_index(whole, "/", n), F.lit("/"))) for n in slashes if n]
    paths = F.array(F.when(_times(path, "/").isin(*slashes), path), *folders)
    names = F.flatten(F.transform(F.array_compact(domains), lambda d: F.transform(F.array_compact(paths), lambda p: F.concat(d, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(names))


def _block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(blocks))


def _bits(name: Column) -> Column:
    h = F.xxhash64(name, F.lit(0x5BD1))
    out = F.lit(0).cast("long")
    for i in range(BITS_SET):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_table(listed: DataFrame, name_col: str, blocks: int) -> DataFrame:
    """(block, mask): the blocked Bloom filter of the listed names."""
    name = F.col(name_col)
    return listed.where(name.isNotNull()).groupBy(_block(name, blocks).alias("block")).agg(F.bit_or(_bits(name)).alias("mask"))


def listed_urls(pages: DataFrame, listed: DataFrame, host: str = "host", path: str = "path", name_col: str = "name") -> DataFrame:
    """The distinct (host, path) of pages that the list names, exactly."""
    site = F.substring_index(name_col, "/", 1)
    shape = listed.where(F.col(name_col).isNotNull()).agg(F.count(F.lit(1)).alias("c"), F.collect_set(_times(site, ".") + 1).alias("labels"), F.collect_set(_times(F.col(name_col), "/")).alias("slashes")).first()
    blocks = max(1, -(-shape["c"] // NAMES_PER_BLOCK))
    lookups = lookup_names(F.col("h"), F.col("p"), sorted(shape["labels"]) or [1], sorted(shape["slashes"]) or [0])
    sites = pages.select(F.col(host).alias("h"), F.col(path).alias("p"))
    filter_, exact = bloom_table(listed, name_col, blocks), listed.select(F.col(name_col).alias("name"))
    tested = lambda names, table: names.withColumn("block", _block(F.col("name"), blocks)).withColumn("bits", _bits(F.col("name"))).join(table, "block").where(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"))
    names = sites.withColumn("name", F.explode(lookups))
    if blocks <= MOST_BLOCKS:
        passed = frames.settled(tested(names, F.broadcast(filter_)).select("h", "p", "name").distinct())
        found = passed.groupBy("name").agg(F.count(F.lit(1)).alias("c"))
    else:
        # Each name is tested once, whatever the number of its pages.
        passed = frames.settled(names.distinct())
        found = tested(passed.groupBy("name").agg(F.count(F.lit(1)).alias("c")), filter_).select("name", "c")
    found = frames.settled(found.join(exact, "name", "left_semi"))
    return frames.lookup(passed, found, ["name"], "c", passed.count()).select("h", "p").distinct()


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", name_col: str = "name") -> DataFrame:
    """(id, url, host, path, rule, verdict) of every row.

    The longest fitting rule decides; else a URL is blocked where the list
    names its host, a parent domain or a leading part of its path, and allowed
    where not.  Null URLs and those without :// have empty host and path, fit no
    rule and are allowed.  Repeated rows each get a row; null ids are kept; an
    empty list blocks nothing.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    cut = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = cut.withColumn("rule", rule).withColumn("by_rule", verdict)
    hit = listed_urls(ruled.where("rule is null"), listed, name_col=name_col).withColumn("hit", F.lit(True))
    out = ruled.join(hit, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    final = F.coalesce("by_rule", F.when(F.col("rule").isNull() & F.col("hit"), F.lit("block")), F.lit("allow"))
    return out.select("id", "url", "host", "path", "rule", final.alias("verdict"))


def default_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in LISTED], "name string")
