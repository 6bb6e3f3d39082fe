"""Scalar functions of the engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"
# SQL text patterns that name tables read and written.
_TABLE = r"([A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*)?)"
READ_TABLES = rf"(?i)\b(?:FROM|JOIN)\s+{_TABLE}"
WRITE_TABLES = rf"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE(?:\s+IF\s+NOT\s+EXISTS)?|DROP\s+TABLE(?:\s+IF\s+EXISTS)?)\s+{_TABLE}"
HTTP_CALLS = r"http\.(?:delete|get|head|options|patch|post|put|trace)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"
BASE_URL = r"^\$\{[^{}]*\bBASE_URL\b[^{}]*\}"


def clamp(x: Column) -> Column:
    """x limited to [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def saturate(x: Column, full: float) -> Column:
    """Share of ``full``, 1 at most."""
    return F.least(x / F.lit(float(full)), F.lit(1.0))


def digest(x: Column, length: int = 64) -> Column:
    """First hex characters of the SHA-256 of a text."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, length)


def dedup_key(*fields: Column) -> Column:
    """SHA-256 over fields joined by the unit separator."""
    return digest(F.concat_ws(UNIT_SEPARATOR, *fields))


def sampled(key: Column, rate: float) -> Column:
    """Deterministic hash sampling: never at 0, always at 1."""
    if rate <= 0:
        return F.lit(False)
    if rate >= 1:
        return F.lit(True)
    return F.conv(digest(key, 8), 16, 10).cast("double") / F.lit(4294967295.0) < rate


def normalized_name(x: Column) -> Column:
    """Lower-cased, without anything but letters and digits."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def route_join(prefix: Column, route: Column) -> Column:
    """Prefix and route joined by exactly one slash."""
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", ""))


def read_tables(sql: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(READ_TABLES), 1), F.lower)))


def written_tables(sql: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(WRITE_TABLES), 1), F.lower)))


def http_paths(code: Column) -> Column:
    """Paths of literal URLs in HTTP calls, the base URL stripped; dynamic ones are left out."""
    urls = F.transform(F.regexp_extract_all(code, F.lit(HTTP_CALLS), 1), lambda u: F.trim(u))
    bare = F.transform(urls, lambda u: F.regexp_replace(F.regexp_replace(u, BASE_URL, ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))
    fixed = F.filter(bare, lambda u: u.startswith("/") & ~u.contains("${") & ~u.contains("}"))
    return F.transform(fixed, lambda u: F.regexp_extract(u, r"^([^?#]*)", 1))


def module_name(path: Column) -> Column:
    """Dotted module of a source path; each part percent-quoted, with dots quoted too."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), "/")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("."), F.lit("%2E"))), ".")


def relative_base(module: Column, level: Column, is_package: Column) -> Column:
    """Module that a relative import of the given level starts from."""
    parts = F.split(module, r"\.")
    keep = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")


def token_estimate(text: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4)).cast("long")


def used_tokens(total: Column, given: Column, made: Column) -> Column:
    """Total, else input plus output, else 0."""
    return F.coalesce(total, given + made, given, made, F.lit(0))


def reason_code(kind: Column, status: Column) -> Column:
    """Reason of a provider error by the name of its kind and its status code."""
    return (
        F.when((kind == "RateLimitError") | (status == 429), "rate_limit_or_quota_exhausted").when((kind == "AuthenticationError") | status.isin(401, 403), "invalid_api_key")
        .when(kind.isin("APITimeoutError", "TimeoutException", "ReadTimeout", "ConnectTimeout", "TimeoutError"), "provider_timeout")
        .when(kind.isin("APIConnectionError", "ConnectError", "NetworkError", "ConnectionError"), "network_failure").when(kind == "APIResponseValidationError", "response_schema_invalid")
        .otherwise(F.concat(F.lit("provider_error:"), kind))
    )


def local_path(uri: Column, root: str) -> Column:
    """Path of a file URI relative to a root; null outside it."""
    path = F.regexp_replace(uri, "^file://", "")
    return F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 1 << 30))


def present(**values: Column) -> Column:
    """Map of the values that are not null."""
    entries = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def publication_id(run: Column, patch: Column) -> Column:
    return F.concat(F.lit("pub-"), digest(F.concat(run, F.lit(":"), patch), 20))


def release_id(repository: Column, commit: Column) -> Column:
    return F.concat(F.lit("rel-"), digest(F.concat(repository, F.lit(":"), commit), 16))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; null fields are written."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def reason_path(edge_types: Column, distance: Column) -> Column:
    return F.format_string("reached at distance %d via %s", distance, F.array_join(edge_types, " -> "))


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def indentation(line: Column) -> Column:
    """Column of the first other character: a tab goes to the next multiple of 8, a form feed back to 0."""
    lead = F.regexp_extract(line, r"^([ \t\f]*)", 1)
    step = lambda n, c: F.when(c == "\t", n - n % 8 + 8).when(c == "\f", F.lit(0)).when(c == " ", n + 1).otherwise(n)
    return F.aggregate(F.split(lead, ""), F.lit(0), step)


def diff_text(path: Column, removed: Column, added: Column) -> Column:
    """Unified diff of one hunk at the first line: some lines out, others in."""
    mark = lambda sign, lines: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(sign), x, F.lit("\n"))), "")
    size = lambda lines: F.size(lines).cast("string")
    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path)
    return F.concat(head, F.lit("\n@@ -1,"), size(removed), F.lit(" +1,"), size(added), F.lit(" @@\n"), mark("-", removed), mark("+", added))
