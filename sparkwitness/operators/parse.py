"""Parsing stages: change records, diff hunks, Python sources, unified diffs.

Change records and hunks stay in built-in functions.  Source files and whole
diffs go through one Arrow stage each that emits facts; what follows from the
facts is DataFrame logic.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions.scalars import READ_TABLES, WRITE_TABLES

NUL = "\x00"
_RECORD = f"(?:[RC]\\d*{NUL}[^{NUL}]+{NUL}[^{NUL}]+{NUL}|[AMDT]{NUL}[^{NUL}]+{NUL})"
_HUNK = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def change_records(changes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, old_path, path) of NUL-delimited change records."""
    one = changes.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(_RECORD), 0)).alias("r"))
    parts = F.split("r", NUL)
    renamed = F.substring(parts[0], 1, 1).isin("R", "C")
    return one.select(key, F.substring(parts[0], 1, 1).alias("status"), F.when(renamed, parts[1]).alias("old_path"), F.when(renamed, parts[2]).otherwise(parts[1]).alias("path"))


def classify_changes(records: DataFrame, key: str) -> DataFrame:
    """(key, change, path, old_path): added, modified, deleted or renamed Python sources.

    A rename over the source boundary is an addition or a deletion; a type
    change is a modification; other files are left out.
    """
    new, old = F.col("path").endswith(".py"), F.col("old_path").endswith(".py")
    rename = F.col("status") == "R"
    change = (
        F.when(rename & new & old, "renamed").when(rename & new, "added").when(rename & old, "deleted")
        .when(F.col("status").isin("A", "C") & new, "added").when(F.col("status").isin("M", "T") & new, "modified").when((F.col("status") == "D") & new, "deleted")
    )
    path = F.when(rename & old & ~new, F.col("old_path")).otherwise(F.col("path"))
    return records.select(key, change.alias("change"), path.alias("path"), F.when(change == "renamed", F.col("old_path")).alias("old_path")).where("change is not null")


def changed_intervals(diff: Column) -> Column:
    """Array of struct(start, count) of the new side of each hunk; a missing count is 1."""
    starts, counts = (F.regexp_extract_all(diff, F.lit(_HUNK), i) for i in (1, 2))
    return F.zip_with(starts, counts, lambda s, n: F.struct(s.cast("int").alias("start"), F.when(n == "", 1).otherwise(F.try_to_number(n, F.lit("999999"))).cast("int").alias("count")))


# ------------------------------------------------------------------ Python sources

FACTS = "path string, kind string, symbol string, first int, last int, depth int, detail string"
RECEIVERS = re.compile(r"^(cursor|connection|conn|db_\w+)$")
EXECUTES = ("execute", "executemany")
_SQL_READ, _SQL_WRITE = re.compile(READ_TABLES), re.compile(WRITE_TABLES)


def module_of(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def _indent(line: str) -> int:
    width = 0
    for c in line:
        if c == " ":
            width += 1
        elif c == "\t":
            width += 8 - width % 8
        elif c == "\f":
            width = 0
        else:
            break
    return width


def _scope_lines(node: ast.AST, lines: list[str]) -> tuple[int, int]:
    """First and last line of a definition: its decorators, and deeper comments right after its body."""
    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    while node.decorator_list and first > 1 and not lines[first - 1].lstrip().startswith("@"):
        first -= 1
    last, margin = node.end_lineno, _indent(lines[node.lineno - 1])
    for n, line in enumerate(lines[last:], last + 1):
        text = line.strip(" \t\f")
        if text and not (text.startswith("#") and _indent(line) > margin):
            break
        last = n if text else last
    return first, last


def source_facts(path: str, source: str) -> list[tuple]:
    """Facts of one source: definitions, imports, calls, SQL tables, queries in loops, or its syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [(path, "error", None, getattr(e, "lineno", None) or 0, 0, 0, type(e).__name__)]
    module, lines = module_of(path), source.split("\n")
    out = [(path, "module", module, 1, max(1, source.count("\n") + 1), 0, None)]
    seen: dict[str, int] = {}

    def emit(kind: str, symbol: str, node: ast.AST, depth: int, detail: str | None) -> None:
        out.append((path, kind, symbol, node.lineno, getattr(node, "end_lineno", node.lineno), depth, detail))

    def walk(node: ast.AST, scope: str, depth: int, loops: int, in_function: bool) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = f"{scope}.{node.name}"
            seen[name] = seen.get(name, 0) + 1
            name = name if seen[name] == 1 else f"{name}#{seen[name]}"
            is_class = isinstance(node, ast.ClassDef)
            out.append((path, "class" if is_class else "function", name, *_scope_lines(node, lines), depth + 1, None))
            for child in node.body:
                walk(child, name, depth + 1, loops if is_class else 0, in_function or not is_class)
            return
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            walk(node.test if isinstance(node, ast.While) else node.iter, scope, depth, loops, in_function)
            for child in node.body:
                walk(child, scope, depth, loops + 1, in_function)
            for child in node.orelse:
                walk(child, scope, depth, loops, in_function)
            return
        if isinstance(node, ast.Import):
            for a in node.names:
                emit("import", scope, node, depth, a.name)
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                emit("import", scope, node, depth, f"{base}.{a.name}" if not base.endswith(".") else base + a.name)
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name:
                emit("call", scope, node, depth, name)
            if isinstance(f, ast.Attribute) and f.attr in EXECUTES and loops and in_function:
                owner = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else ""
                if RECEIVERS.match(owner):
                    emit("loop_query", scope, node, depth, owner)
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            for kind, pattern in (("reads", _SQL_READ), ("writes", _SQL_WRITE)):
                for t in sorted({m.lower() for m in pattern.findall(node.value)}):
                    emit(kind, scope, node, depth, t)
        for child in ast.iter_child_nodes(node):
            walk(child, scope, depth, loops, in_function)

    for child in tree.body:
        walk(child, module, 0, 0, False)
    return out


def python_facts(sources: DataFrame, path: str = "path", source: str = "source", max_bytes: int = 1 << 20) -> DataFrame:
    """Facts of all sources up to a size; the larger ones give a ``too_large`` fact."""
    s = sources.select(F.col(path).alias("path"), F.col(source).alias("source"))
    small = F.octet_length("source") <= max_bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for f in frames:
            rows = [x for p, t in zip(f["path"], f["source"], strict=True) for x in source_facts(p, t)]
            yield pd.DataFrame(rows, columns=names)

    large = s.where(~small).select("path", F.lit("too_large").alias("kind"), F.lit(None).cast("string").alias("symbol"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("detail"))
    return s.where(small).mapInPandas(run, FACTS).unionByName(large)


def loop_queries(facts: DataFrame) -> DataFrame:
    """(symbol, lines): sorted distinct lines with a query inside a loop."""
    return facts.where("kind = 'loop_query'").groupBy("symbol").agg(F.array_sort(F.collect_set("first")).alias("lines"))


def graph_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from facts: definitions, data tables, calls to uniquely named definitions."""
    defined = facts.where("kind in ('function', 'class')")
    node = lambda kind, key: F.concat(F.lit(kind), F.lit(":"), key)
    own = node(F.col("kind"), F.col("symbol"))
    code = defined.select(own.alias("id"), F.upper("kind").alias("node_type"), F.col("symbol").alias("key"))
    files = facts.where("kind = 'module'").select(F.concat(F.lit("file:"), F.col("path")).alias("id"), F.lit("FILE").alias("node_type"), F.col("path").alias("key"))
    sql = facts.where("kind in ('reads', 'writes')")
    data = sql.select(F.concat(F.lit("table:"), F.col("detail")).alias("id"), F.lit("DATABASE_TABLE").alias("node_type"), F.col("detail").alias("key")).distinct()
    defines = defined.select(F.concat(F.lit("file:"), F.col("path")).alias("source"), own.alias("target"), F.lit("DEFINES").alias("edge_type"))
    home = defined.select(F.col("symbol").alias("scope"), own.alias("source"))
    touch = sql.join(home, F.col("symbol") == F.col("scope")).select("source", F.concat(F.lit("table:"), F.col("detail")).alias("target"), F.when(F.col("kind") == "reads", "READS_FROM").otherwise("WRITES_TO").alias("edge_type"))
    named = defined.select(F.element_at(F.split("symbol", r"\."), -1).alias("name"), own.alias("target"))
    sure = named.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("target").alias("target")).where("c = 1")
    calls = facts.where("kind = 'call'").join(home, F.col("symbol") == F.col("scope")).join(sure, F.col("detail") == F.col("name")).select("source", "target", F.lit("CALLS").alias("edge_type"))
    return code.unionByName(files).unionByName(data).distinct(), defines.unionByName(touch).unionByName(calls).distinct()


# ------------------------------------------------------------------ unified diffs

FILES = "array<struct<old_path:string,new_path:string,added:array<string>,removed:array<string>,context:int,hunks:int,binary:boolean,symlink:boolean>>"
_SECTION = re.compile(r"^diff --git (?P<git>.*)$", re.M)
_RANGE = re.compile(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@.*")


def _side(text: str) -> str | None:
    name = text.split("\t")[0].strip()
    return None if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def parse_diff(diff: str) -> tuple[list[dict], list[str]]:
    """Changed files and the faults of a unified diff, section by section."""
    faults, files = [], []
    if not diff.endswith("\n"):
        faults.append("empty or no final newline")
    marks = [m.start() for m in _SECTION.finditer(diff)]
    if marks and diff[: marks[0]].strip():
        faults.append("text before the first file")
    for a, b in pairwise([*marks, len(diff)]):
        lines = diff[a:b].split("\n")[:-1] if diff[a:b].endswith("\n") else diff[a:b].split("\n")
        f = {"old_path": None, "new_path": None, "added": [], "removed": [], "context": 0, "hunks": 0, "binary": False, "symlink": False}
        heads, left, right = set(), 0, 0
        for line in lines[1:]:
            if left > 0 or right > 0:
                kind = line[:1]
                left -= kind in (" ", "-")
                right -= kind in (" ", "+")
                if kind == "+":
                    f["added"].append(line[1:])
                elif kind == "-":
                    f["removed"].append(line[1:])
                elif kind == " ":
                    f["context"] += 1
                elif kind != "\\":
                    faults.append(f"hunk of {f['new_path'] or f['old_path']} breaks off")
                    left = right = 0
            elif line.startswith("--- "):
                f["old_path"] = _side(line[4:])
                heads.add("old")
            elif line.startswith("+++ "):
                f["new_path"] = _side(line[4:])
                heads.add("new")
            elif line.startswith("@@"):
                m = _RANGE.fullmatch(line)
                if m is None or heads != {"old", "new"}:
                    faults.append("misplaced hunk header")
                    continue
                left, right = int(m[1] or 1), int(m[2] or 1)
                f["hunks"] += 1
            elif line.startswith(("GIT binary patch", "Binary files ")):
                f["binary"] = True
                break
            elif line.startswith(("rename ", "copy ")):
                faults.append("rename or copy")
            elif line.startswith(("index ", "new file mode ", "deleted file mode ", "old mode ", "new mode ")):
                f["symlink"] |= "120000" in line
            elif line and not line.startswith("\\"):
                faults.append("unexpected line")
        if left or right:
            faults.append("hunk counts differ")
        if not f["binary"] and (heads != {"old", "new"} or not f["hunks"]):
            faults.append("no headers or no hunk")
        files.append(f)
    if not files:
        faults.append("no changed file")
    return files, sorted(set(faults))


def parsed_patches(patches: DataFrame, diff: str) -> DataFrame:
    """Adds ``files`` and ``faults`` of each diff."""
    schema = f"struct<files:{FILES},faults:array<string>>"

    @F.pandas_udf(schema)
    def parse(texts: pd.Series) -> pd.DataFrame:
        found = [parse_diff(t or "") for t in texts]
        return pd.DataFrame({"files": [f for f, _ in found], "faults": [e for _, e in found]})

    return patches.withColumn("_p", parse(F.col(diff))).select(*patches.columns, "_p.files", "_p.faults")


def validate_patches(parsed: DataFrame, diff: str, max_files: int = 5, max_lines: int = 100) -> DataFrame:
    """Adds ``rejections``, sorted distinct codes; none means valid.

    Columns beside the parsed ones: expected_base, base, sha256,
    files_changed, lines_added, lines_deleted (the artifact's own claims).
    """
    count = lambda side: F.aggregate("files", F.lit(0), lambda a, f: a + F.size(f[side]))
    added, removed = count("added"), count("removed")
    path = lambda f: F.coalesce(f["new_path"], f["old_path"], F.lit(""))
    any_file = lambda rule: F.exists("files", rule)
    test = lambda f: pr.is_test_source(path(f))
    rules = {
        "base_commit_mismatch": F.col("base") != F.col("expected_base"),
        "patch_hash_mismatch": F.col("sha256") != F.sha2(F.col(diff).cast("binary"), 256),
        "invalid_unified_diff": F.size("faults") > 0,
        "file_budget_exceeded": F.size("files") > max_files,
        "line_budget_exceeded": added + removed > max_lines,
        "artifact_summary_mismatch": (F.col("files_changed") != F.size("files")) | (F.col("lines_added") != added) | (F.col("lines_deleted") != removed),
        "secret_pattern": pr.has_credential(F.col(diff)),
        "path_outside_root": any_file(lambda f: ~pr.is_safe_relative(path(f))),
        "symlink_target": any_file(lambda f: f["symlink"]),
        "workflow_file": any_file(lambda f: pr.is_workflow(path(f))),
        "dependency_manifest": any_file(lambda f: pr.is_dependency_file(path(f))),
        "verification_fixture_modified": any_file(lambda f: pr.is_fixture(path(f))),
        "binary_change": any_file(lambda f: f["binary"] | (F.size(f["added"]) + F.size(f["removed"]) + f["context"] == 0)),
        "test_file_deleted": any_file(lambda f: test(f) & f["old_path"].isNotNull() & f["new_path"].isNull()),
        "test_file_emptied": any_file(lambda f: test(f) & f["old_path"].isNotNull() & (F.size(f["added"]) == 0) & (f["context"] == 0)),
        "test_function_removed": any_file(lambda f: test(f) & (F.size(pr.removed_tests(f["removed"], f["added"])) > 0)),
        "test_skip_added": any_file(lambda f: test(f) & f["old_path"].isNotNull() & pr.skips_tests(f["added"])),
        "k6_scenario_modified": any_file(lambda f: pr.is_load_scenario(path(f), F.concat(f["added"], f["removed"]))),
    }
    codes = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules.items()])
    return parsed.withColumn("rejections", F.array_sort(F.filter(codes, lambda c: c.isNotNull())))


def file_stats(parsed: DataFrame, key: str) -> DataFrame:
    """Added, deleted and hunk counts of each file."""
    f = parsed.select(key, F.explode("files").alias("f"))
    return f.select(key, F.coalesce("f.new_path", "f.old_path").alias("path"), F.size("f.added").alias("lines_added"), F.size("f.removed").alias("lines_deleted"), F.col("f.hunks").alias("hunks"), F.col("f.binary").alias("binary"))
