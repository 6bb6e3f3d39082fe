"""Queries over repository objects."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ship_package, table
from ..sources import objects as ob
from ..sources.journal import Journal
from ..tables import shared_folder
from .registry import query

_FILES_SQL = "f AS (SELECT coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id::VARCHAR || '.txt' AS path, coalesce(source, 'none') AS a, coalesce(lang, 'none') AS b, doc_id::VARCHAR || '.txt' AS name, coalesce(text, '') AS t FROM documents)"


def files(spark, sf):
    """Documents as files: a folder for each source, in it one for each language."""
    part = lambda c: F.coalesce(c, F.lit("none"))
    return table(spark, sf, "documents").select(F.concat_ws("/", part("source"), part("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"), "doc_id")


def _tree_sql(entries: str, group: str) -> str:
    """Folder ids of a level: entries (key, mode, oid) hashed in order of their keys."""
    body = "string_agg(hex(encode(mode || ' ' || rtrim(key, '/'))) || '00' || upper(oid), '' ORDER BY key)"
    return f"SELECT {group}, sha1(unhex(hex(encode('tree ' || (length({body}) // 2)::VARCHAR)) || '00' || {body})) AS oid FROM {entries} GROUP BY {group}"


@query(
    "s01_object_listing",
    f"""WITH {_FILES_SQL}, bl AS (SELECT path, a, b, name AS key, '100644' AS mode, sha1(unhex(hex(encode('blob ' || strlen(t)::VARCHAR)) || '00' || hex(encode(t)))) AS oid FROM f),
l2 AS ({_tree_sql("bl", "a, b")}), e1 AS (SELECT a, b || '/' AS key, '40000' AS mode, oid FROM l2), l1 AS ({_tree_sql("e1", "a")}), e0 AS (SELECT 0 AS r, a || '/' AS key, '40000' AS mode, oid FROM l1), l0 AS ({_tree_sql("e0", "r")})
SELECT mode, 'blob' AS kind, oid, path FROM bl UNION ALL SELECT '040000', 'tree', oid, a || '/' || b FROM l2 UNION ALL SELECT '040000', 'tree', oid, a FROM l1 UNION ALL SELECT '040000', 'tree', oid, '' FROM l0""",
)
def s01(spark, sf):
    """Mode, kind, id and path of every object of a content-addressed tree."""
    return ob.listing(files(ship_package(spark), sf))


@query(
    "s02_blob_reading",
    r"""WITH f AS (SELECT source AS repository, lpad(doc_id::VARCHAR, 9, '0') AS path, doc_id % 5 AS kind, text AS t, strlen(text) + CASE doc_id % 5 WHEN 1 THEN 3 WHEN 2 THEN 26 WHEN 3 THEN 24 WHEN 4 THEN 1 ELSE 0 END AS size FROM documents WHERE text IS NOT NULL),
c AS (SELECT repository, list_reduce(list_prepend({'p': '', 's': 0::BIGINT, 'u': 0::BIGINT, 'k': []::VARCHAR[]}, list(struct_pack(p := path, s := size::BIGINT, u := 0::BIGINT, k := []::VARCHAR[]) ORDER BY path)),
  lambda a, x: CASE WHEN a.u + x.s > 40000 THEN {'p': x.p, 's': x.s, 'u': a.u, 'k': a.k} ELSE {'p': x.p, 's': x.s, 'u': a.u + x.s, 'k': list_append(a.k, x.p)} END).k AS kept FROM f WHERE size <= 3000 GROUP BY 1),
j AS (SELECT f.*, CASE WHEN size > 3000 THEN 'blob_size_limit' WHEN NOT list_contains(kept, path) THEN 'total_size_limit' WHEN kind IN (3, 4) THEN 'source_encoding_error' END AS code FROM f LEFT JOIN c ON c.repository IS NOT DISTINCT FROM f.repository)
SELECT repository, path, size::BIGINT AS size, code, CASE WHEN code IS NULL THEN CASE kind WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'iso-8859-1' ELSE 'utf-8' END END AS encoding,
  CASE WHEN code IS NULL THEN CASE kind WHEN 2 THEN 26 + strlen(replace(t, chr(13) || chr(10), chr(10))) ELSE length(replace(t, chr(13) || chr(10), chr(10))) END END::BIGINT AS n_chars FROM j""",
)
def s02(spark, sf):
    """Documents as files of four encodings and a broken one, read under a blob and a total limit."""
    t = table(ship_package(spark), sf, "documents").where("text is not null")
    raw, kind = F.encode("text", "UTF-8"), F.col("doc_id") % 5
    line = lambda s: F.lit(s.encode())
    content = F.when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(kind == 2, F.concat(line("# -*- coding: latin-1 -*-\n"), raw)).when(kind == 3, F.concat(line("# coding: no-such-codec\n"), raw)).when(kind == 4, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    f = t.select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), content.alias("content"))
    out = ob.read_blobs(f, "source", max_blob=3_000, max_total=40_000)
    return out.select("repository", "path", "size", "code", "encoding", F.char_length("source").cast("long").alias("n_chars"))


@query("s15_journal_appends", "SELECT user_id, event_id, CASE WHEN event_id % 3 < 2 THEN 'first' ELSE 'second' END AS writer, CASE WHEN event_id % 3 < 2 THEN 1 ELSE 2 END AS version FROM events")
def s15(spark, sf):
    """Two appends that share a third of their keys; each key has the record of the first."""
    journal = Journal(spark, f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}", "user_id long, event_id long, writer string, version int", ["user_id", "event_id"])
    e = table(spark, sf, "events").select("user_id", "event_id")
    part = lambda cond, name, version: e.where(cond).withColumns({"writer": F.lit(name), "version": F.lit(version)})
    journal.append(part("event_id % 3 < 2", "first", 1))
    journal.append(part("event_id % 3 > 0", "second", 2))
    return journal.read()
