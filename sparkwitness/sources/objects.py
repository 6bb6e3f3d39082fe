"""Repository objects: content-addressed listings, and files read under limits with their encoding detected."""

from __future__ import annotations

import io
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.planning import Budget, greedy
from ..tables import match, ordered, settled, streamed_digest

# Modes of a listing, default limits of a read, codes of a refusal.
FILE, FOLDER = "100644", "040000"
MAX_BLOB_BYTES, MAX_TOTAL_BYTES = 1_000_000, 10_000_000
TOO_LARGE, OVER_TOTAL, BAD_ENCODING = "blob_size_limit", "total_size_limit", "source_encoding_error"
#: So many entries of a folder are joined to one piece before they are hashed.
_JOINED = 256


def _object_id(kind: str, content: Column) -> Column:
    """SHA-1 of an object: its kind and size, a zero byte, its content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit(kind + " "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(?s:(.*))/[^/]*$", 1)).otherwise("")


def listing(files: DataFrame, path: str = "path", content: str = "content", mode: str | None = None) -> DataFrame:
    """(mode, kind, oid, path) of every file and folder; the root folder's path is empty.

    Ids are those of a content-addressed store: a file's id is the hash of its
    content, a folder's that of its entries in order, so equal folders have
    equal ids and a changed file changes the ids up to the root.  Folders are
    built from the deepest level up, one aggregation a level.  A folder's
    entries are sorted by ranges and joined to pieces, so a folder may have any
    number of them; only the hash itself, sequential as it is, runs over the
    pieces in one task.  Of rows with equal paths the one with the smallest mode
    and id stays; null paths are left out, null content is empty.
    """
    data = F.coalesce(F.col(content).cast("binary"), F.unhex(F.lit("")))
    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.struct((F.col(mode) if mode else F.lit(FILE)).alias("mode"), _object_id("blob", data).alias("oid")).alias("f"))
    blobs = rows.groupBy("path").agg(F.min("f").alias("f")).select("f.mode", F.lit("blob").alias("kind"), "f.oid", "path")
    objects = settled(blobs.withColumn("depth", F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))))
    deepest = objects.agg(F.max("depth")).first()[0]
    done, trees = [objects], None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = objects.where(F.col("depth") == depth)
        trees = settled(_folders(here if trees is None else here.unionByName(trees)).withColumn("depth", F.lit(depth - 1)))
        done.append(trees)
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.drop("depth")


def _folders(entries: DataFrame) -> DataFrame:
    """The folders that hold the entries of one level."""
    is_tree = F.col("kind") == "tree"
    name = F.regexp_extract("path", r"(?s:([^/]*))$", 1)
    # Folders sort as if their names ended with a slash; their stored mode has no leading zero.
    head = F.hex(F.encode(F.concat(F.ltrim("mode", F.lit("0")), F.lit(" "), name), "UTF-8"))
    e = entries.select(_parent(F.col("path")).alias("folder"), F.when(is_tree, F.concat(name, F.lit("/"))).otherwise(name).alias("name"), F.concat(head, F.lit("00"), F.upper("oid")).alias("entry"))
    rows = ordered(e, "folder", "name", "entry")
    pieces = rows.groupBy("folder", F.expr(f"_seq div {_JOINED}").alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_seq", "entry"))), lambda x: x["entry"]), "").alias("hex"))
    pieces = settled(pieces)
    sizes = pieces.groupBy("folder").agg((F.sum(F.length("hex")) / 2).cast("long").alias("size"))
    first = sizes.select("folder", F.lit(-1).cast("long").alias("at"), F.concat(F.encode(F.concat(F.lit("tree "), F.col("size").cast("string")), "UTF-8"), F.unhex(F.lit("00"))).alias("data"))
    ids = streamed_digest(first.unionByName(pieces.select("folder", "at", F.unhex("hex").alias("data"))), "folder", "at", "data", "sha1")
    return ids.select(F.lit(FOLDER).alias("mode"), F.lit("tree").alias("kind"), F.col("digest").alias("oid"), F.col("folder").alias("path"))


def decoded(content: bytes) -> tuple[str | None, str | None]:
    """(encoding, text) by byte order mark, declared coding line or UTF-8, line ends made one character; no text where that fails."""
    try:
        encoding = tokenize.detect_encoding(io.BytesIO(content).readline)[0]
        text = str(content, encoding)
    except (SyntaxError, ValueError, LookupError):  # a wrong declaration, wrong bytes, an unknown codec
        return None, None
    return encoding, "\n".join(text.split("\r\n"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):  # a file at a time, so that memory follows the largest file
            repository, path, size, code, content = (b.column(k)[i].as_py() for k in range(5))
            encoding, text = decoded(content or b"") if code is None else (None, None)
            code = code or (BAD_ENCODING if text is None else None)
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((repository, pa.string()), (path, pa.string()), (size, pa.int64()), (code, pa.string()), (encoding, pa.string()), (text, pa.string()))], names=["repository", "path", "size", "code", "encoding", "source"])


def read_blobs(files: DataFrame, repository: str, path: str = "path", content: str = "content", max_blob: int = MAX_BLOB_BYTES, max_total: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(repository, path, size, code, encoding, source): files decoded, or the code of why not.

    In path order a file above ``max_blob`` is refused and takes nothing of the
    total, one that would pass ``max_total`` is skipped and later ones may still
    fit; a file that cannot be decoded has taken its size.  Null content is an
    empty file.  Paths are unique in a repository.
    """
    t = files.select(F.col(repository).cast("string").alias("repository"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    t = t.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
    fits = F.col("size") <= max_blob
    chosen = greedy(t.where(fits).select("repository", "path", "size"), "repository", ["path"], Budget((("size", max_total, OVER_TOTAL),)))
    code = chosen.select("repository", "path", F.get("exceeded", F.lit(0)).alias("code"))
    small = match(t.where(fits), code, ["repository", "path"]).select("repository", "path", "size", "code", F.when(F.col("code").isNull(), F.col("content")).alias("content"))
    large = t.where(~fits).select("repository", "path", "size", F.lit(TOO_LARGE).alias("code"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).mapInArrow(_read, "repository string, path string, size long, code string, encoding string, source string")
