"""Helpers that put the kernels on Spark frames: batches, row keys, cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk

#: fn(rows of one chunk, its bytes, its offsets) -> one batch of results or none
ChunkFn = Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = tk.CHUNK_BYTES):
    """Cut incoming batches into chunks bounded in bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = tk.text_buffers(batch.column(batch.schema.get_field_index(text)))
        for a, b in tk.chunks(offsets, limit):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def map_texts(df: DataFrame, text: str, fn: ChunkFn, schema: str, limit: int = tk.CHUNK_BYTES) -> DataFrame:
    """Apply ``fn`` to chunks of rows; one narrow Arrow stage, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, text, limit):
            out = fn(rows, data, offsets)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def as_list(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """List column from the count of values of each row and the flat values."""
    cut = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(values, kind))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed column (Spark has no unsigned type)."""
    return np.ascontiguousarray(h).view(np.int64)


def shared_folder(spark: SparkSession) -> str:
    """Set a checkpoint folder where the cluster names none, and return it.

    A cluster, ``local-cluster`` included, must name a shared one in
    ``spark.checkpoint.dir``; the local temporary folder serves sessions of one
    JVM, such as tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    This cuts the lineage; the table survives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``settled`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_settled_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: A key of more than one in so many rows is hot; there are at most so many hot keys.
HOT_PARTS = 256


def lookup(rows: DataFrame, unique: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Rows joined with the one row of ``unique`` that has their key; rows without one are left out.

    ``weight`` is a column of ``unique`` that counts the rows of its key (or
    more), ``total`` the number of rows.  Keys of more than total / HOT_PARTS
    rows are fewer than HOT_PARTS, so their rows of ``unique`` are broadcast and
    the rows that have them stay where they are; the other keys are shuffled.
    """
    is_hot = F.col(weight) * HOT_PARTS > total
    few = unique.where(is_hot)
    hot = rows.join(F.broadcast(few), on).drop(weight)
    cold = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(unique.where(~is_hot), on).drop(weight)
    return hot.unionByName(cold)


#: So many edges (16 bytes each) are joined by one task of the executors; more of them by distributed rounds.
FEW_EDGES = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges of a task: least labels spread along the edges, then along the labels."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in (0, 1))
    node, back = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label, before = np.arange(len(node)), None
    while before is None or (label != before).any():
        before = label
        low, label = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges between long ids.

    Alternating large-star and small-star rounds until the edges no longer
    change.  Each star needs its nodes' minimum only, which is partially
    aggregated before the shuffle, so a hot node is never gathered in a task.
    At most ``FEW_EDGES`` edges are joined by one task instead, which saves the
    rounds' jobs and gives the same rows.
    Returns (node, component), component the smallest node id reached; nodes
    without an edge do not appear.
    """
    e = settled(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    if e.count() <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(_joined, "node long, component long")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join's hot partitions can be split.
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").distinct()
        down = settled(large)
        low2 = settled(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = settled(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        forget(e, low, down, low2)
        e = new
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    out = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return out.unionByName(roots.join(out.select("node"), "node", "left_anti"))
