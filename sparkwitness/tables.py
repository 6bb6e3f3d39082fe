"""Tables in the shared folder, joins that stand hot keys, and order over groups of any size.

Spark's windows put a group into one task.  Here a table is sorted by ranges of
its keys, so that a group may span many tasks; what a task needs to know of the
rows before its own is one row for each range that the group spans.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key of more than one in so many rows is hot; there are at most so many hot keys.
HOT_PARTS = 256


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a cluster must name one that all executors share, a local session gets its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: no lineage, and no lost executor undoes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys equal each other; the keys of ``rows`` stay."""
    b, cond = other.withColumnsRenamed({k: f"_r_{k}" for k in on}), F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = rows.join(b, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in on])


def lookup(rows: DataFrame, unique: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Rows joined with the one row of ``unique`` that has their key; rows without one are left out.

    ``weight`` is a column of ``unique`` that counts the rows of its key (or
    more), ``total`` the number of rows.  Keys of more than total / HOT_PARTS
    rows are fewer than HOT_PARTS, so their rows of ``unique`` are broadcast and
    the rows that have them stay where they are; the other keys are shuffled.
    """
    is_hot = F.col(weight) * HOT_PARTS > total
    few = unique.where(is_hot)
    hot = match(rows, F.broadcast(few), on).drop(weight)
    cold = match(match(rows, F.broadcast(few.select(*on)), on, "left_anti"), unique.where(~is_hot), on).drop(weight)
    return hot.unionByName(cold)


def ordered(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows in a total order: ``_seq`` grows along it, ``_part`` is the range of a row."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id())
    return settled(dealt.withColumn("_part", F.shiftright("_seq", 33)))


def _spans(rows: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """One row for each range that a group spans."""
    return rows.groupBy(*keys, "_part").agg(*[c.alias(n) for n, c in aggregates.items()])


def prefix_sums(rows: DataFrame, keys: list[str], amounts: dict[str, Column]) -> DataFrame:
    """Adds, for rows of ``ordered``, the sum of each amount over the earlier rows of their group."""
    before = Window.unboundedPreceding, -1
    here, across = Window.partitionBy(*keys, "_part").orderBy("_seq").rowsBetween(*before), Window.partitionBy(*keys).orderBy("_part").rowsBetween(*before)
    rows = rows.withColumns({f"_a_{n}": c for n, c in amounts.items()})
    spans = _spans(rows, keys, **{f"_t_{n}": F.sum(f"_a_{n}") for n in amounts})
    carried = spans.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_c_{n}") for n in amounts])
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_a_{n}").over(here), F.lit(0)) for n in amounts})
    out = match(local, carried, [*keys, "_part"]).withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in amounts})
    return out.drop(*[f"_{x}_{n}" for n in amounts for x in "alc"])


def with_previous(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Adds, for rows of ``ordered``, ``_pos`` (from 1 in each group) and ``_before_<column>`` of the row before (null at the first)."""
    here, across = Window.partitionBy(*keys, "_part").orderBy("_seq"), Window.partitionBy(*keys).orderBy("_part")
    spans = _spans(rows, keys, _n=F.count(F.lit(1)), _first=F.min("_seq"), **{f"_last_{c}": F.max_by(F.struct(c), "_seq") for c in columns})
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), *[F.lag(f"_last_{c}").over(across)[c].alias(f"_in_{c}") for c in columns])
    local = rows.withColumns({f"_lag_{c}": F.lag(c).over(here) for c in columns})
    out = match(local, spans, [*keys, "_part"])
    at_start = F.col("_seq") == F.col("_first")
    out = out.withColumns({"_pos": F.col("_offset") + F.col("_seq") - F.col("_first") + 1} | {f"_before_{c}": F.when(at_start, F.col(f"_in_{c}")).otherwise(F.col(f"_lag_{c}")) for c in columns})
    return out.drop("_first", "_offset", *[f"_{x}_{c}" for c in columns for x in ("in", "lag")])


def streamed_digest(pieces: DataFrame, key: str, order: str, data: str, algorithm: str) -> DataFrame:
    """(key, digest): the hash of each key's pieces (binary) one after the other.

    A digest is sequential by its definition, so a key's pieces go to one task,
    which holds one of them at a time; many small values are joined to pieces
    beforehand.
    """
    kind = pieces.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            keys, done = b.column(0), []
            for i in range(b.num_rows):
                k = keys[i].as_py()
                if state is None or k != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.new(algorithm)
                state.update(b.column(1)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], keys.type), pa.array([d for _, d in done], pa.string())], names=[key, "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], keys.type), pa.array([state.hexdigest()])], names=[key, "digest"])

    return pieces.repartition(key).sortWithinPartitions(key, order).select(key, data).mapInArrow(run, f"{key} {kind}, digest string")
