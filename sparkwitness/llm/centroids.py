"""Centroid clustering: Lloyd's rounds over distinct quantised vectors with their multiplicities.

Vectors are quantised to integers and grouped, so that equal ones are one row
with a count.  Each round reads the distinct vectors once: a task finds the
nearest centroid of each and adds up weighted integer sums, one row a centroid
for each task, and only those sums are shuffled.  The assignments are joined
back to the ids at the end.  All arithmetic is on integers, so that no result
depends on the order of the rows.

* Vectors with another number of components, or with a null or non-finite one,
  take no part.  A null id takes part and comes last among the first centroids.
* Repeated rows are vectors of their own: they count, and may both be first
  centroids; the second of two equal centroids stays empty.
* Fewer vectors than centroids: as many centroids as vectors.  No vector: no row.
* A quantised component beyond 2**27 counts as 2**27, so that a squared distance
  fits a long; an inertia that does not fit one is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

SCALE, COMPONENTS, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Greatest size of a quantised component.
LIMIT = 1 << 27


def usable(vector: Column, components: int) -> Column:
    """Whether a vector has the number of components, all of them finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, at most LIMIT in size."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))


def _matrix(column: pa.ListArray, components: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, components).astype(np.int64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one on ties, and the squared distance."""
    best, found = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for j, c in enumerate(centres):
        apart = x - c
        d = np.einsum("ij,ij->i", apart, apart)
        closer = d < best
        best[closer], found[closer] = d[closer], j
    return found, best


def assigned(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds cluster and distance to (v, w); one narrow Arrow stage.  The centroids travel with it, a few KB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, d = _nearest(_matrix(b.column(0), centres.shape[1]), centres)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found), pa.array(d)], names=["v", "w", "cluster", "distance"])

    return distinct.select("v", "w").mapInArrow(run, "v array<int>, w long, cluster int, distance long")


def weighted_sums(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cluster, i, s): the sum of w * v[i] over a centroid's vectors, and at i = -1 the sum of w.

    A task emits one row for each centroid that it has met.
    """
    components = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), components + 1), object)
        for b in batches:
            if not b.num_rows:
                continue
            x, w = _matrix(b.column(0), components), b.column(1).to_numpy()
            found, _ = _nearest(x, centres)
            # Sums of a batch that may leave 64 bits are taken with Python's integers.
            wide = int(np.abs(x).max()) * int(w.astype(object).sum()) >= 1 << 62
            for j in np.unique(found):
                at = found == j
                weights = w[at].astype(object) if wide else w[at]
                total[j, 0] += int(weights.sum())
                total[j, 1:] += (weights[:, None] * x[at]).sum(axis=0).astype(object)
        met = [j for j in range(len(centres)) if total[j, 0]]
        if met:
            sums = pa.array([[str(int(s)) for s in total[j]] for j in met], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), sums], names=["cluster", "sums"])

    parts = distinct.select("v", "w").mapInArrow(run, "cluster int, sums array<string>")
    wide = parts.select("cluster", F.posexplode("sums").alias("i", "s"))
    return wide.groupBy("cluster", (F.col("i") - 1).alias("i")).agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def moved(centres: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component; empty ones stay.

    The driver reads one number for each centroid and component.
    """
    got = {(r["cluster"], r["i"]): int(r["s"]) for r in sums.collect()}
    out = centres.copy()
    for j, i in got:
        if i >= 0:
            out[j, i] = got[j, i] // got[j, -1]
    return out


def first_centres(vectors: DataFrame, count: int, seed: str) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; equal hashes by their components."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")).cast("binary"), 256)
    top = vectors.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(count).collect()
    return np.array([r["v"] for r in top], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: str = SEED) -> DataFrame:
    """One row for each usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Copies of a vector are one row until the last join, in which the ids of a
    vector that a large share of them have are not shuffled.
    """
    spark = vectors.sparkSession
    q = vectors.where(usable(F.col(vec_col), components)).select(F.col(id_col).alias("id"), quantised(F.col(vec_col), scale).alias("v"))
    distinct = frames.settled(q.groupBy("v").agg(F.count(F.lit(1)).alias("w")))
    centres = first_centres(q, k, seed)
    if not len(centres):
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return q.select("id", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    for _ in range(rounds):
        centres = moved(centres, weighted_sums(distinct, centres))
    found = frames.settled(assigned(distinct, centres))
    spread = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("w").cast("decimal(19,0)"))
    inertia = {r["cluster"]: (int(r["s"]), r["n"]) for r in found.groupBy("cluster").agg(spread.alias("s"), F.sum("w").alias("n")).collect()}  # one row a centroid
    fits = lambda n: n if n < 1 << 63 else None
    whole, total = sum(s for s, _ in inertia.values()), sum(n for _, n in inertia.values())
    named = F.sha2(F.col("c").cast("binary"), 256)
    rows = [(j, fits(s), fits(whole), ",".join(map(str, centres[j].tolist()))) for j, (s, _) in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, c string").withColumn("centroid_sha256", named).drop("c")
    back = frames.lookup(q, found, ["v"], "w", total).drop("v")
    return back.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
