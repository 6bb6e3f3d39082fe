"""Operator 6: language by the nearest of several centroids of each language.

A text is a vector of its 1- to 3-grams of letters (UTF-8 bytes of the
lower-cased text, all else one blank), hashed to ``DIMENSIONS``: log counts
times inverse document frequency, of unit length.  The training vectors of each
language are clustered by spherical k-means into ``CENTROIDS`` centroids; a text
takes the language of the nearest centroid by cosine.  A text farther from its
centroid than almost all of that centroid's training texts is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textkernel as tk

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Training texts of each language, about; those of the smallest hash.
SAMPLE_PER_LANGUAGE = 1500
#: Up to so many languages their sampling rates are broadcast; beyond, they are joined.
MOST_LANGUAGES = 10_000
#: A text is rejected at this many deviations below the mean cosine of its centroid.
REJECT_DEVIATIONS = 4.0

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ROWS = 256


def _codes(data: np.ndarray) -> list[tuple[int, np.ndarray]]:
    x = data.astype(np.uint32)
    one = x
    two = x[:-1] * np.uint32(257) + x[1:] + np.uint32(1 << 20)
    three = two[:-1] * np.uint32(257) + x[2:] + np.uint32(1 << 21)
    return [(n, ((c * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)) for n, c in ((1, one), (2, two), (3, three))]


def counts(texts: list[str]) -> np.ndarray:
    """Log counts of hashed n-grams, one row for each text."""
    raw = [t.lower().encode() for t in texts]
    sizes = np.array([len(r) + 2 for r in raw])
    data = _FOLD[np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8)]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])  # runs of other bytes are one blank
    row = row[keep]
    data = data[keep]
    out = np.zeros(len(texts) * DIMENSIONS)
    for n, code in _codes(data):
        m = len(code)
        inside = row[:m] == row[n - 1 :]
        out += np.bincount((row[:m] * DIMENSIONS + code)[inside], minlength=len(out))
    return np.log1p(out).astype(np.float32).reshape(len(texts), DIMENSIONS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    """Inverse document frequencies, centroids, their languages and rejection bounds."""

    idf: np.ndarray
    centres: np.ndarray
    languages: list[str]
    bounds: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text; ``und`` without letters or without a model."""
        ok = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        langs, score, reject = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if ok and self.languages:
            near = _unit(counts([texts[i] for i in ok]) * self.idf) @ self.centres.T
            best = near.argmax(axis=1)
            for i, b, s in zip(ok, best, near[np.arange(len(ok)), best], strict=True):
                langs[i], score[i], reject[i] = self.languages[b], min(1.0, max(0.0, float(s))), s < self.bounds[b]
        return langs, score, reject


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from a start that spreads the centroids; no randomness."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        far = np.max(x @ _unit(np.stack(centres)).T, axis=1).argmin()
        centres.append(x[far])
    centres = _unit(np.stack(centres))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        new = _unit(new)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def sample(docs: DataFrame, held_out: F.Column | None, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, x) of about ``per_language`` different texts of each language, vectors of half precision.

    A text is drawn by a hash of itself, at a rate by the number of different
    texts of its language, and once however often it occurs.
    """
    use = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (held_out if held_out is not None else F.lit(False)).alias("out"))
    use = use.where("not out and lang is not null and text is not null").withColumn("th", F.xxhash64("text"))
    rate = use.groupBy("lang").agg(F.approx_count_distinct("th", 0.02).alias("c")).select("lang", (F.lit(float(per_language)) / F.col("c")).alias("rate"))
    rates = rate.limit(MOST_LANGUAGES + 1).collect()  # a row for each language
    if len(rates) <= MOST_LANGUAGES:
        rate = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in rates], "lang string, rate double"))
    drawn = use.join(rate, "lang").where((F.pmod(F.xxhash64("th", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)) < F.col("rate"))
    once = drawn.groupBy("lang", "th").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in frames.text_chunks(batches, "text"):
            for a in range(0, rows.num_rows, _ROWS):
                part = rows.slice(a, _ROWS)
                texts = part.column(1).to_pylist()
                ok = [i for i, t in enumerate(texts) if _LETTER.search(t)]
                if ok:
                    x = counts([texts[i] for i in ok]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ok)), pa.array([v.tobytes() for v in x])], names=["lang", "x"])

    return once.select("lang", "text").mapInArrow(run, "lang string, x binary")


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in column]).astype(np.float32)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", held_out: F.Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Centroids:
    """Centroids of the non-null languages of rows that are not held out.

    The sample of a language is about ``per_language`` texts (a bounded
    parameter), whole texts each; texts without letters are not used, and
    repeated texts count once, whatever their ids.  The sample is a table in the
    shared folder; frequencies, clusters and votes are made on the executors, a
    language's clusters by one task, so the driver holds the centroids only.
    """
    spark = docs.sparkSession
    drawn = frames.settled(sample(docs, held_out, text_col, lang_col, per_language))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIMENSIONS, np.int64)
        for rows in batches:
            for a in range(0, rows.num_rows, _ROWS):
                x = _vectors(rows.column(0).slice(a, _ROWS))
                n += len(x)
                seen += (x > 0).sum(axis=0)
        if n:
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], at))), pa.array(np.concatenate(([n], seen[at])))], names=["at", "n"])

    parts = drawn.select("x").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = {r["at"]: r["n"] for r in parts.collect()}  # DIMENSIONS + 1 rows at most
    if not found:
        frames.forget(drawn)
        return Centroids(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    total = found.pop(-1)
    seen = np.zeros(DIMENSIONS)
    seen[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def centres_of(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v, np.float16) for v in sorted(table.column("x").to_pylist())]).astype(np.float32)
        c = cluster(_unit(x * idf), CENTROIDS).astype(np.float32)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c), pa.string()), "i": pa.array(np.arange(len(c))), "c": pa.array([v.tobytes() for v in c], pa.binary())})

    rows = drawn.groupBy("lang").applyInArrow(centres_of, "lang string, i long, c binary").collect()  # CENTROIDS a language
    rows.sort(key=lambda r: (r["lang"], r["i"]))
    centres = np.stack([np.frombuffer(r["c"], np.float32) for r in rows])
    shared = spark.sparkContext.broadcast(centres)

    # A cluster of mislabelled texts lies among the texts of another language and takes
    # the language that most texts nearest to it have.
    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                near = _unit(_vectors(part.column(1)) * idf) @ shared.value.T
                own = near.argmax(axis=1)
                cosine = near[np.arange(len(own)), own].astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), pa.array(np.rint(cosine * (1 << 20)).astype(np.int64))], names=["lang", "centre", "cosine"])

    cosine = F.col("cosine").cast("decimal(20,0)")  # sums of integers do not depend on their order
    ballots = drawn.mapInArrow(votes, "lang string, centre long, cosine long").groupBy("centre", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(cosine).alias("s"), F.sum(cosine * cosine).alias("q"))
    won = ballots.groupBy("centre").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("first"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    rows = sorted(won.select("centre", "first.lang", "n", "s", "q").collect(), key=lambda r: r["centre"])
    mean = [float(r["s"]) / r["n"] / (1 << 20) for r in rows]
    deviation = [max(0.0, float(r["q"]) / r["n"] / (1 << 40) - m * m) ** 0.5 for r, m in zip(rows, mean, strict=True)]
    bounds = [m - REJECT_DEVIATIONS * max(d, 0.02) for m, d in zip(mean, deviation, strict=True)]
    frames.forget(drawn)
    shared.unpersist()
    return Centroids(idf, centres[[r["centre"] for r in rows]], [r["lang"] for r in rows], np.array(bounds))


def predict(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) of every row, one narrow stage.

    ``lang_pred`` is the nearest language even where it is ``rejected`` for its
    distance; it is ``und``, with score 0, for null texts and texts without a letter.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)  # of CENTROIDS vectors a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in frames.text_chunks(batches, "text"):
            for a in range(0, rows.num_rows, _ROWS):
                part = rows.slice(a, _ROWS)
                langs, score, reject = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(reject)], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, rejected boolean")
