"""Operator 4: document quality by a regularised quadratic discriminant.

Statistics of a whole text (shape of words and lines, shares of byte classes,
repetition, entropy) are transformed to be roughly normal.  Each class has its
mean and a covariance shrunk towards the pooled one and its diagonal; a score
is the difference of the two log densities, from Mahalanobis distances by
Cholesky factors that are computed once, put on a probability scale by a
logistic fit on the training scores.  Only the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textkernel as tk

#: Most labelled rows that the fit uses, those of the smallest hash of their id.
MAX_LABELLED = 20_000
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
#: A document is kept from this score on.
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[9, 10, 11, 12, 13, 32]] = 1
_CLASSES[48:58] = 2
_CLASSES[65:91] = 3
_CLASSES[97:123] = 4
_CLASSES[[33, 63]] = 5
_CLASSES[[44, 46, 58, 59]] = 6
_CLASSES[[ord(c) for c in "\"#$%&'()*+-/<=>@[\\]^_`{|}~"]] = 7
_CLASSES[128:] = 8


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Log-odds of part/whole, smoothed."""
    return np.log((part + 0.5) / (whole - part + 0.5))


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the count of each row's most frequent one."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (v[1:] != v[:-1]))))
    count = np.diff(np.concatenate((first, [len(r)])))
    most = np.zeros(n)
    np.maximum.at(most, r[first], count)
    return np.bincount(r[first], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of a chunk."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _CLASSES[data]
    of = [_per_row(kind == k, offsets).astype(float) for k in range(9)]
    start, end, row = tk.word_spans(data, offsets)
    words = np.bincount(row, minlength=n).astype(float)
    length = (end - start).astype(float)
    mean = np.bincount(row, length, minlength=n) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=n) / np.maximum(words, 1) - mean**2, 0))
    long_words = np.bincount(row, length > 14, minlength=n)
    last = data[end - 1] if len(end) else data[:0]
    odd_end = np.bincount(row, np.isin(_CLASSES[last], (5, 7)), minlength=n)
    alone = np.bincount(row, (length == 1) & (_CLASSES[data[start]] == 7) if len(start) else length, minlength=n)
    roll = tk.RollingHash(tk._LOWER[data])
    name = tk.mix(roll.spans(start, end))
    kinds, top = _distinct(row, name, n)
    gram, owner = tk.gram_hashes(name, row, 3)
    grams = np.bincount(owner, minlength=n).astype(float)
    gram_kinds, _ = _distinct(owner, gram, n)
    breaks = np.flatnonzero(data == 10)
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n) + 1.0
    edges = np.unique(np.concatenate((offsets, breaks + 1)))
    a, b = edges[:-1], edges[1:]
    owner_line = np.searchsorted(offsets, a, "right") - 1
    line_kinds, _ = _distinct(owner_line, tk.RollingHash(data).spans(a, b), n)
    real_lines = np.bincount(owner_line, minlength=n).astype(float)
    upper_words = np.bincount(row, (_CLASSES[data[start]] == 3) if len(start) else length, minlength=n)
    hist = np.zeros((n, 256))
    if len(data):
        at = np.repeat(np.arange(n), np.diff(offsets)) * 256 + data
        for lo in range(0, n, 512):
            hi = min(n, lo + 512)
            own = at[offsets[lo] : offsets[hi]] - lo * 256
            hist[lo:hi] = np.bincount(own, minlength=(hi - lo) * 256).reshape(hi - lo, 256)
    share = hist / np.maximum(size, 1)[:, None]
    entropy = -np.sum(np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0), axis=1)
    letters = of[3] + of[4] + of[8]
    return np.column_stack(
        [np.log1p(words), np.log1p(mean), np.log1p(spread), _shares(letters, size), _shares(of[3], np.maximum(letters, of[3])), _shares(of[2], size), _shares(of[5], size), _shares(of[6], size), _shares(of[7], size), _shares(of[1], size), _shares(kinds, words), _shares(top, words), _shares(gram_kinds, grams), np.log1p(size / lines), _shares(line_kinds, real_lines), _shares(odd_end, words), _shares(alone, words), _shares(long_words, words), _shares(upper_words, words), entropy]
    )


@dataclass
class Discriminant:
    """Two classes' means, inverse Cholesky factors and log determinants, and the scale of scores."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0."""
        d = [-0.5 * np.sum(((x - self.means[k]) @ self.factors[k].T) ** 2, axis=1) - self.offsets[k] for k in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * _squash(self.difference(x)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _squash(d: np.ndarray) -> np.ndarray:
    return np.arcsinh(d / 4)


def _logistic(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a penalised logistic fit on one variable, by Newton steps."""
    x = np.column_stack((d, np.ones(len(d))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + np.array([1e-3 * w[0], 0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Fit on statistics and 0/1 labels; with fewer than 3 rows of a class the score is the class share."""
    sizes = np.bincount(y, minlength=2) if len(y) else np.zeros(2, int)
    if sizes.min() < 3:
        share = (sizes[1] + 0.5) / (sizes.sum() + 1)
        return Discriminant(np.zeros((2, 0)), np.zeros((2, 0, 0)), np.zeros(2), 0, 0, float(share))
    means = np.stack([x[y == k].mean(axis=0) for k in (0, 1)])
    centred = [x[y == k] - means[k] for k in (0, 1)]
    cov = [c.T @ c / len(c) for c in centred]
    pooled = sum(c.T @ c for c in centred) / len(x)
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1])
    weight = [TO_POOLED + (1 - TO_POOLED) * x.shape[1] / (x.shape[1] + len(c)) for c in centred]
    factors, logs = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - weight[k]) * cov[k] + weight[k] * pooled)
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(np.diag(lower)).sum())
    out = Discriminant(means, np.stack(factors), np.array(logs), 1.0, 0.0)
    out.slope, out.shift = _logistic(_squash(out.difference(x)), y.astype(float))
    return out


def is_held_out(id_col: str, folds: int = 5) -> F.Column:
    """Rows that no fit sees: crc32 of the id as text leaves 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Discriminant:
    """Fit on the labelled documents that are not held out, ``max_labelled`` at most.

    Rows with a null label or id are not used; a repeated label row counts once,
    and of documents under one id the one with the least statistics.
    """
    use = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~is_held_out("id")).distinct()
    use = use.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)  # bounded, so broadcast below
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = named.join(F.broadcast(use), "id").select("id", "y", "text")

    def fn(rows, data, offsets):
        x = statistics(data, offsets)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), frames.as_list(np.full(len(x), x.shape[1]), x.ravel(), pa.float64())], names=["id", "y", "x"])

    each = frames.map_texts(known, "text", fn, "id long, y int, x array<double>").groupBy("id", "y").agg(F.min("x").alias("x"))
    found = sorted((r["y"], tuple(r["x"])) for r in each.toLocalIterator())
    if not found:
        return fit_arrays(np.zeros((0, 0)), np.zeros(0, int))
    return fit_arrays(np.array([x for _, x in found]), np.array([y for y, _ in found]))


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, one narrow stage; null text counts as empty and gets a score too."""

    def fn(rows, data, offsets):
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(statistics(data, offsets)))], names=["id", "score"])

    return frames.map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", fn, "id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, all columns unchanged."""

    def fn(rows, data, offsets):
        return rows.filter(pa.array(model.score(statistics(data, offsets)) >= threshold))

    return frames.map_texts(docs, text_col, fn, docs.schema)
