"""Operator 5: improbable-feature digests of documents and their likeness.

Every window of ``WINDOW`` bytes has an entropy.  Its rarity is a fixed
function of the entropy: windows near the middle of running text are common and
rank last, windows off it rank first, and windows of almost constant bytes are
no features at all.  In each stretch of ``NEIGHBOURS`` windows the best-ranked
(leftmost of equal ones) gets a vote; windows with ``VOTES`` or more are the
selected features.  Each feature sets ``HASHES`` bits of the open Bloom filter
of the digest; after ``FEATURES`` features the next filter of the chain is
opened.  Likeness compares each filter of the shorter chain with all filters of
the other one: the common bits less those that chance would give, over the most
that could be common; the best counts, and the mean over the chain weighted by
the features is the result.

A text too short for ``MIN_WINDOWS`` windows of full width, or of filler windows
only, takes all its windows of ``SHORT`` bytes as features (the whole text if it
is shorter than that).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textkernel as tk

WINDOW, SHORT, MIN_WINDOWS = 32, 4, 160
NEIGHBOURS, VOTES = 32, 12
BITS, HASHES, FEATURES = 2048, 4, 192

_U64 = np.uint64
#: Usual entropy of running text over one window, in bits, and its usual spread.
TYPICAL_ENTROPY, TYPICAL_SPREAD = 3.55, 0.35
#: Below this entropy a window is filler (rules, padding) and never a feature.
LEAST_ENTROPY = 1.2

_XLOGX = np.zeros(WINDOW + 1)
_XLOGX[1:] = np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))
_GAIN = np.rint((_XLOGX[1:] - _XLOGX[:-1]) * 4096).astype(np.int32)
_POPCOUNT = np.bitwise_count


def _occurrences(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, how often its value stands in the width-1 bytes before, and after, it."""
    n = len(data)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (2 * n + 2 * width) + order
    rank = np.arange(n)
    before, after = np.empty(n, np.int8), np.empty(n, np.int8)
    before[order] = rank - np.searchsorted(key, key - (width - 1), "left")
    after[order] = np.searchsorted(key, key + (width - 1), "right") - 1 - rank
    return before, after


def window_ranks(data: np.ndarray) -> np.ndarray:
    """Rank of each window (lower: rarer); 2**15 for filler windows."""
    n = len(data) - WINDOW + 1
    before, after = _occurrences(data, WINDOW)
    total = np.zeros(len(data) + 1, np.int64)
    # The sum of c*log2(c) of a window grows by GAIN[count before] for its next byte and
    # shrinks by GAIN[count after] for the byte that leaves; both counts are within the window.
    first = np.bincount(data[:WINDOW], minlength=256)
    start = int(np.rint(_XLOGX[first] * 4096).sum())
    grow = _GAIN[np.minimum(before[WINDOW:], WINDOW - 1)].astype(np.int64)
    shrink = _GAIN[np.minimum(after[: n - 1], WINDOW - 1)].astype(np.int64)
    total = start + np.concatenate(([0], np.cumsum(grow - shrink)))
    entropy = np.log2(WINDOW) - total / (4096.0 * WINDOW)
    off = np.abs(entropy - TYPICAL_ENTROPY) / TYPICAL_SPREAD
    rank = np.rint(8192 * np.exp(-0.5 * off * off)).astype(np.int64)
    rank[entropy < LEAST_ENTROPY] = 1 << 15
    return rank


#: Longer texts are walked in pieces of so many bytes, at fixed places, so that memory is bounded.
PIECE = 1 << 20


def features(text: bytes) -> np.ndarray:
    """Hashes of the features of one text, in text order; none for an empty text only."""
    chosen = _selected(text)
    if len(chosen) or not text:
        return chosen
    width = min(SHORT, len(text))
    return tk.mix(tk.RollingHash(np.frombuffer(text, np.uint8)).windows(width) + _U64(width))


def _selected(text: bytes) -> np.ndarray:
    if len(text) > PIECE + MIN_WINDOWS + WINDOW:
        last = len(text) - MIN_WINDOWS - WINDOW
        starts = range(0, max(1, last), PIECE)
        ends = [*(a + PIECE + WINDOW - 1 for a in starts[:-1]), len(text)]
        return np.concatenate([_selected(text[a:b]) for a, b in zip(starts, ends, strict=True)])
    data = np.frombuffer(text, np.uint8)
    count = len(data) - WINDOW + 1
    if count < MIN_WINDOWS:
        return np.zeros(0, _U64)
    roll = tk.RollingHash(data)
    rank = window_ranks(data)
    keyed = (rank << 40) | np.arange(count)
    best = tk.sliding_min(keyed, NEIGHBOURS) & ((1 << 40) - 1)
    votes = np.bincount(best, minlength=count)
    chosen = np.flatnonzero((votes >= VOTES) & (rank < 1 << 15))
    return tk.mix(roll.spans(chosen, chosen + WINDOW))


def digest(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Chain of Bloom filters (k x BITS/64 words) and the features in each."""
    f = features(text)
    f = f[np.sort(np.unique(f, return_index=True)[1])]
    chain = max(1, -(-len(f) // FEATURES))
    bits = np.zeros(chain * BITS, bool)
    at = (np.arange(len(f)) // FEATURES) * BITS
    for i in range(HASHES):
        bits[at + ((f >> _U64(11 * i)) & _U64(BITS - 1)).astype(np.int64)] = True
    counts = np.bincount(np.arange(len(f)) // FEATURES, minlength=chain)
    return np.packbits(bits).view(_U64).reshape(chain, BITS // 64), counts


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Normalised bit overlap of two digests, 0 to 1; empty digests are alike only to each other."""
    if not a[1].sum() or not b[1].sum():
        return float(a[1].sum() == b[1].sum())
    if len(a[1]) > len(b[1]):
        a, b = b, a
    size_a = _POPCOUNT(a[0]).sum(axis=1).astype(float)
    size_b = _POPCOUNT(b[0]).sum(axis=1).astype(float)
    best = np.zeros(len(a[1]))
    for i in range(len(a[1])):
        common = _POPCOUNT(a[0][i] & b[0]).sum(axis=1)
        chance = size_a[i] * size_b / BITS
        most = np.minimum(size_a[i], size_b)
        best[i] = np.max(np.clip((common - chance) / np.maximum(most - chance, 1.0), 0, 1))
    return float(np.sum(best * a[1]) / np.sum(a[1]))


def to_string(d: tuple[np.ndarray, np.ndarray]) -> str:
    """Text form of a digest: features of each filter, then the filters, base 64."""
    return f"{'.'.join(map(str, d[1].tolist()))}:{base64.b64encode(d[0].tobytes()).decode()}"


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every text; null text is empty. One narrow stage."""

    def fn(rows, data, offsets):
        out = [to_string(digest(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(rows.num_rows)]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(out)], names=["id", "n_chars", "fingerprint"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return frames.map_texts(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars")), "text", fn, "id long, n_chars long, fingerprint string")


def edited_text(text: str, following: str) -> str:
    """The last third of a text replaced by as many first code points of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Texts of one range of the ordered walk, where that makes no more ranges than MOST_RANGES.
RANGE_ROWS, MOST_RANGES = 2000, 20_000
RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows that are made of one row of many equal ones by one task.
COPIES = 4096
#: Order of the walk: the id (null: the smallest), whether there is one, the hash of the text.
KEY = ["rid", "has", "th"]


def _keys(*columns) -> np.ndarray:
    out = np.empty(len(columns[0]), np.dtype([(c, np.int64) for c in KEY]))
    for name, values in zip(KEY, columns, strict=True):
        out[name] = values
    return out


def range_heads(keys: DataFrame, rows_per_range: int) -> tuple[np.ndarray, bool]:
    """The greatest key of each range, ascending, and whether any key has several rows.

    Only the keys are dealt out and sorted, by sampled quantiles, so the ranges
    hold as many keys whatever the ids are; the driver gets MOST_RANGES keys at
    most, and one for each partition.
    """
    total = keys.count()
    each = max(rows_per_range, -(-total // MOST_RANGES))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, several = 0, None, False
        for rows in batches:
            if not rows.num_rows:
                continue
            several |= bool((rows.column(len(KEY)).to_numpy() > 1).any())
            own = pa.array(np.arange((each - 1 - at) % each, rows.num_rows, each))
            yield pa.RecordBatch.from_arrays([*(rows.column(i).take(own) for i in range(len(KEY))), pa.array(np.zeros(len(own), bool))], names=[*KEY, "several"])
            at += rows.num_rows
            last = [rows.column(i).slice(rows.num_rows - 1) for i in range(len(KEY))]
        if last:
            yield pa.RecordBatch.from_arrays([*last, pa.array([several])], names=[*KEY, "several"])

    parts = max(1, min(total // (4 * each), MOST_RANGES // 4))
    ordered = keys.repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY)
    heads = ordered.mapInArrow(cuts, ", ".join(f"{c} long" for c in KEY) + ", several boolean").collect()
    cut = np.unique(_keys(*(np.array([r[c] for r in heads], np.int64) for c in KEY)))
    return cut, any(r["several"] for r in heads)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Fingerprint each text, its edited form and the next text, in descending id order.

    Texts are dealt out by ranges of (id, text hash) with equally many texts in
    each and walked in order; the first text of each range also goes to the end
    of the range before it, so neighbours meet with one shuffle of the texts.
    Rows with the same id are ordered by a hash of their text, null ids come
    last; the row after the last is the first.  Rows equal in both are walked
    once: all but the last of them are followed by the same text.
    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next); an empty table gives an empty result and a single
    row is followed by itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    none = F.col("id").isNull()
    placed = base.withColumns({"rid": F.when(none, F.lit(-(2**63))).otherwise(F.col("id")), "has": F.when(none, F.lit(0)).otherwise(F.lit(1)).cast("long"), "th": F.xxhash64("text")})
    keys = frames.settled(placed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")))
    cut, several = range_heads(keys, rows_per_range)
    if not len(cut):
        return docs.sparkSession.createDataFrame([], RESULT)
    if several:
        again = keys.where("copies > 1")
        first = placed.join(again, KEY).groupBy(*KEY, "copies").agg(F.first("id").alias("id"), F.first("text").alias("text"))
        placed = placed.join(again, KEY, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(first)
    else:
        placed = placed.withColumn("copies", F.lit(1).cast("long"))
        frames.forget(keys)

    @F.pandas_udf("at int, head boolean")
    def range_of(rid: pd.Series, has: pd.Series, th: pd.Series) -> pd.DataFrame:
        key = _keys(rid.to_numpy(), has.to_numpy(), th.to_numpy())
        at = np.searchsorted(cut, key)  # the first range whose greatest key is not below the key
        return pd.DataFrame({"at": at.astype(np.int32), "head": cut[at] == key})

    n = len(cut)
    known = placed.withColumn("place", range_of(*KEY))
    to = lambda at, guard: F.struct(at.cast("int").alias("at"), F.lit(guard).alias("guard"))
    at = F.col("place.at")
    # Descending: the next text of a range's last one is the head of the range below; the lowest is followed by the highest.
    twice = known.withColumn("goes", F.explode(F.when(F.col("place.head"), F.array(to(at, 0), to((at + 1) % n, 1))).otherwise(F.array(to(at, 0)))))
    dealt = twice.select(F.col("goes.at").alias("at"), F.col("goes.guard").alias("guard"), "id", *KEY, "copies", "text", F.char_length("text").cast("long").alias("n_chars"))
    walk = dealt.repartition(F.col("at")).sortWithinPartitions(F.col("at"), F.col("guard"), *(F.col(c).desc() for c in KEY)).select("at", "guard", "id", "n_chars", "text", "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its next text
        out = []

        def close(row, raw, own, times):
            _, id_, n, text, d, _ = row
            edited = edited_text(text.decode(), raw.decode()).encode()
            e = digest(edited) if edited != text else d
            return (id_, n, hashlib.sha256(edited).hexdigest(), to_string(d), to_string(e), likeness(d, e), likeness(d, own), times)

        for batch in batches:
            for i in range(batch.num_rows):
                at, guard = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                raw = batch.column(4)[i].as_py().encode()
                own = digest(raw)
                if last is not None and last[0] == at:
                    out.append(close(last, raw, own, 1))
                last = None
                if not guard:
                    last = (at, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), raw, own, None)
                    copies = batch.column(5)[i].as_py()
                    if copies > 1:
                        out.append(close(last, raw, own, copies - 1))
                if len(out) >= 256:
                    yield _result(out)
                    out = []
        if out:
            yield _result(out)

    found = walk.mapInArrow(run, f"{RESULT}, times long")
    if several:
        part = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {COPIES}"))))
        part = part.repartition("id", "fingerprint", "part")
        found = part.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES))))
    return found.select(*[c.split()[0] for c in RESULT.split(", ")])


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "times"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
