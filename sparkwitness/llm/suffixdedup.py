"""Operator 1: removal of byte strings that occur again, by depth-limited radix passes.

All suffixes are ordered through ``threshold`` bytes only: two suffixes are in
one group when their first ``threshold`` bytes are equal, and a group of more
than one is a repeated window.  The passes are most significant digit first and
a suffix leaves as soon as its group is settled:

1. The first digit of a suffix is the ``gram`` bytes at its window's anchor,
   the smallest gram hash in the window (the leftmost of equal ones).  It is a
   function of the window alone, so equal windows share it, and a run of
   consecutive suffixes has one anchor, so that one row stands for about half
   of ``threshold - gram`` suffixes.  An anchor that occurs once ends its run:
   none of its windows repeats.
2. The second digit is the whole span of a run.  Runs with equal anchor and
   span are equal to full depth and are settled as repeated, all of them.
3. What is left are runs at the edge of a repeated passage, in groups of
   unequal spans.  Their suffixes, with one representative of each settled
   span of the group, are told apart one by one by the remaining digit, the
   window of ``threshold`` bytes.

Digits are compared by 64-bit hashes.  In pass 3 a false match needs the same
hash of two different windows among the candidates only: for n of them the
probability is below n*n/2**65.  A hot passage is counted by partial
aggregation before each shuffle, and the tables of counts are written before
they are joined back, so that adaptive execution can split a hot passage's rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textkernel as tk

#: Bytes that make a repeated string.
THRESHOLD = 400
#: Bytes of the anchor gram, as a share of the threshold.
GRAM_SHARE = 0.6

_U64 = np.uint64


def _gram(threshold: int) -> int:
    return max(1, int(threshold * GRAM_SHARE))


def _merged(row: np.ndarray, lo: np.ndarray, count: np.ndarray, anchor: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring equal runs as one row: (row, first suffix, suffixes of all, anchor, span, suffixes of one, runs).

    A text of one repeated character or pattern is so a few rows, not one for each byte.
    """
    same = (row[1:] == row[:-1]) & (anchor[1:] == anchor[:-1]) & (span[1:] == span[:-1]) & (count[1:] == count[:-1]) & (lo[1:] == lo[:-1] + count[:-1])
    first = np.concatenate(([0], np.flatnonzero(~same) + 1)) if len(row) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((first, [len(row)]))).astype(np.int64)
    return row[first], lo[first], count[first] * times, anchor[first], span[first], count[first], times


def runs(data: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(row, first suffix in its text, suffixes, anchor hash, span hash) of each run of a chunk."""
    gram = _gram(threshold)
    width = threshold - gram + 1
    total = len(data) - threshold + 1
    none = np.zeros(0, np.int64)
    if total <= 0:
        return none, none, none, none.astype(_U64), none.astype(_U64)
    roll = tk.RollingHash(data)
    gram_hash = tk.mix(roll.windows(gram))
    bits = _U64(max(1, int(len(gram_hash)).bit_length()))
    low = (_U64(1) << bits) - _U64(1)
    ranked = (gram_hash & ~low) | np.arange(len(gram_hash), dtype=_U64)
    anchor = (tk.sliding_min(ranked, width) & low).astype(np.int64)
    start = np.arange(total)
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + threshold <= offsets[row + 1]
    start, anchor, row = start[inside], anchor[inside], row[inside]
    if not len(start):
        return none, none, none, none.astype(_U64), none.astype(_U64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    first = np.concatenate(([0], cut))
    count = np.diff(np.concatenate((first, [len(start)])))
    lo = start[first]
    span = tk.mix(roll.spans(lo, lo + count + threshold - 1) + count.astype(_U64))
    return row[first], lo - offsets[row[first]], count, gram_hash[anchor[first]], span


#: A longer text is cut into pieces of so many suffixes; a run that a cut divides is told apart in pass 3.
SEGMENT = 1 << 21


def _segmented_runs(data: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    if len(data) <= SEGMENT + threshold or len(offsets) != 2:
        return runs(data, offsets, threshold)
    parts = []
    for a in range(0, len(data) - threshold + 1, SEGMENT):
        piece = data[a : a + SEGMENT + threshold - 1]
        row, lo, *rest = runs(piece, np.array([0, len(piece)]), threshold)
        parts.append((row, lo + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def repeated_runs(keyed: DataFrame, threshold: int) -> DataFrame:
    """Passes 1 and 2: (rid, th, settled, edge), arrays of (start, count) for each text with any.

    ``settled`` runs are repeated whole; ``edge`` runs go to pass 3, among them
    one representative of each settled span of a group that has edge runs.
    """

    def fn(rows, data, offsets):
        row, lo, count, anchor, span, one, times = _merged(*_segmented_runs(data, offsets, threshold))
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(frames.signed(anchor)), pa.array(frames.signed(span)), _column(rows, "rid").take(take), _column(rows, "th").take(take), *(pa.array(x.astype(np.int64)) for x in (lo, count, one, times))],
            names=["anchor", "span", "rid", "th", "start", "n", "one", "times"],
        )

    found = frames.map_texts(keyed.select("rid", "th", "text"), "text", fn, "anchor long, span long, rid long, th long, start long, n long, one long, times long")
    # Pass 1: anchors that occur more than once.
    again = frames.settled(found.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor"))
    left = frames.settled(found.join(again, "anchor", "left_semi"))
    # Pass 2: spans within those groups.
    spans = left.groupBy("anchor", "span").agg(F.sum("times").alias("c"), F.min(F.struct("rid", "th", "start")).alias("rep"))
    several = left.groupBy("anchor").agg(F.min("span").alias("low"), F.max("span").alias("high")).where("low < high")
    mixed = frames.settled(several.select("anchor", F.lit(True).alias("mixed")))
    status = frames.settled(spans.join(mixed, "anchor", "left"))
    open_runs = left.join(status, ["anchor", "span"])
    settled = F.col("c") > 1
    is_rep = F.struct("rid", "th", "start") == F.col("rep")
    edge = F.col("mixed").isNotNull() & (~settled | is_rep)
    kept = open_runs.select("rid", "th", "start", "n", "one", settled.alias("settled"), edge.alias("edge")).where("settled or edge")
    # Of merged runs the first one stands for the others in pass 3.
    per_text = kept.groupBy("rid", "th").agg(
        F.array_sort(F.collect_set(F.when(F.col("settled"), F.struct("start", "n")))).alias("settled"),
        F.array_sort(F.collect_set(F.when(F.col("edge"), F.struct("start", F.col("one").alias("n"))))).alias("edge"),
    )
    out = frames.settled(per_text)
    frames.forget(again, left, mixed, status)
    return out


def _lists(cell: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each row's values; both 0 for null."""
    cut = cell.offsets.to_numpy()
    use = cell.is_valid().to_numpy(zero_copy_only=False)
    return np.where(use, cut[:-1], 0), np.where(use, cut[1:], 0)


def _run_fields(cell: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(cell.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))


def edge_windows(marked: DataFrame, threshold: int) -> DataFrame:
    """Pass 3: (window, rid, th, start) of every suffix of the edge runs."""

    def fn(rows, data, offsets):
        edge = _column(rows, "edge")
        roll = tk.RollingHash(data)
        at, owner = [], []
        first, last = _lists(edge)
        starts, counts = _run_fields(edge)
        for i in range(rows.num_rows):
            start, n = starts[first[i] : last[i]], counts[first[i] : last[i]]
            if len(start):
                own = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                at.append(own + offsets[i])
                owner.append(np.full(len(own), i))
        if not at:
            return None
        at, owner = np.concatenate(at), np.concatenate(owner)
        window = tk.mix(roll.spans(at, at + threshold))
        take = pa.array(owner)
        return pa.RecordBatch.from_arrays(
            [pa.array(frames.signed(window)), _column(rows, "rid").take(take), _column(rows, "th").take(take), pa.array((at - offsets[owner]).astype(np.int32))],
            names=["window", "rid", "th", "start"],
        )

    texts = marked.where("edge is not null and size(edge) > 0").select("rid", "th", "edge", "text")
    return frames.map_texts(texts, "text", fn, "window long, rid long, th long, start int")


def _covered(length: int, pieces: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Mask of the bytes covered by [start, start + size) of all pieces."""
    edge = np.zeros(length + 1, np.int32)
    for start, size in pieces:
        np.add.at(edge, start, 1)
        np.add.at(edge, start + size, -1)
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Remove every byte covered by a ``threshold``-byte string that also starts elsewhere.

    Matches are judged on the input, may overlap, and lie within one text or in
    two.  Returns (id, n_bytes, n_removed, n_spans, kept_sha256, kept,
    spans): one row for each input row; ``kept`` is the remaining bytes,
    ``spans`` the removed [start, end) byte ranges; ``kept_text`` makes a text
    of the bytes.  Null text is empty; texts
    shorter than the threshold keep all; repeated rows are two documents that
    repeat each other; null ids are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    keyed = base.withColumn("rid", F.coalesce("id", F.lit(-(2**63)))).withColumn("th", F.xxhash64("text"))
    per_text = repeated_runs(keyed, threshold)
    dealt = keyed.repartition("rid", "th")
    unique = dealt.join(per_text.where("size(edge) > 0").select("rid", "th", "edge"), ["rid", "th"])
    windows = frames.settled(edge_windows(unique, threshold))
    again = frames.settled(windows.groupBy("window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("window"))
    starts = windows.join(again, "window", "left_semi").groupBy("rid", "th").agg(F.collect_list("start").alias("single"))
    marks = frames.settled(per_text.select("rid", "th", "settled").join(starts, ["rid", "th"], "full_outer"))
    frames.forget(per_text, windows, again)
    final = dealt.join(marks, ["rid", "th"], "left")

    def fn(rows, data, offsets):
        settled, single, texts = _column(rows, "settled"), _column(rows, "single"), []
        out = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "spans")}
        first, last = _lists(settled)
        starts, counts = _run_fields(settled)
        first1, last1 = _lists(single)
        singles = single.values.to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(rows.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            pieces = []
            if last[i] > first[i]:
                pieces.append((starts[first[i] : last[i]], counts[first[i] : last[i]] + threshold - 1))
            if last1[i] > first1[i]:
                start = singles[first1[i] : last1[i]]
                pieces.append((start, np.full(len(start), threshold)))
            if pieces:
                gone = _covered(len(own), pieces)
                rim = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                kept = own[~gone].tobytes()
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(len(rim) // 2)
                out["spans"].append(rim.tolist())
            else:
                kept = own.tobytes()
                out["n_removed"].append(0)
                out["n_spans"].append(0)
                out["spans"].append([])
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        return pa.RecordBatch.from_arrays(
            [_column(rows, "id"), pa.array(np.diff(offsets)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(texts, pa.binary()), pa.array(out["spans"], pa.list_(pa.int64()))],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
        )

    return frames.map_texts(final.select("id", "text", "settled", "single"), "text", fn, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<long>")


def kept_text(kept: Column | str) -> Column:
    """Text of remaining bytes; a character of which bytes were removed is U+FFFD."""
    return F.make_valid_utf8(F.col(kept).cast("string") if isinstance(kept, str) else kept.cast("string"))
