"""Operator 8: Jaccard self-join of word-shingle sets by parity sketches.

A set of n shingles is folded into s segments; every shingle XORs its hash into
the segment that its leading bits name.  A shingle that only one of two sets
has changes one segment, so the number of segments in which two sketches differ
is a lower bound of the symmetric difference.  Sets with a Jaccard similarity
of at least t and sizes a, b differ in at most (a + b)(1 - t)/(1 + t) shingles;
where s is greater than that, plus the segments of fewer than two shingles, some segment
of two or more agrees (pigeonhole); a set that spreads too thinly for this joins
on its thin segments too, and on its empty ones if it must.  Sets are banded by a + b, every set joins the one or two
bands that its possible partners allow, and (band, segment, content) is the
join key.  Nothing is sampled and no bucket is capped.

Candidates are not expanded into pairs: each key links its sets to its smallest
one, which gives candidate classes.  A class of one block of bounded sets and
bytes is verified by exact intersection counts of its shingle sets.  A larger
class is cut by size, as sets whose sizes differ too much cannot be linked, and
all its sets are verified against those of one block, which joins a large group
of near copies with about two moves of each set.  Where sets stay apart, such
as the pages of one template, the sets that share a rare shingle, as linked
ones do, are held against each other by size and by bit sketches, in which
every shingle flips one bit, and only those that may be linked are verified.
No class is taken over the hits of several shingles.  Sets without enough
shingles of their own for that, and apart from the largest component of their
group, meet the others of their kind block by block, by sketches too.  Equal sets are one node
throughout, so exact copies cost nothing.

Sets are named by a 64-bit signature; for n different sets the probability
that two share one is below n*n/2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames
from . import textkernel as tk

#: Bands grow by this factor in a + b.
BAND_GROWTH = 1.6
#: Segments for each shingle of the allowed difference (room for thin ones).
SPARE = 1.13
#: Largest block of a class: sets and bytes.
BLOCK_SETS = 512
BLOCK_BYTES = 4 << 20
#: Shingles that more sets of large classes hold are ordered behind the others, by their count.
COMMON = 64
#: So many of them are broadcast, 16 bytes each; beyond, they are joined.
MOST_COMMON = 1 << 20
#: Words of 64 bits that mark wanted texts, one for four of them, are at most so many (16 bytes each are broadcast).
MARK_WORDS = 1 << 20

_U64 = np.uint64


def signature(s: np.ndarray) -> int:
    """64-bit name of a set, as a signed integer."""
    h = tk.mix(tk.mix(s) + _U64(0xA0761D6478BD642F))
    total = int(np.add.reduce(h, dtype=_U64)) ^ (len(s) * 0x9E3779B97F4A7C15)
    return int(np.int64(np.uint64(total & ((1 << 64) - 1))))


def _bands(n: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(band, allowed difference, segments) of a set of n shingles, for all sizes a partner can have."""
    t = num / den
    low, high = n + math.ceil(n * t - 1e-9), n + math.floor(n / t + 1e-9)
    first = math.floor(math.log(low, BAND_GROWTH) - 1e-12)
    last = math.floor(math.log(high, BAND_GROWTH) + 1e-12)
    out = []
    for band in range(first, last + 1):
        most = math.ceil(BAND_GROWTH ** (band + 1))
        differ = min(most, high) * (den - num) // (den + num)  # of this set and any partner in the band
        out.append((band, differ, math.ceil(most * (den - num) // (den + num) * SPARE) + 2))
    return out


def segment_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of one sorted set of shingle hashes."""
    if not len(s):
        return s
    keys = []
    words = tk.mix(s ^ _U64(0x5851F42D4C957F2D))
    for band, differ, segments in _bands(len(s), num, den):
        index = ((s >> _U64(32)) * _U64(segments)) >> _U64(32)
        first = np.concatenate(([0], np.flatnonzero(index[1:] != index[:-1]) + 1))
        content = np.bitwise_xor.reduceat(words, first)
        name = index[first]
        full = np.diff(np.concatenate((first, [len(s)]))) > 1
        if full.sum() > differ:  # else all of these may differ, and thinner segments join too
            content, name = content[full], name[full]
        elif len(first) <= differ:
            empty = np.setdiff1d(np.arange(segments, dtype=_U64), name, assume_unique=True)
            name = np.concatenate((name, empty))
            content = np.concatenate((content, np.zeros(len(empty), _U64)))
        salt = _U64((band * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        keys.append(tk.mix(content + tk.mix((name + _U64(1)) * _U64(0xD6E8FEB86659FD93) + salt)))
    return np.concatenate(keys)


def _named_sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, k: int):
    sets = tk.shingle_sets(data, offsets, k)
    return sets, [signature(s) for s in sets]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and th, a hash that tells apart texts under one id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def set_names(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, th, n_shingles, sig) of every row."""

    def fn(rows, data, offsets):
        sets, names = _named_sets(rows, data, offsets, k)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64())],
            names=["id", "th", "n_shingles", "sig"],
        )

    return frames.map_texts(_keyed(docs, id_col, text_col), "text", fn, "id long, th long, n_shingles long, sig long")


#: A task's keys are combined whenever it has so many.
KEYS_HELD = 1 << 18


def _combined(keys: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
    """(key, sig) rows that link the same sets: one row for each key, and a key of its own for each pair of a set and the smallest one of its key."""
    order = np.lexsort((sigs, keys))
    keys, sigs = keys[order], sigs[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    low = sigs[first][np.cumsum(first) - 1]
    other = sigs != low
    name, at = np.unique(tk.mix(tk.mix(sigs[other].view(_U64)) + low[other].view(_U64)), return_index=True)
    key = np.concatenate((keys[first], name, name))
    sig = np.concatenate((sigs[first], sigs[other][at], low[other][at]))
    order = np.argsort(sig, kind="stable")  # rows of one set lie together, which packs well
    return pa.RecordBatch.from_arrays([pa.array(frames.signed(key[order])), pa.array(sig[order])], names=["key", "sig"])


def candidate_keys(docs: DataFrame, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(key, sig) for every segment of every set, combined in each task.

    A set that a third of all rows share, and a key that a third of all sets
    share, so enter the shuffle a few times for each input partition and not
    once for each row or set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, sigs, held = [], [], 0
        for rows, data, offsets in frames.text_chunks(batches, "text"):
            sets, names = _named_sets(rows, data, offsets, k)
            for s, name in zip(sets, names, strict=True):
                if name not in seen:
                    seen.add(name)
                    keys.append(segment_keys(s, num, den))
                    sigs.append(np.full(len(keys[-1]), name, np.int64))
                    held += len(keys[-1])
            if held > KEYS_HELD:
                yield _combined(np.concatenate(keys), np.concatenate(sigs))
                keys, sigs, held = [], [], 0
        if held:
            yield _combined(np.concatenate(keys), np.concatenate(sigs))

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key long, sig long")


def star_edges(keys: DataFrame) -> DataFrame:
    """Each set of a key with the key's smallest set (a, b), without repeats."""
    ordered = Window.partitionBy("key").orderBy("sig").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = keys.withColumn("low", F.first("sig").over(ordered))  # runs along the sorted rows, holds none
    return low.where("sig > low").select(F.col("sig").alias("a"), F.col("low").alias("b")).distinct()


def _links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs (i of left, j of right, i != j)."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    token = np.cumsum(new) - 1
    shared = np.bincount(token)[token] > 1  # a shingle of one set only adds to no intersection
    token, owner = token[shared], owner[shared]
    common = np.zeros((len(left), len(right)), np.float32)
    at_left = np.full(len(sets), -1)
    at_left[left] = np.arange(len(left))
    at_right = np.full(len(sets), -1)
    at_right[right] = np.arange(len(right))
    cut = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)])) if len(token) else np.zeros(1, int)
    step = 4096
    for a in range(0, len(cut) - 1, step):
        b = min(a + step, len(cut) - 1)
        t, o = token[cut[a] : cut[b]], owner[cut[a] : cut[b]]
        column = np.concatenate(([0], np.cumsum(t[1:] != t[:-1])))
        x = np.zeros((len(left), b - a), np.float32)
        y = np.zeros((len(right), b - a), np.float32)
        use = at_left[o] >= 0
        x[at_left[o[use]], column[use]] = 1
        use = at_right[o] >= 0
        y[at_right[o[use]], column[use]] = 1
        common += x @ y.T
    union = size[left][:, None] + size[right][None, :] - common
    hit_i, hit_j = np.nonzero((den * common >= num * union) & (left[:, None] != right[None, :]))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(left[hit_i].tolist(), right[hit_j].tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[p] = q
            out.append((i, j))
    return out


#: What a set is in a comparison: on its left side, on its right side, or on both.
LEFT, RIGHT, BOTH = 1, 2, 3


def compared(placed: DataFrame, groups: list[str], num: int, den: int) -> DataFrame:
    """Links (a, b) of the left and right sets (sig, side, shingles) of each group, a spanning forest of each."""

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, first, back = np.unique(table.column("sig").to_numpy(), return_index=True, return_inverse=True)
        side = np.zeros(len(name), np.int64)  # a repeated row is one set
        np.bitwise_or.at(side, back, table.column("side").to_numpy().astype(np.int64))
        blobs = table.column("shingles")
        sets = [np.frombuffer(blobs[int(i)].as_py(), _U64) for i in first]
        left, right = np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT)
        found = _links(sets, left, right, num, den) if len(left) and len(right) and len(name) > 1 else []
        return pa.table({"a": pa.array([name[i] for i, _ in found], pa.int64()), "b": pa.array([name[j] for _, j in found], pa.int64())})

    return placed.select(*groups, "sig", "side", "shingles").groupBy(*groups).applyInArrow(link, "a long, b long")


def likely_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (id, th) may be in ``wanted``: all that are, and about one in sixteen of the others.

    Every wanted row sets one bit of a table that is broadcast by words.  Beyond
    ``MARK_WORDS`` more of the others pass; none that is wanted is lost.
    """
    words = min(MARK_WORDS, wanted.count() // 4 + 1)
    place = F.pmod(F.xxhash64("id", "th"), F.lit(64 * words).cast("long"))
    bit = place.bitwiseAND(63).cast("int")
    marks = wanted.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", F.shiftright(place, 6)).join(F.broadcast(marks), "word").where(F.getbit("bits", bit) == 1).drop("word", "bits")


def held_sets(docs: DataFrame, names: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(sig, class, n, shingles): the shingles of every set of a candidate class, once for each task that meets it.

    A set's text is fetched by the id and text hash of one of its rows; by the
    hash alone where all its rows have a null id.  Only texts of ``likely_rows``
    are shuffled for that, in the same way at every size.
    """
    row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th"))
    one = names.where("n_shingles > 0").groupBy("sig").agg(row.alias("row")).select("sig", "row.id", "row.th")
    wanted = frames.settled(classes.select(F.col("node").alias("sig"), F.col("component").alias("class")).join(one, "sig"))
    rows = likely_rows(_keyed(docs, id_col, text_col), wanted)
    # One row for each text under a null id, whatever the number of its copies.
    unnamed = rows.where("id is null").groupBy("th").agg(F.first("text").alias("text")).join(wanted.where("id is null").drop("id"), "th")
    texts = rows.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("sig", "class", "text").unionByName(unnamed.select("sig", "class", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, offsets in frames.text_chunks(batches, "text"):
            sets, found = _named_sets(rows, data, offsets, k)
            sigs, at = rows.column(0).to_pylist(), []
            for i, (sig, name) in enumerate(zip(sigs, found, strict=True)):
                if sig == name and sig not in seen:
                    seen.add(sig)
                    at.append(i)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array([len(sets[i]) for i in at], pa.int64()), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["sig", "class", "n", "shingles"])

    held = frames.settled(texts.mapInArrow(run, "sig long, class long, n long, shingles binary"))
    frames.forget(wanted)
    return held


def _blobs(rows: pa.RecordBatch) -> list[np.ndarray]:
    cell = rows.column(rows.schema.get_field_index("shingles"))
    return [np.frombuffer(x.as_buffer(), _U64) for x in cell]


def rare_keys(large: DataFrame, num: int, den: int) -> DataFrame:
    """(key, sig, common): the shingles of each set of large classes by which its links can be found.

    Two sets of at least the similarity share one of the n - ceil(n * num / den)
    + 1 shingles of each that come first in any one order of all shingles.  Here
    those of few sets come first, then the others by their number of sets, so
    that what a page template gives to all its pages is a key of none of them.
    A key of few sets is a row; a set with keys of more than ``COMMON`` sets has
    one row for all of these, marked so.  Every step moves each shingle of a
    large class a bounded number of times.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                shingle, c = np.unique(np.concatenate(_blobs(rows)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(frames.signed(shingle)), pa.array(c.astype(np.int64))], names=["shingle", "c"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                sets = _blobs(rows)
                sig = np.repeat(rows.column(0).to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(frames.signed(np.concatenate(sets))), pa.array(sig)], names=["shingle", "sig"])

    counts = large.select("shingles").mapInArrow(counted, "shingle long, c long")
    common = frames.settled(counts.groupBy("shingle").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON))
    sets = large.select("sig", "class", "shingles")
    known = None
    if common.count() <= MOST_COMMON:
        table = common.toArrow()
        name, c = table.column("shingle").to_numpy().view(_U64), table.column("c").to_numpy()
        order = np.argsort(name)
        known = large.sparkSession.sparkContext.broadcast((name[order], c[order]))
        marked = sets.withColumn("common", F.lit(None))
    else:
        have = large.select("sig", "shingles").mapInArrow(spread, "shingle long, sig long").join(common, "shingle")
        marked = sets.join(have.groupBy("sig").agg(F.collect_set(F.struct("shingle", "c")).alias("common")), "sig", "left")  # of one set each

    def counts_of(s: np.ndarray, own: list | None) -> np.ndarray:
        out = np.zeros(len(s), np.int64)
        if known is None:
            for x in own or ():
                out[np.searchsorted(s, np.uint64(x["shingle"] & ((1 << 64) - 1)))] = x["c"]
        elif len(known.value[0]):
            name, c = known.value
            at = np.minimum(np.searchsorted(name, s), len(name) - 1)
            out = np.where(name[at] == s, c[at], 0)
        return out

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, sigs, shared = [], [], []
            for i, s in enumerate(_blobs(rows)):
                c = counts_of(s, rows.column(3)[i].as_py())
                first = np.lexsort((s, c))[: len(s) - -(-len(s) * num // den) + 1]
                rare = first[c[first] == 0]
                salt = tk.mix(np.array([rows.column(1)[i].as_py()], np.int64).view(_U64))
                more = int(len(rare) < len(first))
                keys.append(np.concatenate((tk.mix(s[rare] ^ salt), np.zeros(more, _U64))))
                shared.append(np.arange(len(keys[-1])) >= len(rare))
                sigs.append(np.full(len(keys[-1]), rows.column(0)[i].as_py(), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(frames.signed(np.concatenate(keys))), pa.array(np.concatenate(sigs)), pa.array(np.concatenate(shared))], names=["key", "sig", "common"])

    out = frames.settled(marked.mapInArrow(prefixes, "key long, sig long, common boolean"))
    frames.forget(common)
    return out


def rare_groups(keyed: DataFrame) -> DataFrame:
    """(name, sig): the groups of sets that share a key of few sets, at most ``COMMON``.

    Neighbouring shingles are held by the same sets, so a group is one here
    however many keys give it, and a key of one set gives none.
    """
    groups = keyed.where("not common").groupBy("key").agg(F.array_sort(F.collect_set("sig")).alias("sigs")).where("size(sigs) > 1").select("sigs").distinct()
    return groups.select(F.xxhash64("sigs").alias("name"), F.explode("sigs").alias("sig"))


def sketch_bits(n: int, num: int, den: int) -> int:
    """Bits of the sketch of n shingles: a power of two, some times the difference that the largest partner allows."""
    differ = (n + n * den // num) * (den - num) // (den + num)
    return max(256, 1 << (4 * differ).bit_length())


def bit_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """Each shingle flips one bit, so two sketches differ in at most as many bits as the sets in shingles."""
    place = (tk.mix(s ^ _U64(0x2545F4914F6CDD1D)) & _U64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(_U64)


def _near(n: np.ndarray, component: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sets have another one, of another component, that their sizes and sketches allow as a link."""
    words = np.array([len(x) for x in sketches])
    hit = np.zeros(len(n), bool)
    for m in np.unique(words):
        # A sketch of twice the bits folds to the smaller one by XOR of its halves.
        at = np.flatnonzero(words >= m)
        table = np.zeros((len(n), m), _U64)
        for i in at:
            table[i] = np.bitwise_xor.reduce(sketches[i].reshape(-1, m), axis=0)
        here = right[words[right] >= m]
        for i in left[words[left] >= m]:
            j = here if words[i] == m else here[words[here] == m]
            j = j[(component[j] != component[i]) & (n[j] * den >= n[i] * num) & (n[i] * den >= n[j] * num)]
            if len(j):
                apart = np.bitwise_count(table[j] ^ table[i]).sum(axis=1, dtype=np.int64)
                near = j[apart * (den + num) <= (n[j] + n[i]) * (den - num)]
                if len(near):
                    hit[i] = True
                    hit[near] = True
    return hit


def near_groups(placed: DataFrame, groups: list[str], sketches: DataFrame, num: int, den: int) -> DataFrame:
    """(name, sig): of the left and right sets (sig, side) of each group, those that may have a link, in named groups.

    Sets are held against each other by size and by their sketches only.  Groups
    of the same sets have the same name, so that keys that lie side by side give
    one group.
    """

    def find(table: pa.Table) -> pa.Table:
        name, first, back = np.unique(table.column("sig").to_numpy(), return_index=True, return_inverse=True)
        side = np.zeros(len(name), np.int64)
        np.bitwise_or.at(side, back, table.column("side").to_numpy().astype(np.int64))
        n, component = (table.column(c).to_numpy()[first] for c in ("n", "component"))
        blobs = table.column("sketch")
        hit = _near(n, component, [np.frombuffer(blobs[int(i)].as_py(), _U64) for i in first], np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT), num, den)
        sigs = name[hit]
        group = signature(sigs.view(_U64)) if len(sigs) else 0
        return pa.table({"name": pa.array([group] * len(sigs), pa.int64()), "sig": pa.array(sigs, pa.int64())})

    return placed.select(*groups, "sig", "side").join(sketches, "sig").groupBy(*groups).applyInArrow(find, "name long, sig long").distinct()


def second_round(known: DataFrame) -> DataFrame:
    """(sig, class, band, x, y, side): the sets apart, in blocks of their own, meet every block of their group but block 0."""
    group = ["class", "band"]
    left = known.where("apart").groupBy(*group).agg(*_weight()).select(*group, _blocks(F.col("c"), F.col("w")).alias("own"))
    rest = known.join(frames.settled(left), group)
    to = lambda x, y, side: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(side).alias("side"))
    here = F.transform(F.sequence(F.lit(0).cast("long"), F.col("own") - 1), lambda x: to(x, F.col("mine"), RIGHT))
    there = F.transform(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1), lambda y: to(F.pmod(F.xxhash64("sig", F.lit(1)), F.col("own")), y, LEFT))
    return rest.withColumn("way", F.explode(F.when(F.col("apart"), F.concat(here, there)).otherwise(here))).select("sig", *group, "way.x", "way.y", "way.side")


def _in_components(sets: DataFrame, joined: DataFrame) -> DataFrame:
    """Adds the component of each set, its own name where it has none."""
    return sets.join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def rare_links(rest: DataFrame, known: DataFrame, joined: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the sets (sig, class, n, shingles) that ``joined`` leaves in different components.

    Linked sets share a key.  The sets of a rare one, at most ``COMMON``, are
    held against each other by sketches where they are not of one component.
    Sets that can share a common key only are those with few shingles of their
    own: of these the ones apart from their group's largest component meet the
    others by sketches, block by block.  What may be linked is verified: at
    first each set in one of its groups, then the groups that this has not
    joined.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [bit_sketch(s, sketch_bits(len(s), num, den)).tobytes() for s in _blobs(rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.binary())], names=["sig", "n", "sketch"])

    made = rest.select("sig", "n", "shingles").mapInArrow(sketch, "sig long, n long, sketch binary")
    sketches = frames.settled(_in_components(made.groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), joined))
    keyed = rare_keys(rest, num, den)
    shared = frames.settled(rare_groups(keyed).join(sketches.select("sig", "component"), "sig"))
    mixed = frames.settled(shared.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("name"))
    groups = near_groups(shared.join(mixed, "name").withColumn("side", F.lit(BOTH)), ["name"], sketches, num, den)
    thin = frames.settled(known.join(keyed.where("common").select("sig"), "sig", "left_semi"))
    if thin.where("apart").take(1):
        groups = groups.unionByName(near_groups(second_round(thin), ["class", "band", "x", "y"], sketches, num, den)).distinct()
    groups = frames.settled(groups)
    blobs = rest.select("sig", "shingles")
    whole = lambda g: compared(blobs.join(g, "sig").withColumn("side", F.lit(BOTH)), ["name"], num, den)
    links = frames.settled(whole(groups.groupBy("sig").agg(F.min("name").alias("name"))))
    edges = links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    met = frames.settled(_in_components(groups, frames.components(edges)))
    open_ = met.groupBy("name").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("name")
    out = frames.settled(links.unionByName(whole(met.select("name", "sig").join(open_, "name"))))
    frames.forget(sketches, keyed, shared, mixed, thin, groups, links, met)
    return out


def _weight() -> tuple[F.Column, F.Column]:
    return F.count(F.lit(1)).alias("c"), F.sum("n").alias("w")


def _blocks(sets: F.Column, shingles: F.Column) -> F.Column:
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles * 8 / BLOCK_BYTES), F.lit(1)).cast("long")


def in_blocks(members: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, n, class, band, blocks, mine): the groups to compare that each set (sig, n, class) is in, and its block there.

    A class of several blocks is cut by size, as sets whose sizes differ too
    much cannot be linked: a set meets the sets of its own size band, and as a
    smaller one those of the next band.
    """
    spans = frames.settled(members.groupBy("class").agg(*_weight()).where("c > 1").select("class", _blocks(F.col("c"), F.col("w")).alias("all")))
    band = F.floor(F.log(F.col("n")) / math.log(den / num) + 1e-9).cast("int")
    one = F.array(F.struct(F.lit(-1).alias("band"), F.lit(True).alias("own")))
    two = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own")))
    meets = members.join(spans, "class").withColumn("meets", F.explode(F.when(F.col("all") == 1, one).otherwise(two))).select("sig", "n", "class", "meets.band", "meets.own")
    groups = frames.settled(meets.groupBy("class", "band").agg(*_weight(), F.bool_or("own").alias("any")).where("c > 1 and any").select("class", "band", _blocks(F.col("c"), F.col("w")).alias("blocks")))
    out = frames.settled(meets.join(groups, ["class", "band"]).select("sig", "n", "class", "band", "blocks", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("mine")))
    frames.forget(spans, groups)
    return out


def first_round(placed: DataFrame) -> DataFrame:
    """(sig, class, band, x, y, side): the sets of block 0 meet every block, which moves each set about twice."""
    last = F.col("blocks") - 1
    alone = F.array(F.struct(F.col("mine").alias("y"), F.when(F.col("mine") == 0, BOTH).otherwise(RIGHT).alias("side")))
    ways = F.when((F.col("mine") == 0) & (last > 0), F.concat(alone, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1))), lambda y: F.struct(y.alias("y"), F.lit(LEFT).alias("side")))))
    return placed.withColumn("way", F.explode(F.coalesce(ways, alone))).select("sig", "class", "band", F.lit(0).cast("long").alias("x"), "way.y", "way.side")


def sets_apart(placed: DataFrame, joined: DataFrame) -> DataFrame:
    """The sets outside block 0 of the groups of several blocks, each with whether it is apart from its group's largest component.

    Sets of one component need no comparison with each other, and those of block
    0 have met all others; where block 0 has linked a group of near copies, no set is apart.
    """
    group = ["class", "band"]
    several = placed.where("blocks > 1").join(joined.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    main = several.groupBy(*group, "component").agg(F.count(F.lit(1)).alias("c")).groupBy(*group).agg(F.max(F.struct("c", "component")).alias("main"))
    known = several.join(main.select(*group, F.col("main.component").alias("main")), group).where("mine > 0").withColumn("apart", F.col("component") != F.col("main"))
    return frames.settled(known.drop("component", "main"))


def large_links(large: DataFrame, num: int, den: int) -> DataFrame:
    """Links of the sets (sig, class, n, shingles) of classes of several blocks.

    The first round joins groups of near copies.  The classes in which sets are
    still apart, such as the pages of one template, are left to their rare keys.
    """
    key = ["class", "band", "x", "y"]
    placed = in_blocks(large.select("sig", "n", "class").distinct(), num, den)
    links = frames.settled(compared(large.select("sig", "shingles").join(first_round(placed), "sig"), key, num, den))
    joined = frames.settled(frames.components(links))
    known = sets_apart(placed, joined)
    still = frames.settled(known.where("apart").select("class").distinct())
    if still.take(1):
        more = frames.settled(links.unionByName(rare_links(large.join(still, "class"), known.join(still, "class"), joined, num, den)))
        frames.forget(links)
        links = more
    frames.forget(placed, joined, known, still)
    return links


def verified_links(docs: DataFrame, names: DataFrame, classes: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of one candidate class that join all linked sets.

    A class of one block is compared whole, larger ones by ``large_links``.
    """
    held = held_sets(docs, names, classes, id_col, text_col, k)
    spans = frames.settled(held.groupBy("class").agg(*_weight()).where("c > 1").select("class", _blocks(F.col("c"), F.col("w")).alias("all")))
    whole = held.join(spans.where("all = 1").select("class"), "class").withColumn("side", F.lit(BOTH))
    links = frames.settled(compared(whole, ["class"], num, den))
    if spans.where("all > 1").take(1):
        large = frames.settled(held.join(spans.where("all > 1").select("class"), "class"))
        others = large_links(large, num, den)
        both = frames.settled(links.unionByName(others))
        frames.forget(links, large, others)
        links = both
    frames.forget(held, spans)
    return links


def linked_sets(docs: DataFrame, id_col: str, text_col: str, k: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows' set names, and (sig, class) of every non-empty set."""
    num, den = similarity
    names = frames.settled(set_names(docs, id_col, text_col, k))
    stars = frames.settled(star_edges(candidate_keys(docs, text_col, k, num, den)))
    classes = frames.settled(frames.components(stars))
    frames.forget(stars)
    links = verified_links(docs, names, classes, id_col, text_col, k, num, den)
    joined = frames.components(links).select(F.col("node").alias("sig"), "component")
    frames.forget(classes, links)
    filled = names.where("n_shingles > 0").select("sig").distinct()
    return names, filled.join(joined, "sig", "left").select("sig", F.coalesce("component", "sig").alias("class"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = tk.SHINGLE_WORDS, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least ``similarity``.

    ``similarity`` is a fraction (numerator, denominator) compared in integers.
    Returns (id, n_shingles, component_id): one row for each input row, the
    component named by its smallest id.  A text that is null, empty or without
    words has no shingle and stands alone; a text of fewer than k words has its
    whole sequence as one shingle; equal sets are linked; repeated rows each
    get a row.  A row with a null id is linked like any other; its component_id
    is the smallest id of its class, null where the class has none.
    """
    names, classes = linked_sets(docs, id_col, text_col, k, similarity)
    # Sizes first: a set that many rows share is one row here.
    low = names.where("n_shingles > 0").groupBy("sig").agg(F.min("id").alias("low"))
    named = classes.join(low, "sig")
    named = frames.settled(named)
    lowest = frames.settled(named.groupBy("class").agg(F.min("low").alias("component_id")))
    final = named.join(lowest, "class").select("sig", "component_id")
    full = names.where("n_shingles > 0").join(final, "sig").select("id", "n_shingles", "component_id")
    return full.unionByName(names.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = tk.SHINGLE_WORDS, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of each class of linked documents, all columns unchanged.

    The row of the smallest id stays (ids before null, ties by a hash of the
    text, then of the row); rows without words are linked with
    nothing and all stay.
    """
    names, classes = linked_sets(docs, id_col, text_col, k, similarity)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    best = names.where("n_shingles > 0").groupBy("sig").agg(F.min(rank).alias("rank")).join(classes, "sig").groupBy("class").agg(F.min("rank").alias("rank"))
    lowest = F.lit(-(2**63))
    rid, th, row = _unused(docs, 3)
    chosen = best.select(F.coalesce("rank.id", lowest).alias(rid), F.col("rank.th").alias(th))
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    marked = docs.where(worded).withColumn(rid, F.coalesce(F.col(id_col).cast("long"), lowest)).withColumn(th, F.xxhash64(text))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    # Of rows of one id and text, the least by a hash of the row; found by partial aggregation.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = marked.join(chosen, [rid, th]).groupBy(rid, th).agg(F.min_by(whole, F.xxhash64(*plain)).alias(row))
    return found.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]).unionAll(docs.where(~worded))


def _unused(df: DataFrame, n: int) -> list[str]:
    """Column names that the frame does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_k{i}" for i in range(n + len(taken))) if c not in taken][:n]
