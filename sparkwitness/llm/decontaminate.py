"""Operator 9: benchmark items contained in documents, by size-partitioned MinHash search.

An item is contained when at least ``containment`` of its word shingles are in
the document's shingle set.  Items are partitioned by their number of shingles,
which doubles from one partition to the next, and each partition has a table of
its own.  Its MinHash signatures are the smallest hashes of each item, as many
as an item of the partition's largest size can miss, and one more; so a document that
contains an item has one hash of its signature for certain, however long the
document is.  (Signatures of documents, compared by Jaccard, would miss short
items in long texts.)  A document is sought in the partitions of the items that
it is large enough to contain, there by those of its shingles whose hash is not
above the greatest hash of the partition's signatures.  Hits are verified by
counting all of the item's shingles in the document's set.

The items are the stated queries: they are taken in blocks of bounded size, and
each block is one narrow pass over all documents, so nothing is shuffled and the
memory of a task does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import textkernel as tk

#: Bytes of item text in one block, about: a benchmark of that size is one pass.
BLOCK_BYTES = 8 << 20
#: A partition's table is asked only for hashes whose leading bits some signature has.
FILTER_BITS = 20

_U64 = np.uint64
_ORDER = _U64(0x3C79AC492BA7B653)
Item = tuple[int | None, str | None, int]  # id, text, copies


@dataclass
class Partition:
    """Signatures of the items of one size partition, ordered by hash."""

    words: int  # of a shingle: five, or fewer for shorter items
    least: int  # shingles that a document must have to contain any item
    hashes: np.ndarray
    items: np.ndarray
    top: np.uint64
    seen: np.ndarray


@dataclass
class Index:
    """One block of items: their ids, repetitions, shingle sets and bounds, and the partitions' tables."""

    ids: list[int | None]
    copies: list[int]
    sets: list[np.ndarray]
    need: np.ndarray
    partitions: list[Partition]


def min_hash_order(shingles: np.ndarray) -> np.ndarray:
    return tk.mix(shingles ^ _ORDER)


def signature_length(size: int, num: int, den: int) -> int:
    """One more than the shingles that an item of the size can miss."""
    return size + (-size * num // den) + 1


def build_index(items: list[Item], num: int, den: int, k: int = tk.SHINGLE_WORDS) -> Index:
    """Index of items; items without words are contained in nothing."""
    ids, copies, sets, words = [], [], [], []
    for id_, text, times in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        hashes, row = tk.word_hashes(raw, np.array([0, len(raw)]))
        if not len(hashes):
            continue
        width = min(k, len(hashes))
        ids.append(id_)
        copies.append(times)
        sets.append(np.unique(tk.gram_hashes(hashes, row, width)[0]))
        words.append(width)
    sizes = np.array([len(s) for s in sets], np.int64)
    need = -(-sizes * num // den)
    members: dict[tuple[int, int], list[int]] = {}
    for i, (w, n) in enumerate(zip(words, sizes.tolist(), strict=True)):
        members.setdefault((w, n.bit_length() - 1), []).append(i)
    partitions = []
    for (w, p), own in sorted(members.items()):
        length = signature_length((2 << p) - 1, num, den)
        signatures = [np.sort(min_hash_order(sets[i]))[:length] for i in own]
        flat, item = np.concatenate(signatures), np.repeat(own, [len(x) for x in signatures])
        order = np.argsort(flat, kind="stable")
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[(flat >> _U64(64 - FILTER_BITS)).astype(np.int64)] = True
        partitions.append(Partition(w, int(need[own].min()), flat[order], item[order], flat.max(), seen))
    return Index(ids, copies, sets, need, partitions)


def candidates(part: Partition, hashes: np.ndarray, owner: np.ndarray, count: np.ndarray) -> set[tuple[int, int]]:
    """(row, item) where a text of ``count`` shingles has a hash of the item's signature."""
    maybe = np.flatnonzero((hashes <= part.top) & (count[owner] >= part.least))
    maybe = maybe[part.seen[(hashes[maybe] >> _U64(64 - FILTER_BITS)).astype(np.int64)]]
    left = np.searchsorted(part.hashes, hashes[maybe], "left")
    right = np.searchsorted(part.hashes, hashes[maybe], "right")
    hit = right > left
    return {(int(r), int(i)) for r, a, b in zip(owner[maybe][hit], left[hit], right[hit], strict=True) for i in part.items[a:b]}


def search(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, item, shingles found) of each item that a text of the chunk contains."""
    words, row = tk.word_hashes(data, offsets)
    out = []
    for w in sorted({p.words for p in index.partitions}):
        gram, owner = tk.gram_hashes(words, row, w)
        hashes, count = min_hash_order(gram), np.bincount(owner, minlength=len(offsets))
        pairs = set().union(*(candidates(p, hashes, owner, count) for p in index.partitions if p.words == w))
        first = np.concatenate(([0], np.cumsum(count)))
        own: dict[int, np.ndarray] = {}
        for r, i in sorted(pairs):
            if r not in own:
                own[r] = np.unique(gram[first[r] : first[r + 1]])
            at = np.minimum(np.searchsorted(own[r], index.sets[i]), len(own[r]) - 1)
            found = int((own[r][at] == index.sets[i]).sum())
            if found >= index.need[i]:
                out.append((r, i, found))
    return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[Item]]:
    """The different items, with their number of rows, in blocks of about ``block_bytes`` of text, each fetched when it is due."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield sorted(((r["id"], r["text"], r["copies"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def _finder(index: Index) -> Callable:
    def fn(rows, data, offsets):
        found = [x for x in search(index, data, offsets) for _ in range(index.copies[x[1]])]
        if not found:
            return None
        take = pa.array([r for r, _, _ in found])
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(take), pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([len(index.sets[i]) for _, i, _ in found], pa.int64()), pa.array([n for _, _, n in found], pa.int64())],
            names=["id", "item_id", "n_item", "n_found"],
        )

    return fn


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: tuple[int, int] = (80, 100), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, n_item, n_found, containment) of each document and item that it contains.

    Null and empty texts contain nothing and are contained in nothing.  An item
    of fewer than five words is one shingle of its own length, sought among the
    document's word sequences of that length.  Repeated rows on either side
    each count; ids may be null.
    """
    num, den = containment
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks_of(items, item_id, item_text, block_bytes):
        part = frames.map_texts(texts, "text", _finder(build_index(block, num, den)), "id long, item_id long, n_item long, n_found long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("containment", F.col("n_found") / F.col("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: tuple[int, int] = (80, 100), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text contains no item, all columns unchanged."""
    num, den = containment
    for block in blocks_of(items, item_id, item_text, block_bytes):
        index = build_index(block, num, den)

        def fn(rows, data, offsets, index=index):
            keep = np.ones(rows.num_rows, bool)
            keep[[r for r, _, _ in search(index, data, offsets)]] = False
            return rows.filter(pa.array(keep))

        docs = frames.map_texts(docs, text_col, fn, docs.schema)
    return docs
