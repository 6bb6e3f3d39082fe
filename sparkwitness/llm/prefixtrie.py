"""Conversation prefix trie: nodes by digests of prefixes, rolled up by pointer jumping.

A turn at position p has the entry hash(p, role, text), and a prefix is named
by the XOR of its entries (two 64-bit lanes).  XOR is associative, so the names
of all prefixes of a conversation are running values that blocks of turns
compute apart, and the name of a prefix without its last turn is one XOR away:
that is the edge to the parent.  Rows of equal names are one node.

Sums over subtrees take logarithmically many rounds: when each node knows the
sums over its descendants nearer than r and its ancestor at distance r, adding
the sums of the nodes whose ancestor at distance r it is gives the sums to 2r,
and the ancestor's own pointer leads to distance 2r.

* Turns of a null conversation id belong to none and are left out; a null role
  or text is empty.
* Turns are ordered by ``turn`` (null first), then by the first 64 characters of
  role and of text, then by digest; repeated rows are turns of their own.
* Texts are compared by SHA-256, prefixes by two 64-bit lanes over it: for n
  different prefixes the probability that any two share a name is below
  n * n / 2**129.
* Without any conversation there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames

#: So many turns are named in one window group; so many ids are one string.
BLOCK, CHUNK = 4096, 128
#: A rebuilt conversation takes fewer turns than this from its base.
GRAFT, FAMILY = 9, 5
_TIE = 64


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, c1, c2, n_bytes), pos from 1, and conversations (conv, n).

    The turns are dealt by ranges of their sort keys and numbered by their
    place in a range, so a conversation may span any number of tasks.
    """
    said, who = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, role))
    digest = F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary"), 256)
    t = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("o"), F.substring(who, 1, _TIE).alias("r"), F.substring(said, 1, _TIE).alias("t"), digest.alias("h"), F.octet_length(said).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("any"),  # equal rows need not stay together
    )
    keys = ["conv", F.asc_nulls_first("o"), "r", "t", "h", "any"]
    lanes = (F.xxhash64("h", F.lit(1)).alias("c1"), F.xxhash64(F.lit(2), "h").alias("c2"))
    dealt = t.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", F.monotonically_increasing_id().alias("seq"), *lanes, "n_bytes")
    rows = frames.settled(dealt.withColumn("part", F.shiftright("seq", 33)))
    # At most one row for each range that a conversation spans.
    spans = rows.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pos = F.col("before") + F.col("seq") - F.col("first") + 1
    out = frames.settled(rows.join(spans.select("conv", "part", "first", "before"), ["conv", "part"]).select("conv", pos.alias("pos"), "c1", "c2", "n_bytes"))
    sizes = frames.settled(spans.groupBy("conv").agg(F.sum("n").alias("n")))
    frames.forget(rows)
    return out, sizes


def rebuilt(rows: DataFrame, sizes: DataFrame, graft: int = GRAFT, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from their family's base.

    Conversation c has the first h turns of c - c % family (the remainder has
    the sign of c), then its own turns after its first h, where h is
    crc32(c in decimal) % graft.  A base without turns gives none.
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % graft).cast("long")
    c = sizes.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    c = c.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    c = frames.settled(c.select("conv", "base", "h", "n", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    own = frames.lookup(rows, c.select("conv", "h", "taken", "n"), ["conv"], "n", total).where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "c1", "c2", "n_bytes")
    heads = rows.where((F.col("pos") < graft) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    # A base has fewer than graft heads and 2 * family members.
    lent = heads.join(c.where("taken > 0").select("conv", "base", "taken"), "base").where("pos <= taken").select("conv", "pos", "c1", "c2", "n_bytes")
    return own.unionByName(lent), c.select("conv", F.col("size").alias("n"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn with the name (k1, k2) of the prefix that it ends and that (p1, p2) of the prefix before it."""
    e = rows.select("conv", "pos", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), F.xxhash64("c1", "c2", "pos").alias("e1"), F.xxhash64("pos", "c2", "c1").alias("e2"), "n_bytes")
    e = frames.settled(e)
    upto = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = e.groupBy("conv", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    blocks = blocks.select("conv", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    named = e.select("*", *[F.bit_xor(f"e{i}").over(upto).alias(f"x{i}") for i in (1, 2)]).join(blocks, ["conv", "block"])
    k = [F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    p = [k[i].bitwiseXOR(F.col(f"e{i + 1}")) for i in (0, 1)]
    return named.select("conv", F.col("pos").alias("depth"), k[0].alias("k1"), k[1].alias("k2"), p[0].alias("p1"), p[1].alias("p2"), "n_bytes")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined strings of each node; the strings come sorted, one at a time is hashed."""
    node, state = None, None
    for b in batches:
        done: list[tuple[int, int, str]] = []
        for k1, k2, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (k1, k2) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(s.encode())
        yield _named(done)
    if node is not None:
        yield _named([(*node, state.hexdigest())])


def _named(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["k1", "k2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the conversations (k1, k2, conv) that end at each node.

    Ids are sorted by ranges and joined to strings of at most CHUNK ids, so a
    node where very many conversations end is some strings for one task, which
    hashes them one after the other, as SHA-256 asks.
    """
    dealt = ends.repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").withColumn("chunk", F.expr(f"monotonically_increasing_id() div {CHUNK}"))
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    chunks = dealt.groupBy("k1", "k2", "chunk").agg(F.array_join(ids, ",").alias("ids"))
    ordered = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk")
    return ordered.select("k1", "k2", "ids").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(k1, k2) and ``sums`` added up over the subtree of each node.

    ``nodes``: k1, k2, p1, p2 (parent; of no meaning at depth 0), depth and the
    columns of ``sums``.  The number of rounds is the logarithm of the depth.
    """
    height = nodes.agg(F.max("depth")).first()[0] or 0
    pointer = lambda c: F.when(F.col("depth") > 0, F.col(c))
    t = nodes.select("k1", "k2", "depth", pointer("p1").alias("j1"), pointer("p2").alias("j2"), *sums)
    reach, old = 1, None
    while reach <= height:
        # Sums to distance 2 * reach; m counts the nodes that point here.
        sent = t.where(F.col("depth") >= reach).groupBy("j1", "j2").agg(*[F.sum(c).alias(f"s_{c}") for c in sums], F.count(F.lit(1)).alias("m"))
        sent = sent.withColumnsRenamed({"j1": "k1", "j2": "k2"})
        added = [(F.col(c) + F.coalesce(f"s_{c}", F.lit(0))).alias(c) for c in sums]
        new = frames.settled(t.join(sent, ["k1", "k2"], "left").select("k1", "k2", "depth", "j1", "j2", *added, F.coalesce("m", F.lit(0)).alias("m")))
        # Pointers to distance 2 * reach; none leads above the root.
        far = new.where(F.col("depth") >= 2 * reach)
        over = new.where((F.col("m") > 0) & (F.col("depth") >= reach)).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"), "m")
        total = far.count()
        jumped = frames.lookup(far.drop("m"), over, ["j1", "j2"], "m", total).select("k1", "k2", "depth", F.col("n1").alias("j1"), F.col("n2").alias("j2"), *sums)
        near = new.where(F.col("depth") < 2 * reach).select("k1", "k2", "depth", F.lit(None).cast("long").alias("j1"), F.lit(None).cast("long").alias("j2"), *sums)
        t = frames.settled(jumped.unionByName(near))
        frames.forget(new, *([old] if old is not None else []))
        old, reach = t, 2 * reach
    return t.select("k1", "k2", *sums)


def prefix_trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one included.

    ``rows`` as ``numbered`` gives them, ``sizes`` (conv, n) names every
    conversation, those without turns too.  Returns conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes
    that the members of the subtree's nodes share) and ends_sha256.
    """
    named = frames.settled(prefixes(rows))
    members = named.groupBy("k1", "k2").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = sizes.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero("k1"), zero("k2"), "conv_id", zero("depth"), "n_convs", zero("p1"), zero("p2"), zero("n_bytes"))
    nodes = frames.settled(members.unionByName(root))
    children = nodes.where("depth > 0").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children")).withColumnsRenamed({"p1": "k1", "p2": "k2"})
    nodes2 = frames.settled(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    frames.forget(nodes)
    below = nodes2.where("depth > 0")
    parents = nodes2.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    held = ["k1", "k2", "conv_id", "depth", "n_convs", "own_children"]
    with_parent = frames.lookup(below.withColumnRenamed("n_children", "own_children"), parents, ["p1", "p2"], "n_children", below.count()).select(*held, "parent_conv_id")
    top = nodes2.where("depth = 0").withColumnRenamed("n_children", "own_children").select(*held, F.lit(None).cast("long").alias("parent_conv_id"))
    start = nodes2.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    sums = rolled_up(start, ["n_leaves", "saved_tokens"])
    # A conversation ends at its longest prefix.
    last = named.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("e")).select("conv", "e.k1", "e.k2")
    turnless = sizes.where("n = 0").select("conv", zero("k1"), zero("k2"))
    ends = end_digests(last.unionByName(turnless))
    out = with_parent.unionByName(top).join(sums, ["k1", "k2"]).join(ends, ["k1", "k2"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("own_children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
