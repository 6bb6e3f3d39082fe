"""Operator 7: mixing sources to target weights by capped water-filling.

Each source has a weight and may be taken ``max_epochs`` times at most.  The
total is poured over the sources in proportion to their weights; a source that
would pass its cap stops there and its excess is shared again by weight, until
none is above: the water level of the sources sorted by cap over weight.  A
document is then taken in whole epochs, and the fraction that is left of each
source's target goes to one more repetition of documents in a seeded order, up
to the document whose middle is nearest.  Only built-in functions are used, and
each source's order is cut into ``BUCKETS`` hash buckets whose sums are
aggregated first, so that one source may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import frames

#: Hash buckets of a source's seeded order, as a power of two.
BUCKET_BITS = 12
#: Bits of the seeded order.
ORDER_BITS = 52
WORD = "[^\\x20\\x09-\\x0D]+"


def seeded_order(id_col: str, text_col: str, seed: str) -> Column:
    """52 bits of md5(seed:id:md5 of the text), the place of a row in the seeded order; texts under one id have places of their own."""
    own = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), own)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """(source, sid, source_size, target) of each source by the water level.

    Sources take the weights in order of their code points, repeating, null last.
    The windows run over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    cap = F.col("source_size") * max_epochs
    table = ranked.withColumn("w", weight).withColumn("cap", cap)
    whole = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share[0])) / F.lit(float(share[1]))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    table = table.withColumn("level", level).withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    water = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(Window.partitionBy(F.lit(1)))["level"]
    table = table.withColumn("water", water)
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")))
    return table.select("source", "sid", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: tuple[int, int] = (150, 100), max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row.

    ``size`` is the number of words (null text: 0), ``taken`` the words that the
    mix takes, repeats counted: between 0 and ``max_epochs`` times the size.
    The taken words of a source differ from its target by half a document at
    most.  A null source is a source of its own; rows of one id are ordered by
    a hash of their texts, so that many rows without an id are spread; reruns agree whatever the partitioning; an empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = frames.settled(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size"), seeded_order(id_col, text_col, seed).alias("place")))
    targets = frames.settled(source_targets(sized, weights, share, max_epochs))
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(F.lit(0)).cast("long")
    known = sized.join(targets.withColumn("epochs", epochs), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    known = known.withColumn("bucket", F.shiftright("place", ORDER_BITS - BUCKET_BITS).cast("int"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("inside"), F.first(rest).alias("rest"))
    run = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("inside").over(run), F.lit(0)))
    # 1: all of the bucket goes in; 0: none; null: the bucket that the fraction ends in.
    state = F.when(F.col("ahead") + F.col("inside") <= F.col("rest"), F.lit(1)).when(F.col("ahead") >= F.col("rest"), F.lit(0))
    marked = known.join(sums.select(F.col("sid").alias("s"), F.col("bucket").alias("b"), "ahead", "rest", state.alias("state")), (F.col("sid") == F.col("s")) & (F.col("bucket") == F.col("b")))
    inner = Window.partitionBy("sid").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = marked.where("state is null").withColumn("upto", F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.withColumn("extra", (F.col("upto") + F.col("size") / 2.0 <= F.col("rest")).cast("int"))
    done = marked.where("state is not null").withColumn("extra", F.col("state"))
    columns = ["id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("extra")) * F.col("size")).alias("taken")]
    return done.select(*columns).unionByName(edge.select(*columns))
