"""Mixing sources to target weights by a low-discrepancy schedule over shuffled blocks of about equal size.

Everything a source has (weight, span, blocks, repeats) is a row of a table, so any number of sources can be listed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geochunk.session import broadcast_checked, materialize

#: Size of a block, in tokens.
BLOCK = 4096
#: Tokens of a source summed up together, and slots ranked together: bounds of what one group of a window holds.
BUCKET, CHUNK = 1 << 26, 65_536

#: Fixed value: the golden ratio's fractional part times 2^64.
_GOLDEN, _TWO64 = 11400714819323198485, 1 << 64
#: Weights are whole numbers of about this sum.
_SCALE = 1 << 30
#: Parts of the span of all weights per source, for the lookup of a point's source.
_CELLS = 4


def source_table(items: DataFrame, targets: DataFrame, source: str, size: str, block: int) -> tuple[DataFrame, int, int]:
    """(source, lo, hi, blocks, max_repeat, buckets) of the sources that take part, a written table; the sum of all
    weights, hi of the last; and the size of the mixture: the largest for which no source must repeat too often,
    min over sources of available * max_repeat / share.

    Sources without anything to give, with no positive share or no repeat allowed can't take part; the shares of the
    others are scaled up to sum to 1. Weights are whole numbers, so that no sum depends on the order of its terms.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeat")).alias("t")).select("source", "t.*")
    have = items.where(F.col(size) > 0).groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("available"))
    use = wanted.where("target_share > 0 and max_repeat > 0").join(have, "source")
    use = materialize(use.withColumn("w", F.greatest(F.round(F.col("target_share") * 1e12).cast("long"), F.lit(1).cast("long"))), "sources")
    weight = use.agg(F.sum(F.col("w").cast("decimal(38,0)"))).collect()[0][0]
    if weight is None:
        return use.select("source", *(F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "blocks")), "max_repeat", F.lit(1).cast("long").alias("buckets")), 0, 0
    part = F.expr(f"cast(cast(w as decimal(20,0)) * {_SCALE} div {weight} as bigint)")
    use = use.withColumn("part", F.greatest(part, F.lit(1).cast("long")))
    # one row a source; a running sum over them all in one task, as a list of targets is written by hand
    hi = F.sum("part").over(Window.orderBy("source"))
    total = use.agg(F.min(F.col("available") * F.col("max_repeat") / (F.col("w") / F.lit(float(weight))))).collect()[0][0]
    out = use.select(
        "source", (hi - F.col("part")).alias("lo"), hi.alias("hi"), F.ceil(F.col("available") / F.lit(block)).cast("long").alias("blocks"), "max_repeat",
        F.ceil(F.col("available") / F.lit(BUCKET)).cast("long").alias("buckets"),
    )
    out = materialize(out, "sources")
    return out, out.agg(F.max("hi")).collect()[0][0], int(total)


def schedule(sources: DataFrame, weight: int, n_slots: int) -> DataFrame:
    """(slot_no, source, rank): slot i belongs to the source in whose span of the cumulated weights the fractional part of
    (i+1) times the golden ratio falls; rank counts the slots of a source. Any run of slots has the shares within O(log n / n).

    The point is exact (whole numbers modulo 2^64, of which the upper half is used). Its source is looked up in cells of
    the span, a few per source. Ranks are made per chunk of slots and moved up by the counts of the chunks before, so a
    source holding most slots is no hot group.
    """
    width = max(1, weight // (_CELLS * max(1, sources.count())))
    slots = sources.sparkSession.range(n_slots).withColumnRenamed("id", "slot_no")
    whole = lambda n: F.lit(Decimal(n)).cast("decimal(20,0)")
    point = ((F.col("slot_no") + 1).cast("decimal(17,0)") * whole(_GOLDEN)) % whole(_TWO64)
    upper = F.call_function("div", point, whole(1 << 32)).cast("long")
    slots = slots.withColumn("x", F.shiftright(upper * F.lit(weight).cast("long"), 32))
    cells = sources.select("source", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    slots = slots.withColumn("cell", F.expr(f"x div {width}")).join(broadcast_checked(cells), "cell").where("x >= lo and x < hi")
    slots = slots.select("slot_no", "source", F.expr(f"slot_no div {CHUNK}").alias("chunk"))
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot_no")) - 1
    ranked = slots.withColumn("local", local).join(broadcast_checked(offsets), ["source", "chunk"])
    return ranked.select("slot_no", "source", (F.col("offset") + F.col("local")).alias("rank"))


def blocks(items: DataFrame, sources: DataFrame, seed: int, key: str, source: str, size: str, block: int) -> DataFrame:
    """``items`` of the sources with ``block``: in shuffled order (by a hash of the key), the part of the source's running
    size in which the item begins. Sums run inside ranges of the hash, as many as the source's size asks for, and are
    moved up by the sizes of the ranges before; the order is that of the hash whatever their number."""
    rows = items.where(F.col(size) > 0).select(F.col(source).alias("source"), F.col(key).alias("k"), F.col(size).alias("n"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    rows = rows.join(broadcast_checked(sources.select("source", "buckets")), "source")
    upper = F.shiftrightunsigned("h", 33)
    rows = rows.withColumn("bucket", F.shiftright(upper * F.least("buckets", F.lit(1 << 31)), 31)).drop("buckets")
    sums = rows.groupBy("source", "bucket").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 33), "h", "k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = rows.withColumn("start", start).join(broadcast_checked(offsets), ["source", "bucket"])
    return placed.select("source", "k", "n", F.expr(f"(offset + start) div {block}").alias("block"))


def mix_sources(
    items: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", block: int = BLOCK, seed: int = 0
) -> DataFrame:
    """(slot_no, source, repeat_no, key, n_tokens): the mixture, in the order of slot_no.

    Slot r of a source takes its block r modulo its blocks, whole items; repeat_no = r div blocks stays below max_repeat.
    Items of null or unlisted sources, of size 0 or null take no part; listed sources without items leave their share
    to the others; of repeated targets the one with the largest share counts. Empty tables give no rows; further columns
    are ignored. The shares come out within about one block, or one item if that is larger, per source.
    """
    items = materialize(items.select(key, source, size), "sized")
    sources, weight, total = source_table(items, targets, source, size, block)
    slots = schedule(sources, weight, total // block).join(broadcast_checked(sources.select("source", "blocks", "max_repeat")), "source")
    slots = slots.select("slot_no", "source", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("cast(rank div blocks as int)").alias("repeat_no"), "max_repeat")
    placed = blocks(items, sources, seed, key, source, size, block)
    out = slots.where("repeat_no < max_repeat").join(placed, ["source", "block"])
    return out.select("slot_no", "source", "repeat_no", F.col("k").alias(key), F.col("n").alias("n_tokens"))


def shares_reached(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: target_share, actual_share, share_error (their difference), n_tokens and most_repeats
    (times its most repeated item comes)."""
    got = mixture.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    total = got.agg(F.sum("n_tokens").alias("all_tokens"))  # one row
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"))
    n = F.coalesce("n_tokens", F.lit(0))
    j = t.join(got, "source", "left").join(F.broadcast(total))
    j = j.withColumn("actual_share", n / F.greatest(F.coalesce("all_tokens", F.lit(0)), F.lit(1)))
    return j.select("source", "target_share", "actual_share", (F.col("actual_share") - F.col("target_share")).alias("share_error"), n.alias("n_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
