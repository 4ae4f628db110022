"""Items that appear together: baskets without repeats, ordered pairs, map-side combined counts, lift and PMI."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geochunk.session import materialize


def item_marginals(baskets: DataFrame, items: str = "items") -> tuple[DataFrame, int]:
    """(item, h, n): baskets holding each item, h its 64-bit code; and the number of baskets holding any."""
    held = baskets.where(F.size(items) > 0)
    ones = F.concat(F.array_distinct(items), F.array(F.lit(None).cast("string")))
    m = held.select(F.explode(ones).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    m = materialize(m.withColumn("h", F.xxhash64("item")), "items")
    total = m.where("item is null").agg(F.sum("n")).collect()[0][0] or 0
    return m.where("item is not null"), total


def cooccurrence(baskets: DataFrame, items: str = "items", min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Pairs of different items held by one basket: item_a < item_b by code point, n_ab, n_a, n_b, n_baskets, lift, pmi.

    Repeats inside a basket count once; null items are no items; null or empty baskets hold none; repeated rows are
    baskets of their own; an empty table gives no rows; further columns are ignored. Returned are pairs with
    n_ab >= ``min_count`` and n_ab * N >= ``min_lift`` * n_a * n_b, compared as whole numbers.

    Pairs are made inside one basket row, streamed by two generators (never one array of all pairs) and combined
    map-side under 64-bit codes, so a pair costs 24 bytes in the one shuffle however long its names are. Should two
    items share a code, the names themselves are counted. With ``min_lift`` > 0 an item held by more than
    N / min_lift baskets can be in no pair (n_ab <= min(n_a, n_b) and n_ab*N >= min_lift*n_a*n_b give
    N >= min_lift*max(n_a, n_b)), so it is left out before pairing; there are at most min_lift * (mean items per
    basket) such items, a bound that does not grow with the data.
    """
    clean = baskets.select(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))).alias("items")).where(F.size("items") > 0)
    clean = materialize(clean, "baskets")  # read twice: for the marginals and for the pairs
    m, n = item_marginals(clean)
    clash = not m.groupBy("h").count().where("count > 1").isEmpty()
    if min_lift > 0:
        hot = [r[0] for r in m.where(F.col("n") * F.lit(min_lift) > n).select("item").collect()]
        if hot:
            clean = clean.select(F.array_except("items", F.lit(hot)).alias("items"))
    code = F.col("items") if clash else F.transform("items", lambda x: F.xxhash64(x))
    key = "item" if clash else "h"
    coded = clean.where(F.size("items") > 1).select(code.alias("c"))
    left = coded.select("c", F.posexplode("c").alias("i", "a"))
    pairs = left.select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a = m.select(F.col(key).alias("a"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = m.select(F.col(key).alias("b"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = counts.join(a, "a").join(b, "b")
    if min_lift > 0:
        whole = lambda c: c.cast("decimal(19,0)")
        observed, by_chance = whole(F.col("n_ab")) * whole(F.lit(n)), whole(F.col("n_a")) * whole(F.col("n_b"))
        out = out.where(observed >= by_chance * F.lit(Decimal(str(min_lift))))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n_baskets"), lift.alias("lift"), F.log2(lift).alias("pmi"))
