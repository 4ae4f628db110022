"""Inputs of the engine's own queries: live elements of the given tables, and generated segments with known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.operators.elements import live
from geochunk.operators.tags import clean
from geochunk.schema import META
from geochunk.session import load
from geochunk.sources.read import Dataset


def dataset(spark: SparkSession, d: str) -> Dataset:
    """Live current rows of the element tables."""
    own = {"nodes": ["lon", "lat"], "ways": ["nds"], "relations": ["members"]}
    return Dataset(*(live(load(spark, d, t), [*META, *cols, "tags"]).drop("loaded_at") for t, cols in own.items()))


def cleaned(spark: SparkSession, d: str) -> Dataset:
    """The same without discardable tags."""
    x = dataset(spark, d)
    return Dataset(clean(x.nodes), clean(x.ways), clean(x.relations))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(owner, n, k, pos, line): per customer a ring of n segments, one per order, from order k's point to the next one's,
    odd orders' segments turned round; pos shuffles them. The point of order o lies at
    (100000000 + 1000*o, 480000000 + 100*(7919*o mod 100003)): its longitude is a bigint, since it leaves 32 bits (and
    the globe) from order 2,047,484 on."""
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("o")).distinct()
    g = o.groupBy("owner").agg(F.array_sort(F.collect_list("o")).alias("os"))
    g = g.select("owner", F.size("os").alias("n"), "os", F.posexplode("os").alias("k", "o"))
    nxt = F.get("os", F.pmod(F.col("k") + 1, F.col("n")))
    lat = lambda x: (480_000_000 + (x % 100_003 * 7919 % 100_003) * 100).cast("int")
    at = lambda x: F.struct((100_000_000 + x * 1000).alias("lon"), lat(x).alias("lat"))
    line = F.array(at(F.col("o")), at(nxt))
    return g.select("owner", "n", "k", (F.col("o") % 101 * 31 % 101).alias("pos"), "o", F.when(F.col("o") % 2 == 1, F.reverse(line)).otherwise(line).alias("line"))
