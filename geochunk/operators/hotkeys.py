"""Per-key results although a few keys hold most rows: two-stage salted aggregation, and tiles by first match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geochunk.session import broadcast_checked


#: Keys a sketch of heavy keys tracks, as a multiple of 1/share.
TRACKED = 16


def heavy_hashes(rows: DataFrame, keys: Sequence[str], share: float) -> list[int]:
    """64-bit hashes of the keys that hold about ``share`` of all rows or more: found by a frequent-items sketch of bounded
    size, made per partition and merged, so the rows are neither shuffled nor grouped by key. At most 2/share values.

    The sketch may miss by 1/TRACKED of the share; that only decides which keys are salted, no result depends on it."""
    k = int(2 / share)
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(k), F.lit(int(TRACKED / share)))
    got = rows.agg(top.alias("top"), F.count("*").alias("all")).collect()[0]
    return [r["item"] for r in got["top"] or [] if r["count"] >= got["all"] * share]


def salted_aggregate(
    rows: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    partial: dict[str, Column],
    merge: dict[str, Column],
    share: float = 0.01,
    salts: int = 64,
) -> DataFrame:
    """Two-stage aggregation: rows of heavy keys get one of ``salts`` salts, partial results are made per (key, salt) and
    merged by key. ``merge`` refers to the names of ``partial``.

    The salt is a hash of the columns ``by``, spread like a random one but the same when a lost task runs again. Rows of
    light keys all have salt 0. Null keys form a key of their own; repeated rows count each; empty input gives no rows.
    """
    heavy = heavy_hashes(rows, keys, share)
    is_heavy = F.xxhash64(*keys).isin(*heavy) if heavy else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)
    first = rows.withColumn("_salt", salt).groupBy(*keys, "_salt").agg(*(c.alias(n) for n, c in partial.items()))
    return first.groupBy(*keys).agg(*(c.alias(n) for n, c in merge.items()))


#: Side of the index cells, 1 degree.
CELL = 10_000_000


def tile_index(tiles: DataFrame, cell: int = CELL) -> DataFrame:
    """(cx, cy, tiles): for each index cell the tiles that meet it, by tile_id, up to the first that holds all of it."""
    lo = lambda c: F.floor(F.col(c).cast("long") / cell).cast("int")
    t = tiles.where("minlon <= maxlon and minlat <= maxlat")
    t = t.withColumn("cx", F.explode(F.sequence(lo("minlon"), lo("maxlon")))).withColumn("cy", F.explode(F.sequence(lo("minlat"), lo("maxlat"))))
    x, y = F.col("cx").cast("long") * cell, F.col("cy").cast("long") * cell
    full = (F.col("minlon") <= x) & (F.col("maxlon") >= x + cell - 1) & (F.col("minlat") <= y) & (F.col("maxlat") >= y + cell - 1)
    one = F.struct("tile_id", "minlon", "minlat", "maxlon", "maxlat", full.alias("whole"))
    g = t.groupBy("cx", "cy").agg(F.array_sort(F.collect_list(one)).alias("all"))
    first = F.array_position(F.transform("all", lambda e: e["whole"]), True)
    return g.select("cx", "cy", F.when(first > 0, F.slice("all", 1, first.cast("int"))).otherwise(F.col("all")).alias("tiles"))


def first_tile(points: DataFrame, tiles: DataFrame, cell: int = CELL) -> DataFrame:
    """``points`` with ``tile_id``: of the inclusive rectangles holding (lon, lat), the smallest id; null where none does.

    A lookup in a cell index, broadcast only after its cells were counted, replaces comparing every point with every
    rectangle. Points with a null coordinate get null.
    """
    at = lambda c: F.floor(F.col(c).cast("long") / cell).cast("int")
    p = points.withColumn("_cx", at("lon")).withColumn("_cy", at("lat"))
    holds = lambda t: F.col("lon").between(t["minlon"], t["maxlon"]) & F.col("lat").between(t["minlat"], t["maxlat"])
    j = p.join(broadcast_checked(tile_index(tiles, cell).toDF("_cx", "_cy", "_tiles")), ["_cx", "_cy"], "left")
    head = F.get("_tiles", F.lit(0))
    # most cells are held by their first tile: no search then
    found = F.when(head["whole"], head["tile_id"]).otherwise(F.get(F.filter("_tiles", holds), F.lit(0))["tile_id"])
    return j.withColumn("tile_id", found).drop("_cx", "_cy", "_tiles")
