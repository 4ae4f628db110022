"""Tiles: first rectangle of an ordered list that contains an element, without comparing elements with rectangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geochunk.config import Grid
from geochunk.schema import NOWHERE
from geochunk.session import broadcast_checked

#: The whole world, always the last rectangle.
WORLD = (-1_800_000_000, -900_000_000, 1_800_000_000, 900_000_000)


def bbox(nodes: DataFrame) -> DataFrame:
    """Envelope of all nodes with a position: minlon, minlat, maxlon, maxlat; null without any node."""
    return nodes.agg(F.min("lon").alias("minlon"), F.min("lat").alias("minlat"), F.max("lon").alias("maxlon"), F.max("lat").alias("maxlat"))


def expand(spark: SparkSession, grids: Sequence[Grid]) -> DataFrame:
    """(raw_id, minlon, minlat, maxlon, maxlat) of every rectangle, grid by grid, longitude first; the world last."""
    out, at = None, 0
    for g in (*grids, None):
        x0, dx, nx, y0, dy, ny = (g.x0, g.dx, g.nx, g.y0, g.dy, g.ny) if g else (WORLD[0], WORLD[2] - WORLD[0], 1, WORLD[1], WORLD[3] - WORLD[1], 1)
        if nx * ny == 0:
            continue
        edges = {"minlon": f"{x0} + (id div {ny}) * {dx}", "minlat": f"{y0} + (id % {ny}) * {dy}", "maxlon": f"{x0 + dx} + (id div {ny}) * {dx}", "maxlat": f"{y0 + dy} + (id % {ny}) * {dy}"}
        t = spark.range(nx * ny).selectExpr(f"id + {at} raw_id", *(f"cast({e} as int) {n}" for n, e in edges.items()))
        out, at = t if out is None else out.unionByName(t), at + nx * ny
    return out


def raw_tile(grids: Sequence[Grid]) -> Column:
    """Of the whole-number columns x0, y0, x1, y1 (bigint): ordinal of the first rectangle of the expanded grids that contains an envelope, inclusive on all sides; null if
    none does. Pure arithmetic: in a grid the first column (row) that ends at or after the envelope is the only one
    that can contain it."""
    tries, at = [], 0
    for g in (*grids, Grid(WORLD[0], WORLD[2] - WORLD[0], 1, WORLD[1], WORLD[3] - WORLD[1], 1)):
        i, j = f"greatest((x1 - {g.x0 + 1}L) div {g.dx}L, 0L)", f"greatest((y1 - {g.y0 + 1}L) div {g.dy}L, 0L)"
        fits = (
            f"{i} < {g.nx} AND {j} < {g.ny} AND x0 >= {g.x0} + {i} * {g.dx} AND y0 >= {g.y0} + {j} * {g.dy}"
            f" AND x1 <= {g.x0} + ({i} + 1) * {g.dx} AND y1 <= {g.y0} + ({j} + 1) * {g.dy}"
        )
        tries.append(f"CASE WHEN {fits} THEN {at} + {i} * {g.ny} + {j} END")
        at += len(g)
    return F.expr(f"coalesce({', '.join(tries)})")


def useful_tiles(spark: SparkSession, grids: Sequence[Grid], box: tuple[int, int, int, int] | None) -> DataFrame:
    """Rectangles that meet the data's envelope, numbered anew from 0 as tile_id; all of them if there is no envelope.

    The list of tiles is configuration: its size is that of the grids, which the driver knows without a job."""
    t = expand(spark, grids)
    if box:
        x0, y0, x1, y1 = box
        t = t.where((F.col("maxlon") >= x0) & (F.col("minlon") <= x1) & (F.col("maxlat") >= y0) & (F.col("minlat") <= y1) | (F.col("raw_id") == sum(map(len, grids))))
    return t.withColumn("tile_id", F.row_number().over(Window.orderBy("raw_id")) - 1).select("tile_id", "raw_id", "minlon", "minlat", "maxlon", "maxlat")


def envelope(pts: Column, holes: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """minlon, minlat, maxlon, maxlat of an array of points, and of holes."""
    every = pts if holes is None else F.concat(pts, F.flatten(holes))
    lons, lats = F.transform(every, lambda p: p["lon"]), F.transform(every, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def assign_tiles(elements: DataFrame, grids: Sequence[Grid], tiles: DataFrame) -> DataFrame:
    """``elements`` (type, pts, holes) with ``chunk_id``: tile_id of the first useful rectangle containing all points.

    What no rectangle contains, collections and anything with a point at NOWHERE, gets the number after the last tile.
    An element other than a collection with no points at all is contained in the first tile. The lookup of a raw
    rectangle's tile_id is an equi-join with the useful tiles, broadcast when counted small.
    """
    n = tiles.count()
    box = envelope(F.col("pts"), F.coalesce(F.col("holes"), F.array().cast(elements.schema["holes"].dataType)))
    names = ("x0", "y0", "x1", "y1")
    # in a struct of their own, so that no column of the elements is taken for one of them
    e = elements.select(F.struct("*").alias("e"), *(c.cast("long").alias(n) for n, c in zip(names, box)))
    e = e.select("e.*", F.when((F.col("e.type") != "C") & (F.col("x1") < NOWHERE), raw_tile(grids)).alias("_raw"))
    j = e.join(broadcast_checked(tiles.select(F.col("raw_id").alias("_raw"), "tile_id")), "_raw", "left").drop("_raw")
    empty = (F.col("type") != "C") & (F.size("pts") == 0)
    return j.withColumn("chunk_id", F.when(empty, F.lit(0)).otherwise(F.coalesce("tile_id", F.lit(n))).cast("int")).drop("tile_id")
