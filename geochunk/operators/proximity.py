"""Points near other points, and points in regions.

near: points are cells of a cube grid around the sphere, so that poles and the date line are places like any other.
regions: an adaptive quadtree cover tells fully interior cells, accepted by equi-join alone, from boundary cells, whose
points alone take the exact containment test.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geochunk.session import broadcast_checked, materialize

EARTH_M = 6371008.8
UNIT = 1e-7  # degrees

_HALF = 1 << 31


def _radians(c: Column) -> Column:
    return F.radians(c.cast("double") * UNIT)


def near_pairs(points: DataFrame, metres: float, cells: float = 8.0) -> DataFrame:
    """Pairs (id_a < id_b) of points at most ``metres`` apart on the great circle.

    points: id, lon, lat (integers in 1e-7 degrees). A row with a null in any of them is near nothing; ids are taken as
    unique, rows with one id are no pair; further columns are ignored; an empty table gives no rows.

    Every point has one home cell with an edge of ``cells`` times the distance and is copied into each further cell
    that a cube of the distance around it touches (on average about 1 copy more). A pair is found in the home cell of
    its smaller id only, so nothing is found twice and no distinct follows. Skewed cells are left to AQE's skew join,
    which splits them.
    """
    edge, reach = metres * cells, metres * (1 + 1e-9) + 1e-6
    p = points.select("id", "lon", "lat").dropna()
    lo, la = _radians(F.col("lon")), _radians(F.col("lat"))
    p = p.select("id", lo.alias("lo"), la.alias("la"))
    xyz = (F.cos("la") * F.cos("lo"), F.cos("la") * F.sin("lo"), F.sin("la"))
    p = p.select("*", *((c * EARTH_M).alias(n) for c, n in zip(xyz, "xyz")))
    at = lambda n, d=0.0: F.floor((F.col(n) + d) / edge)
    home = p.select("id", "lo", "la", F.xxhash64(at("x"), at("y"), at("z")).alias("cell"))
    corners = F.array(*(F.xxhash64(at("x", i), at("y", j), at("z", k)) for i in (-reach, reach) for j in (-reach, reach) for k in (-reach, reach)))
    inside = (at("x", -reach) == at("x", reach)) & (at("y", -reach) == at("y", reach)) & (at("z", -reach) == at("z", reach))
    one = F.array(F.xxhash64(at("x"), at("y"), at("z")))
    copies = p.select("id", "lo", "la", F.explode(F.when(inside, one).otherwise(F.array_distinct(corners))).alias("cell"))
    a, b = home.alias("a"), copies.alias("b")
    half = lambda u, v: F.pow(F.sin((F.col(u) - F.col(v)) / 2), 2)
    h = half("a.la", "b.la") + F.cos("a.la") * F.cos("b.la") * half("a.lo", "b.lo")
    distance = 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.id") < F.col("b.id")) & (F.abs(F.col("a.la") - F.col("b.la")) <= reach / EARTH_M)
    return a.join(b, on).where(distance <= metres).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


def near_spots(points: DataFrame, metres: float) -> tuple[DataFrame, DataFrame]:
    """near_pairs between places instead of points, for data in which many points share one: (id_a, id_b) of the places'
    smallest ids, and the membership (id, spot) of every point with a position. Points of one spot are near one another;
    so n points at one place are n rows here and not n * n pairs."""
    p = points.select("id", "lon", "lat").dropna()
    spots = p.groupBy("lon", "lat").agg(F.min("id").alias("spot"))
    pairs = near_pairs(spots.withColumnRenamed("spot", "id"), metres)
    return pairs, p.join(spots, ["lon", "lat"]).select("id", "spot")


def _touches(e: tuple[int, int, int, int], x0: int, y0: int, x1: int, y1: int) -> bool:
    """Whether an edge meets a closed rectangle: overlapping extents, and corners not all on one side of its line."""
    ax, ay, bx, by = e
    if max(ax, bx) < x0 or min(ax, bx) > x1 or max(ay, by) < y0 or min(ay, by) > y1:
        return False
    side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in ((x0, y0), (x0, y1), (x1, y0), (x1, y1))]
    return min(side) <= 0 <= max(side)


def _holds(edges: list[tuple[int, int, int, int]], x: int, y: int) -> bool:
    odd = False
    for ax, ay, bx, by in edges:
        if (ay > y) != (by > y):
            d = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
            odd ^= d < 0 if by > ay else d > 0
    return odd


def cover_ring(ring: list[tuple[int, int]], detail: int = 6) -> Iterator[tuple[int, int, int, bool, list]]:
    """Cells (shift, x, y, interior, edges) covering a ring; of a cell with shift s the side is 2^s units.

    Cells met by the ring are quartered down to 1/2^detail of its extent; what stays is a boundary cell and carries the
    edges that a ray from its points eastward can cross. A ring with fewer than 3 points covers nothing.
    """
    if len(ring) < 3:
        return
    edges = [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]]) if a != b]
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    extent = max(max(xs) - min(xs), max(ys) - min(ys), 1)
    top = max(10, extent.bit_length())
    finest = max(10, top - detail)
    todo = [
        (top, x, y, edges)
        for x in range((min(xs) + _HALF) >> top, ((max(xs) + _HALF) >> top) + 1)
        for y in range((min(ys) + _HALF) >> top, ((max(ys) + _HALF) >> top) + 1)
    ]
    while todo:
        s, x, y, near = todo.pop()
        x0, y0 = (x << s) - _HALF, (y << s) - _HALF
        x1, y1 = x0 + (1 << s), y0 + (1 << s)
        met = [e for e in near if _touches(e, x0, y0, x1, y1)]
        if not met:
            if _holds(edges, x0 + (1 << s - 1), y0 + (1 << s - 1)):
                yield s, x, y, True, []
        elif s > finest:
            todo.extend((s - 1, 2 * x + i, 2 * y + j, met) for i in (0, 1) for j in (0, 1))
        else:
            yield s, x, y, False, [e for e in edges if max(e[1], e[3]) >= y0 and min(e[1], e[3]) <= y1 and max(e[0], e[2]) >= x0]


def cover_regions(regions: DataFrame, key: str = "zone_id", ring: str = "ring", detail: int = 6) -> DataFrame:
    """Covers of all regions: key, shift, cell, interior, edges. Regions are worked on side by side, each on its own;
    a null ring or point counts as no point."""
    kind = regions.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, points in zip(b[key], b["ring"]):
                pts = [(int(p["lon"]), int(p["lat"])) for p in (points if points is not None else []) if p is not None and p["lon"] is not None and p["lat"] is not None]
                for s, x, y, interior, edges in cover_ring(pts, detail):
                    rows.append((k, s, (x << 22) | y, interior, [dict(zip(("ax", "ay", "bx", "by"), e)) for e in edges]))
            yield pd.DataFrame(rows, columns=[key, "shift", "cell", "interior", "edges"])

    schema = f"{key} {kind}, shift int, cell long, interior boolean, edges array<struct<ax:long,ay:long,bx:long,by:long>>"
    return regions.select(key, F.col(ring).alias("ring")).mapInPandas(run, schema)


def points_in_regions(points: DataFrame, regions: DataFrame, key: str = "zone_id", ring: str = "ring", detail: int = 6) -> DataFrame:
    """(key, id) of each region and each point inside its ring (even-odd, straight edges in lon/lat, whole numbers).

    A region may overlap others; a point on an edge is inside or not by the half-open rule of the crossing test. Null
    coordinates lie in no region; repeated points give repeated rows; further columns are ignored. The cover is
    broadcast only after its cells were counted; beyond that bound it is joined by a shuffle on (shift, cell).
    """
    cover = materialize(cover_regions(regions, key, ring, detail), "cover")
    shifts = [r[0] for r in cover.select("shift").distinct().collect()]  # at most 23 values: 10..32
    p = points.select("id", F.col("lon").cast("long").alias("px"), F.col("lat").cast("long").alias("py")).where("px is not null and py is not null")
    if not shifts:
        return p.limit(0).select(F.lit(None).cast(regions.schema[key].dataType).alias(key), "id")
    at = lambda c, s: F.shiftright(F.col(c) + F.lit(_HALF), s)
    cells = F.array(*(F.struct(F.lit(s).alias("shift"), F.shiftleft(at("px", s), 22).bitwiseOR(at("py", s)).alias("cell")) for s in sorted(shifts)))
    placed = p.select("id", "px", "py", F.explode(cells).alias("c")).select("id", "px", "py", "c.shift", "c.cell")
    hit = placed.join(broadcast_checked(cover), ["shift", "cell"])
    d = lambda e: (F.col("px") - e["ax"]) * (e["by"] - e["ay"]) - (F.col("py") - e["ay"]) * (e["bx"] - e["ax"])
    crossed = F.filter(
        "edges",
        lambda e: ((e["ay"] > F.col("py")) != (e["by"] > F.col("py"))) & F.when(e["by"] > e["ay"], d(e) < 0).otherwise(d(e) > 0),
    )
    return hit.where(F.col("interior") | (F.pmod(F.size(crossed), F.lit(2)) == 1)).select(key, "id")
