import random

from geochunk.config import default_tiles, parse_tiles
from geochunk.operators.tiling import WORLD, assign_tiles, bbox, expand, useful_tiles

SCHEMA = "type string, id int, pts array<struct<lon:int,lat:int>>, holes array<array<struct<lon:int,lat:int>>>"


def scan(tiles, pts):
    for i, (x0, y0, x1, y1) in enumerate(tiles):
        if all(x0 <= x <= x1 and y0 <= y <= y1 for x, y in pts):
            return i
    return len(tiles)


def check(spark, grids, box, seed, n):
    rnd = random.Random(seed)
    t = useful_tiles(spark, grids, box)
    flat = [tuple(r)[1:] for r in t.select("tile_id", "minlon", "minlat", "maxlon", "maxlat").orderBy("tile_id").collect()]
    assert flat[-1] == WORLD
    data = []
    for i in range(n):
        x, y = rnd.randint(-18, 18) * 10**8, rnd.randint(-9, 9) * 10**8
        if rnd.random() < 0.5:
            x, y = rnd.randint(-1800000000, 1800000000), rnd.randint(-900000000, 900000000)
        k = rnd.choice([0, 1, 1, 3])
        pts = [(max(-1800000000, min(1800000000, x + rnd.randint(-3, 3) * rnd.choice([0, 5 * 10**6]))), max(-900000000, min(900000000, y + rnd.randint(-3, 3) * 10**6))) for _ in range(k)]
        if box:  # the envelope of the data holds all points
            pts = [(max(box[0], min(box[2], a % (box[2] - box[0]) + box[0])), max(box[1], min(box[3], b % (box[3] - box[1]) + box[1]))) for a, b in pts]
        if rnd.random() < 0.05:
            pts.append((2147483647, 2147483647))
        data.append((rnd.choice("NWA"), i, pts))
    data.append(("C", n, []))
    df = spark.createDataFrame([(a, i, [{"lon": x, "lat": y} for x, y in p], None) for a, i, p in data], SCHEMA)
    got = {r["id"]: r["chunk_id"] for r in assign_tiles(df, grids, t).collect()}
    assert got == {i: len(flat) if a == "C" else scan(flat, p) for a, i, p in data}


def test_shipped_grid_equals_scan(spark):
    check(spark, default_tiles(), (100000000, 440000000, 130000000, 700000000), 1, 300)


def test_own_grids_equal_scan(spark):
    grids = parse_tiles("0 70 20 0 70 30\n-1800000000 1800000000 170000000 -900000000 900000000 110000000\n5 50000000 5 60000000")
    check(spark, grids, None, 2, 400)
    check(spark, [], None, 3, 50)


def test_envelope(spark):
    df = spark.createDataFrame([(1, 5, None), (2, -7, 8), (3, None, None)], "id int, lon int, lat int")
    assert tuple(bbox(df).collect()[0]) == (-7, 8, 5, 8)
    assert tuple(bbox(df.limit(0)).collect()[0]) == (None,) * 4
    assert expand(spark, default_tiles()).count() == 42339
