import random

from pyspark.sql import functions as F

from geochunk.operators.hotkeys import first_tile, heavy_hashes, salted_aggregate, tile_index
from tests.conftest import rows


def test_salting_changes_nothing(spark):
    rnd = random.Random(5)
    data = [(i, "hot" if i % 3 else rnd.choice(["a", "b", None, ""]), rnd.choice([None, 1, 2, 3])) for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, k string, v int")
    part = {"n": F.count("*"), "s": F.sum("v"), "m": F.max("v")}
    merge = {"n": F.sum("n"), "s": F.sum("s"), "m": F.max("m")}
    plain = df.groupBy("k").agg(*(c.alias(n) for n, c in part.items()))
    for share in (0.0001, 0.2, 1.1):
        assert rows(salted_aggregate(df, ["k"], ["id"], part, merge, share, 8)) == rows(plain)
    hashes = {r["h"]: r["k"] for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert [hashes[h] for h in heavy_hashes(df, ["k"], 0.5)] == ["hot"] and heavy_hashes(df.limit(0), ["k"], 0.5) == []
    assert None in {hashes[h] for h in heavy_hashes(df.where("k is null or k = 'a'"), ["k"], 0.3)}
    assert salted_aggregate(df.limit(0), ["k"], ["id"], part, merge).count() == 0


def test_first_tile_equals_scan(spark):
    rnd = random.Random(9)
    tiles = [(i, x := rnd.randint(-170, 170) * 10**7 + rnd.choice([0, 0, 12345]), y := rnd.randint(-80, 80) * 10**7, x + rnd.choice([5 * 10**6, 10**7, 3 * 10**7]), y + 10**7) for i in range(150)]
    tiles += [(150, 5, 5, 4, 9), (151, -1800000000, -900000000, 1800000000, 850000000)]
    pts = [(i, *rnd.choice([(rnd.randint(-1800000000, 1800000000), rnd.randint(-900000000, 900000000)), tiles[i % 150][1:3], tiles[i % 150][3:5]])) for i in range(600)]
    df = spark.createDataFrame([(*p, "mine") for p in pts] + [(1000, None, 1, "mine")], "id bigint, lon int, lat int, cx string")
    t = spark.createDataFrame(tiles, "tile_id int, minlon int, minlat int, maxlon int, maxlat int")
    want = {i: min((k for k, a, b, c, d in tiles if a <= x <= c and b <= y <= d), default=None) for i, x, y in pts} | {1000: None}
    out = first_tile(df, t)
    assert {r["id"]: r["tile_id"] for r in out.collect()} == want and out.columns == ["id", "lon", "lat", "cx", "tile_id"]
    assert first_tile(df, t.limit(0)).where("tile_id is not null").count() == 0
    assert tile_index(t.limit(0)).count() == 0
