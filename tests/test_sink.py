from pyspark.sql import functions as F

from geochunk.config import Options
from geochunk.plans.convert import convert
from geochunk.schema import NODES, RELATIONS, WAYS
from geochunk.sources import sink
from geochunk.sources.read import Dataset
from tests.conftest import rows

META = (1, 1, 1, 1, "u")


def member(t, r, role):
    return {"type": t, "ref": r, "role": role}


def data(spark):
    places = [(1, 10, 10), (2, 10, 900), (3, 900, 900), (4, 900, 10), (5, 100, 100), (6, 100, 200), (7, 200, 200), (8, 20000000, 20000000)]
    nodes = [(i, *META, x, y, {"natural": "tree"} if i == 8 else {"created_by": "x"} if i == 7 else {}) for i, x, y in places]
    ways = [
        (1, *META, [1, 2, 3], {}), (2, *META, [3, 4, 1], {}), (3, *META, [5, 6, 7, 5], {}), (4, *META, [1, 2, 3, 4, 1], {"building": "yes", "highway": "path"}),
        (5, *META, [8, 99], {"highway": "track"}), (6, *META, None, {"highway": "path"}),
    ]
    rels = [
        (1, *META, [member("way", 1, "outer"), member("way", 2, "outer"), member("way", 3, "inner"), member("node", 7, "label"), None], {"type": "multipolygon", "landuse": "forest"}),
        (2, *META, [member("way", 1, "from"), member("node", 3, "via"), member("way", 2, "to")], {"type": "restriction", "restriction": "no_left_turn"}),
        (3, *META, [member("way", 5, None), member("relation", 1, "sub"), member("odd", 1, "x")], {"type": "route", "route": "bus"}),
        (4, *META, None, None),
    ]
    return Dataset(spark.createDataFrame(nodes, NODES), spark.createDataFrame(ways, WAYS), spark.createDataFrame(rels, RELATIONS))


def test_conversion_end_to_end(spark, tmp_path):
    f, tiles = convert(data(spark), Options(preserve=("id", "user")))
    got = rows(f.select("type", "origin", "id", "block_key", "slice_value", F.size("pts").alias("n"), F.size("holes").alias("h")))
    assert got == sorted(
        [
            ("N", "node", 7, "", "", 1, 0), ("N", "node", 8, "natural", "tree", 1, 0), ("A", "area", 1, "landuse", "forest", 5, 1),
            ("A", "way", 4, "building", "yes", 4, 0), ("W", "way", 4, "building", "", 5, 0), ("W", "way", 4, "highway", "path", 5, 0),
            ("W", "way", 5, "highway", "track", 2, 0), ("W", "way", 6, "highway", "path", 0, 0), ("W", "turn", 2, "", "", 3, 0),
            ("C", "collection", 1, "", "", 0, 0), ("C", "collection", 3, "route", "bus", 0, 0),
        ], key=str)
    links = {(r["type"], r["id"]): [tuple(m) for m in r["member_of"]] for r in f.where("member_of is not null").collect()}
    assert links == {("N", 7): [(1, "label", 0)], ("W", 5): [(3, "", 0)], ("A", 1): [(3, "sub", 1)], ("C", 1): [(3, "sub", 1)]}
    assert {(r["version"], r["uid"], r["user"]) for r in f.collect()} == {(0, 1, "u")}
    n = tiles.count()
    at = {r["id"]: r["chunk_id"] for r in f.where("type = 'W' and origin = 'way'").collect()}
    assert at[6] == 0 and at[5] == n and at[4] < n

    path = str(tmp_path / "out")
    sink.write(f, tiles, path)
    assert rows(sink.read_features(spark, path).select("type", "id", "block_key")) == rows(f.select("type", "id", "block_key"))
    assert rows(sink.read_features(spark, path, (0, 0, 1000, 1000), ["A"], "building", "yes").select("id")) == [(4,)]
    assert rows(sink.read_features(spark, path, (15000000, 15000000, 30000000, 30000000)).select("id").distinct()) == [(5,), (8,)]
    assert {(r["type"], r["n_features"]) for r in spark.read.parquet(path + "/chunks").groupBy("type").agg(F.sum("n_features").alias("n_features")).collect()} == {("N", 2), ("W", 5), ("A", 2), ("C", 2)}
    plan = sink.read_features(spark, path, None, ["A"], "building")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "PushedFilters: [IsNotNull(block_key)" in plan


def test_nothing(spark):
    d = data(spark)
    f, tiles = convert(Dataset(d.nodes.limit(0), d.ways.limit(0), d.relations.limit(0)))
    assert f.count() == 0 and tiles.count() == 42339
