"""The engine's own queries cover what is built from relations: areas and turn lines."""

import datetime

import pytest

from geochunk.plans.queries import QUERIES
from geochunk.schema import NODES, RELATIONS, WAYS
from tests.conftest import rows

META = (1, 1, 1, 1, "u")
NOW = datetime.datetime(2026, 1, 1)


def square(i, x, y, w):
    """Nodes i..i+3 at the corners."""
    return [(i + k, *META, x + dx * w, y + dy * w, {}, True, NOW) for k, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


def ring(i):
    return [i, i + 1, i + 2, i + 3, i]


def member(t, r, role):
    return {"type": t, "ref": r, "role": role}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    inside, outside = (101_234_567, 451_234_567), (351_234_567, 451_234_567)
    nodes = square(1, *inside, 1000) + square(11, *inside, 900) + square(21, *outside, 1000) + square(31, *inside, 800) + square(41, *inside, 700)
    ways = [
        (1, ring(1), {}), (2, ring(11), {"building": "yes"}), (3, ring(21), {}), (4, [31, 32, 33], {}), (5, [33, 34, 31], {}),
        (6, [41, 42], {"highway": "track"}), (7, [42, 43], {"highway": "track"}), (8, [21, 22], {"highway": "track"}),
    ]
    relations = [
        (101, [member("way", 1, "outer")], {"type": "multipolygon", "building": "yes"}),
        (102, [member("way", 3, "outer")], {"type": "multipolygon", "building": "yes"}),
        (103, [member("way", 4, "outer"), member("way", 5, "outer"), member("way", 1, "outer")], {"type": "boundary", "building": "church"}),
        (104, [member("way", 4, "outer")], {"type": "multipolygon", "building": "yes"}),
        (105, [member("way", 6, "from"), member("node", 42, "via"), member("way", 7, "to")], {"type": "restriction"}),
        (106, [member("way", 6, "part"), member("relation", 101, "sub")], {"type": "route", "route": "bus"}),
    ]
    more = ", visible boolean, loaded_at timestamp"
    spark.createDataFrame(nodes, NODES + more).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(i, *META, n, t, True, NOW) for i, n, t in ways], WAYS + more).write.parquet(f"{d}/ways.parquet")
    spark.createDataFrame([(i, *META, m, t, True, NOW) for i, m, t in relations], RELATIONS + more).write.parquet(f"{d}/relations.parquet")
    return d


def test_read_pruned_gives_relations_areas(spark, folder):
    # 101 has one outer ring inside the box, 103 two, 102 lies outside, 104 has an open ring and so no area
    got = [(r[0], r[1], r[2]) for r in rows(QUERIES["read_pruned"](spark, folder))]
    assert got == [("A", 101, "building"), ("A", 103, "building"), ("A", 103, "building"), ("A", 2, "building"), ("W", 6, "highway"), ("W", 7, "highway")]


def test_elements_and_tiles_of_relations(spark, folder):
    union = {(r["type"], r["origin"]): (r["n"], r["id_sum"], r["n_links"]) for r in QUERIES["union_elements"](spark, folder).collect()}
    assert union == {("W", "way"): (4, 23, 1), ("A", "area"): (4, 101 + 102 + 2 * 103, 1), ("W", "turn"): (1, 105, 0), ("C", "collection"): (1, 106, 0)}
    at = {}
    for r in QUERIES["tile_elements"](spark, folder).collect():
        at.setdefault((r["type"], r["id"]), []).append(r["chunk_id"])
    assert {k: len(v) for k, v in at.items()} == {("W", 2): 1, ("W", 6): 1, ("W", 7): 1, ("W", 8): 1, ("A", 101): 1, ("A", 102): 1, ("A", 103): 2, ("W", 105): 1, ("C", 106): 1}
    assert at["A", 101] == at["W", 2] == at["W", 105] and at["A", 102] == at["W", 8] and set(at["A", 103]) == set(at["A", 101]) != set(at["A", 102])
    index = {(r["type"], r["chunk_id"]): r["n"] for r in QUERIES["chunk_index"](spark, folder).collect()}
    here, there = at["A", 101][0], at["A", 102][0]
    assert index == {("A", here): 3, ("A", there): 1, ("W", here): 4, ("W", there): 1, ("C", at["C", 106][0]): 1}


def test_blocks_and_slices_of_relations(spark, folder):
    n = {}
    for r in QUERIES["slice_counts"](spark, folder).collect():
        n[r["type"], r["block_key"]] = n.get((r["type"], r["block_key"]), 0) + r["n"]
    # areas: 101, 102, two of 103, and way 2; the turn is a way of no block
    assert n == {("A", "building"): 5, ("W", "highway"): 3, ("W", ""): 1, ("C", "route"): 1}
    assert {r["type"]: r["n_rows"] for r in QUERIES["block_stats"](spark, folder).collect()} == {"A": 5, "W": 4, "C": 1}
    one = rows(QUERIES["one_element"](spark, folder).select("type", "id", "block_key"))
    want = [("A", 2, "building"), ("A", 101, "building"), ("A", 102, "building"), ("A", 103, "building"), ("A", 103, "building")]
    assert one == sorted([*want, ("W", 6, "highway"), ("W", 7, "highway"), ("W", 8, "highway"), ("W", 105, ""), ("C", 106, "route")], key=str)
