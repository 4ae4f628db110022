import datetime

from geochunk.operators.elements import all_live_tags, current_rows, live, located, with_terms
from geochunk.operators.tags import clean, preserve
from geochunk.schema import NODES
from tests.conftest import rows

T = [datetime.datetime(2024, 1, d) for d in range(1, 10)]
SCHEMA = "id bigint, version int, visible boolean, loaded_at timestamp, lon int, lat int, tags map<string,string>, n int, r string"


def test_current_row_is_highest_version_loaded_first(spark):
    df = spark.createDataFrame(
        [
            (1, 1, True, T[0], 1, 1, {}, 0, "x"), (1, 2, True, T[2], 2, 2, {}, 0, "x"), (1, 2, False, T[3], 3, 3, {}, 0, "x"),
            (2, 1, True, T[0], 5, 5, None, 0, "x"), (2, 1, True, T[0], 5, 5, None, 0, "x"), (2, 2, False, T[1], None, None, None, 0, "x"),
            (3, None, True, None, 7, 7, {}, 0, "x"), (None, 9, True, T[0], 8, 8, {}, 0, "x"), (4, 1, None, T[0], 9, 9, {}, 0, "x"),
        ],
        SCHEMA,
    )
    assert rows(current_rows(df, ["lon"], True).select("id", "visible", "lon")) == [(1, True, 2), (2, False, None), (3, True, 7), (4, None, 9)]
    assert rows(live(df, ["lon"]).select("id", "lon")) == [(1, 2), (3, 7)]
    assert rows(current_rows(df, [], True).select("id", "first_loaded"))[0] == (1, T[0])
    assert current_rows(df.limit(0), ["lon", "tags"]).count() == 0


def test_located_needs_a_possible_position(spark):
    spots = [(0, 0), (0, 1), (None, 1), (1, None), (1800000000, 900000000), (1800000001, 0), (5, -900000001), (-1800000000, 3)]
    df = spark.createDataFrame([(i, 1, True, T[0], x, y, {}, 0, "") for i, (x, y) in enumerate(spots)], SCHEMA)
    assert [r[0] for r in rows(located(df))] == [1, 4, 7]


def test_terms(spark):
    tags = [
        {"cuisine": "Thai; thai ;\t Phó;;", "created_by": "x", "note": None},
        {"name": "é"}, {"name": ";"}, {"a": ""}, {}, None, {"k": "v;" * 5000},
    ]
    df = spark.createDataFrame(list(enumerate(tags)), "id int, tags map<string,string>")
    got = {r["id"]: [tuple(t) for t in r["terms"]] for r in with_terms(df).collect()}
    assert got[0] == [("cuisine", "thai"), ("cuisine", "thai"), ("cuisine", "phó")]
    assert got[1] == [("name", "é")]
    assert got[2] == [("name", ";")]  # normalised after splitting
    assert got[3] == got[4] == got[5] == []
    assert len(got[6]) == 5000


def test_union_keeps_kinds_apart(spark):
    df = spark.createDataFrame([(1, 1, True, T[0], 1, 1, {"a": "b"}, 0, "x")], SCHEMA)
    assert rows(all_live_tags(df, df, df).select("kind", "id")) == [("n", 1), ("r", 1), ("w", 1)]


def test_discarding_and_preserving(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, "u", 6, 7, {"created_by": "x", "a": None}), (2, None, None, None, None, None, 1, 1, None)], NODES)
    assert [r["tags"] for r in clean(df).orderBy("id").collect()] == [{"a": ""}, {}]
    kept = preserve(df, ["timestamp", "user"]).orderBy("id").select("version", "timestamp", "changeset", "uid", "user").collect()
    assert [tuple(r) for r in kept] == [(0, 3, 0, 5, "u"), (0, 0, 0, 0, "")]
