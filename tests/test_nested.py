import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geochunk.operators.nested import CHILD_COLUMNS, ROOT, VALUE, children, columns_of, elements, flatten_records, flatten_uploads, of_elements, repeated_names, rows_of, table, triples
from tests.conftest import rows


def test_children_of_every_shape(spark):
    doc = {
        "osm": {"create": [{"node": {"@id": "7", "tags": {"a": "1", "b": None}}}],
                "way": [{"id": 5, "nd": [{"ref": 1}, None, {"@ref": " 02"}, 9], "tag": [{"k": "x", "v": "y"}, {"@k": "x", "@v": "z"}, None]}, None],
                "deep": {"block": [{"relation": {"id": -3, "member": {"type": "way", "ref": 4}, "meta": {"node": {"id": 8, "tag": {"k": "q"}}}}}]}}}
    texts = [(1, json.dumps(doc)), (1, json.dumps(doc)), (2, None), (3, ""), (4, json.dumps(doc)[:-1]), (5, json.dumps(doc) + "x"), (6, "NaN"), (7, "[]"), (8, " {} ")]
    df = spark.createDataFrame([(i, t, "extra", 0) for i, t in texts], "upload_id bigint, payload string, tbl string, pos int")
    flat = flatten_uploads(df)
    assert rows(children(flat, "upload_id")) == sorted(
        [
            (1, "node", 7, "tag", -1, "a"), (1, "node", 7, "tag", -1, "b"), (1, "way", 5, "nd", 0, "1"), (1, "way", 5, "nd", 2, "2"),
            (1, "way", 5, "nd", 3, "9"), (1, "way", 5, "tag", -1, "x"), (1, "relation", -3, "member", 0, "way/4"), (1, "node", 8, "tag", -1, "q"),
        ], key=str)
    some = flatten_uploads(df, tables=("nd", "tag", "tags", "member"), columns=CHILD_COLUMNS)
    assert rows(children(some, "upload_id")) == rows(children(flat, "upload_id")) and "fields" not in some.columns
    assert rows(elements(flat, ()).select("elem_type", "elem_id").distinct()) == [("node", 7), ("node", 8), ("relation", -3), ("way", 5)]
    assert {(r["k"], r["v"]) for r in table(flat, ("tag", "tags"), ("k", "v")).collect()} >= {("x", "y"), ("x", "z"), ("a", "1"), ("b", None)}
    assert flatten_uploads(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(1, '{"way":{"id":1,"nd":5,"member":null}}'), (2, '{"way":{"id":1,"nd":5,"x":{"nd":6}}}')], "upload_id bigint, payload string")
    assert rows(children(flatten_uploads(lone), "upload_id")) == [(1, "way", 1, "nd", 0, "5"), (2, "way", 1, "nd", 0, "5")]


def test_no_tag_takes_the_place_of_another(spark):
    doc = {"node": {"id": 1, "tags": [{"a": "1", "b": "2"}, {"c": "3"}, {"k": "d", "v": "4"}], "tag": [{"k": "e", "v": "5"}, {"@k": "f"}]}}
    df = spark.createDataFrame([(1, json.dumps(doc))], "upload_id bigint, payload string")
    flat = flatten_uploads(df)
    assert rows(table(flat, ("tag", "tags"), ("k", "v")).select("k", "v", "pos")) == [("a", "1", 0), ("b", "2", 1), ("c", "3", 2), ("d", "4", 3), ("e", "5", 4), ("f", None, 5)]
    assert [r[5] for r in rows(children(flat, "upload_id"))] == ["a", "b", "c", "d", "e", "f"]


def test_nothing_is_lost_and_every_row_is_linked(spark):
    doc = {
        "generator": "g", "changeset": {"id": 3, "comment": None},
        "osm": {"modify": {"node": [{"id": 1, "meta": {"user": {"uid": 9}, "hints": [{"src": "gps", "acc": [1, [2, 3]]}, {"src": None}]}}, {"meta": {"hints": {"src": "one"}}}]}},
    }
    df = spark.createDataFrame([(1, json.dumps(doc)), (1, '{"generator":"h"}'), (None, json.dumps(doc))], "upload_id bigint, payload string")
    assert repeated_names(df, "payload") == {"node", "hints", "acc"}
    flat = flatten_records(df.where("upload_id = 1"), "upload_id", "payload", repeated_names(df, "payload"))
    assert rows(table(flat, ROOT, ("generator", "changeset/id", "changeset/comment")).select("row_id", "generator", "id", "comment")) == [(0, "g", "3", None), (0, "h", None, None)]
    node = table(flat, "node", ("id", "meta/user/uid"))
    assert rows(node.select("path", "pos", "id", "uid")) == [("osm/modify/node", 0, "1", "9"), ("osm/modify/node", 1, None, None)]
    hints = table(flat, "hints", ("src",))
    linked = hints.alias("h").join(node.alias("n"), F.expr("h.rec = n.rec and h.parent_id = n.row_id"))
    assert rows(linked.select("n.pos", "h.pos", "h.step", "h.src", "h.parent_key")) == [(0, 0, "meta/hints", "gps", "1"), (0, 1, "meta/hints", None, "1"), (1, 0, "meta/hints", "one", None)]
    assert rows(table(flat, "acc", (VALUE,)).select("parent_tbl", "pos", VALUE)) == [("acc", 0, "2"), ("acc", 1, "3"), ("hints", 0, "1"), ("hints", 1, None)]
    assert rows(of_elements(hints, direct=False).select("elem_type", "elem_id")) == [("node", 1), ("node", 1), ("node", None)]
    assert {(r["tbl"], r["column"]): r["n"] for r in columns_of(flat).collect()} == {
        ("$", "generator"): 2, ("$", "changeset/id"): 1, ("$", "changeset/comment"): 1, ("node", "id"): 1, ("node", "meta/user/uid"): 1, ("hints", "src"): 3, ("acc", VALUE): 3,
    }
    assert flatten_records(df, "upload_id", "payload").where("upload_id is null").count() == flatten_records(df, "upload_id", "payload").where("upload_id = 1").count() - 1


def test_maps_and_odd_names():
    text = '{"a":{"b":[1,{"c":2},[3,null]]},"b":{"c":7},"t":{"x":1,"y/z":{"q":[5]},"e":{}}}'
    got = list(triples(text, single={"b", "t"}, maps={"t"}))
    assert got == [
        ("a/b/value", (0,), "1"), ("a/b/c", (1,), "2"), ("a/b/value", (2, 0), "3"), ("a/b/value", (2, 1), None), ("b/c", (0,), "7"),
        ("t/k", (0,), "x"), ("t/v", (0,), "1"), ("t/k", (1,), "y/z"), ("t/v", (1,), None), ("t/k", (2,), "e"), ("t/v", (2,), None), ("t/y~1z/q/value", (1, 0), "5"),
    ]
    assert list(triples('{"a":1,"a":2}')) == [("a", (), "2")] and list(triples('[{"a":1}, 5]')) == [("a", (0,), "1"), (VALUE, (1,), "5")]


def test_very_deep_and_very_long_records(spark):
    deep = '{"x":' * 20000 + '{"node":{"id":1,"tag":{"k":"a"}}}' + "}" * 20000
    wide = json.dumps({"way": {"id": 2, "nd": [{"ref": i} for i in range(70000)]}})
    df = spark.createDataFrame([(1, deep), (2, wide), (3, deep[:-1])], "upload_id bigint, payload string")
    out = children(flatten_uploads(df), "upload_id")
    assert {r[0]: r[1] for r in out.groupBy("upload_id").count().collect()} == {1: 1, 2: 70000}


#: Names without the marks that paths give a meaning to.
names = st.text().filter(lambda s: s and not set(s) & set("/~@"))
values = st.recursive(
    st.none() | st.booleans() | st.integers() | st.text() | st.floats(allow_nan=False, allow_infinity=False),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(names, x, max_size=4), max_leaves=20,
)


def scalars(value, names=(), places=()):
    """What triples should give, by walking the parsed tree."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from scalars(v, (*names, k), places)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from scalars(v, (*names, None), (*places, i))
    else:
        yield places, value


@settings(max_examples=200, deadline=None)
@given(values, st.booleans(), st.integers(0, 60))
def test_agrees_with_the_library(value, indent, cut):
    text = json.dumps(value, indent=1 if indent else None, ensure_ascii=indent)
    want = [(p, v if isinstance(v, str) or v is None else json.dumps(v)) for p, v in scalars(value)]
    assert sorted(((p, v) for _, p, v in triples(text)), key=repr) == sorted(want, key=repr)
    broken = text[: max(0, len(text) - 1 - cut)]
    try:
        json.loads(broken)
        whole = True
    except ValueError:
        whole = False
    assert (rows_of(broken) is not None) == whole


@pytest.mark.parametrize("text", ["{,}", "[1,]", '{"a" 1}', "{1:2}", "[1 2]", "01", "-", '"\n"', "tru", "[}", '{"a":1,}', "[]]", "", " ", "1 2", ",1", '{"a":1 "b":2}', '{"a":}', "NaN", '"\\x"', "١"])
def test_broken_texts(text):
    assert rows_of(text) is None


def test_whole_texts():
    assert rows_of("[" + "9" * 6000 + "]")[1][-1] == {VALUE: "9" * 6000} and rows_of(' "a" ')[0][-1] == {VALUE: "a"} and rows_of(" { } ")[0][-1] == {}
