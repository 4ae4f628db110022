import io

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from geochunk import schema as S
from geochunk.sources import encode, o5m, pbf
from geochunk.sources.read import read, sniff
from geochunk.sources.varint import Cursor, signed, unsigned, unsigned_array
from geochunk.sources.xml import read_xml, write_xml

META = {"version": 2, "timestamp": 1700000000, "changeset": 9, "uid": 3, "user": "ü"}
NONE = {"version": 0, "timestamp": 0, "changeset": 0, "uid": 0, "user": ""}
NODES = [
    {"id": 5, **META, "lon": -12345678, "lat": 480000001, "tags": {"a": "b", "long": "x" * 300}},
    {"id": -7, **NONE, "lon": 1, "lat": -2, "tags": {}},
    {"id": 2**40, **META, "uid": 0, "user": "", "lon": 1799999999, "lat": -899999999, "tags": {"a": "b", "long": "x" * 300}},
] + [{"id": 100 + i, **META, "user": f"u{i % 7}", "lon": i, "lat": -i, "tags": {f"k{i % 200}": "v"}} for i in range(2500)]
WAYS = [{"id": 1, **META, "nds": [5, -7, 5], "tags": {"highway": "path"}}, {"id": 2, **META, "nds": [], "tags": {}}]
RELATIONS = [
    {"id": 9, **META, "members": [{"type": t, "ref": r, "role": x} for t, r, x in (("way", 1, "outer"), ("node", 5, ""), ("relation", 9, "sub"), ("way", 2, "outer"))], "tags": {"type": "multipolygon"}},
    {"id": 10, **NONE, "members": [], "tags": {}},
]


def dicts(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("format", ["pbf", "o5m"])
def test_binary_formats(spark, tmp_path, format):
    path = tmp_path / "any.name"
    path.write_bytes(getattr(encode, format)(NODES, WAYS, RELATIONS))
    assert sniff(str(path)) == format
    got = read(spark, str(path))
    for df, want in ((got.nodes, NODES), (got.ways, WAYS), (got.relations, RELATIONS)):
        assert dicts(df) == sorted(want, key=lambda r: r["id"])
    for kind, want in (("node", NODES), ("way", WAYS), ("relation", RELATIONS)):
        df = spark.read.format({"pbf": "osmpbf"}.get(format, format)).option("kind", kind).load(f"file://{path}")
        assert dicts(df) == sorted(want, key=lambda r: r["id"])
    path.write_bytes(getattr(encode, format)())
    assert read(spark, str(path)).nodes.count() == 0
    with pytest.raises(FileNotFoundError):
        read(spark, str(tmp_path / "none"))


def test_o5m_is_read_piece_by_piece(monkeypatch):
    data = encode.o5m(NODES, WAYS, RELATIONS)
    whole = list(o5m.decode(io.BytesIO(data), ("node", "way", "relation")))
    for n in (1, 13, 4096):
        monkeypatch.setattr(o5m, "READ_BYTES", n)
        assert list(o5m.decode(io.BytesIO(data), ("node", "way", "relation"))) == whole
    with pytest.raises(EOFError):
        list(o5m.decode(io.BytesIO(data[: len(data) // 2 + 3]), ("node",)))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_arrays_of_varints(values):
    data = b"".join(map(unsigned, values))
    assert unsigned_array(b"\xff" + data, 1, 1 + len(data)).tolist() == values
    if data:
        with pytest.raises(EOFError):
            unsigned_array(data[:-1] + b"\x80", 0, len(data))


def test_dense_tags_of_repeated_keys():
    block = pbf._Block(b"")
    block.strings = ["", "a", "b", "c"]
    words = b"".join(map(unsigned, [1, 2, 1, 3, 2, 2, 0, 0, 3, 1, 0]))
    got = block.dense_tags(Cursor(words), 4, pa.array(block.strings))
    assert [dict(x) for x in got.to_pylist()] == [{"a": "c", "b": "b"}, {}, {"c": "a"}, {}]
    words = b"".join(map(unsigned, [1, 2, 0, 1, 0, 0]))  # an empty text as the second node's value
    assert block.dense_tags(Cursor(words), 2, pa.array(block.strings)).to_pylist() == [[("a", "b")], [("a", "")]]
    words = b"".join(map(unsigned, [1, 2, 1, 3, 2, 2, 0, 0, 3, 1, 0, 0]))
    assert [dict(x) for x in block.dense_tags(Cursor(words), 4, pa.array(block.strings)).to_pylist()] == [{"a": "c", "b": "b"}, {}, {"c": "a"}, {}]
    assert block.dense_tags(None, 2, pa.array(block.strings)).to_pylist() == [[], []]


def test_xml_written_and_read(spark, tmp_path):
    for kind, want, schema in (("node", NODES, S.NODES), ("way", WAYS, S.WAYS), ("relation", RELATIONS, S.RELATIONS)):
        write_xml(spark.createDataFrame([tuple(r.values()) for r in want], schema), kind, f"{tmp_path}/{kind}")
        assert dicts(read_xml(spark, f"{tmp_path}/{kind}", kind, exact=True)) == sorted(want, key=lambda r: r["id"])


def test_xml_details(spark, tmp_path):
    path = tmp_path / "x.osm"
    path.write_text("""<?xml version='1.0'?><osm><bounds minlat="1" minlon="1" maxlat="2" maxlon="2"/>
    <node id="1" lat="-1.2345678" lon="1.2345678" timestamp="1970-01-01T00:01:00Z"><tag k="a" v="1"/><tag k="a" v="2"/></node><node id="2"/>
    <way id="3"><nd ref="1"/></way><relation id="4"><member type="way" ref="3"/></relation></osm>""")
    assert sniff(str(path)) == "xml"
    x = read(spark, str(path))
    one, two = dicts(x.nodes)
    assert (one["lat"], one["lon"], one["timestamp"], one["tags"]) == (-12345677, 12345678, 60, {"a": "2"})  # cut toward zero
    assert (two["lat"], two["version"], two["user"]) == (None, 0, "")
    assert [r["lat"] for r in dicts(read_xml(spark, str(path), "node", exact=True))] == [-12345678, None]
    assert dicts(x.ways)[0]["nds"] == [1] and dicts(x.relations)[0]["members"] == [{"type": "way", "ref": 3, "role": ""}]
    path.write_text("<a/>")
    with pytest.raises(EOFError):
        sniff(str(path))


@given(st.integers(-(2**63), 2**63 - 1))
def test_varints(v):
    assert Cursor(signed(v)).signed() == v
    assert Cursor(unsigned(abs(v))).unsigned() == abs(v)


def test_varints_cut_short():
    with pytest.raises(EOFError):
        Cursor(b"\x80").unsigned()
