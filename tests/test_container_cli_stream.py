import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geochunk import cli
from geochunk.config import Options, default_rules, parse_tiles
from geochunk.operators.tiling import useful_tiles
from geochunk.plans.convert import convert
from geochunk.sources import container as C
from geochunk.sources import encode
from geochunk.streaming.ingest import hourly_counts, stream_nodes
from tests.test_sink import data
from tests.test_sources import NODES, RELATIONS, WAYS


def flat(df):
    cols = ("type", "id", "block_key", "slice_value", "uid", "user")
    out = []
    for r in df.collect():
        r = r.asDict(True)
        out.append((*(r[c] for c in cols), str(r["pts"]), str(r["holes"]), str(sorted(r["tags"].items())), str(r["member_of"] or [])))
    return sorted(out)


@pytest.mark.parametrize("compression", ["zstd", "none"])
def test_container_round_trip(spark, tmp_path, compression, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 1)
    path = str(tmp_path / "x.gch")
    options = Options(preserve=("id", "user"), compression=compression)
    f, tiles = convert(data(spark), options)
    C.write_container(f, tiles, path, options, (1, 2, 3, 4))
    head = C.read_head(path)
    assert head["features"] == 17 and head["box"] == (1, 2, 3, 4) and head["deflate"] == (compression != "none")
    assert flat(C.read_container(spark, path)) == flat(f)
    got = C.read_container(spark, path, (0, 0, 1000, 1000), ["W"], "highway", "path").collect()
    assert {(r["id"], r["slice_value"]) for r in got} == {(4, "path"), (6, "path")}
    assert '"chunks"' in C.describe(path)
    with open(path, "r+b") as x:
        x.write(b"X")
    with pytest.raises(ValueError):
        C.read_head(path)


@given(st.integers(0, 2**31 - 1), st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**31), 2**31 - 1)), max_size=6), st.text())
def test_encoders(n, pts, text):
    w = C.Writer()
    w.small(n)
    w.line([{"lon": x, "lat": y} for x, y in [*pts, (32767, -32767), (0, 1), (32768, -32767)]])
    w.text(text)
    r = C.Reader(bytes(w))
    assert r.small() == n and [(p["lon"], p["lat"]) for p in r.line()][: len(pts)] == pts and r.text() == text and r.at == len(w)


def test_command_line(spark, tmp_path):
    src = tmp_path / "in.o5m"
    src.write_bytes(encode.o5m(NODES, WAYS, RELATIONS))
    cli.main(["-p", "all", "-s", str(src)])
    assert C.read_head(str(tmp_path / "in.gch"))["features"] == 31
    cli.main(["-1", "-0", str(src), str(tmp_path / "folder")])
    assert spark.read.parquet(f"{tmp_path}/folder/features").count() > 0
    assert spark.read.json(f"{tmp_path}/folder/header").collect()[0]["features"] == 32


def test_small_helpers():
    assert [cli.readable(n) for n in (7, 999, -5000, 1000, 12345, 123456, 1234567, 5 * 10**9)] == ["7", "999", "-5000", "1.00K", "12.3K", "123K", "1.23M", "5.00G"]
    assert [cli.from_readable(t) for t in ("12", "3k", "5G", "1E")] == [12, 3000, 5 * 10**9, 10**15]
    with pytest.raises(ValueError):
        cli.from_readable("5")
    assert cli.replace_extension("/a.b/c.osm.pbf", "gch") == "/a.b/c.osm.gch" and cli.replace_extension("/a.b/c", "gch") == "/a.b/c.gch"


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(i % 20, 1, i % 20 != 3, t + datetime.timedelta(minutes=i), 10 + i, 20, {"natural": "tree"} if i % 2 else {}) for i in range(40)]
    schema = "id bigint, version int, visible boolean, loaded_at timestamp, lon int, lat int, tags map<string,string>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    grids = parse_tiles("0 100 50 0 100 50")
    tiles = useful_tiles(spark, grids, None)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = stream_nodes(stream(), grids, tiles, default_rules(), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("id").distinct().count() == got.count() == 19
    assert got.where("block_key = 'natural'").count() == 9
    q = hourly_counts(stream()).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r)[1:] for r in spark.table("hours").orderBy(F.col("hour")).collect()] == [(40, 2)]
