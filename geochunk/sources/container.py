"""One-file container of features: header, chunks of blocks of slices with jump tables, and a chunk table at the end.

Chunks are made side by side, each from its sorted rows, and written as parts to the shared folder; the driver only joins
the parts, in a stream. Reading takes the chunk table and decodes the chunks wanted, each in its own task.
All numbers are big-endian. Small whole numbers take 1, 3 or 7 bytes; coordinates are 16-bit steps, or an escape and the
value; steps begin at 0 in every slice.
"""

from __future__ import annotations

import json
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geochunk.config import FEATURES, Options, Rules, default_rules
from geochunk.schema import NOWHERE, TYPES
from geochunk.session import broadcast_checked, work_dir
from geochunk.sources.sink import VERSION, chunk_index

#: Fixed value: first bytes of a file.
MAGIC = b"OMA"
#: Rows of one physical chunk; a tile with more gets several chunks with the same bounds.
CHUNK_ROWS = 200_000

NO_BOUNDS = (NOWHERE,) * 4


class Writer(bytearray):
    x = y = 0

    def i16(self, v: int) -> None:
        self += struct.pack(">h", v)

    def i32(self, v: int) -> None:
        self += struct.pack(">i", v)

    def i64(self, v: int) -> None:
        self += struct.pack(">q", v)

    def small(self, v: int) -> None:
        self += struct.pack(">B", v) if v < 255 else struct.pack(">BH", 255, v) if v < 65535 else struct.pack(">BHi", 255, 65535, v)

    def text(self, s: str) -> None:
        b = s.encode()
        self.small(len(b))
        self += b

    def _step(self, last: int, v: int) -> int:
        d = v - last
        self.i16(d if -32767 <= d <= 32767 else -32768)
        if not -32767 <= d <= 32767:
            self.i32(v)
        return v

    def point(self, p: dict) -> None:
        self.x, self.y = self._step(self.x, p["lon"]), self._step(self.y, p["lat"])

    def line(self, pts: Sequence[dict]) -> None:
        self.small(len(pts))
        for p in pts:
            self.point(p)

    def put_i32(self, at: int, v: int) -> None:
        self[at : at + 4] = struct.pack(">i", v)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.x, self.y = data, at, 0, 0

    def _get(self, form: str):
        (v,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return v

    def i32(self) -> int:
        return self._get(">i")

    def i64(self) -> int:
        return self._get(">q")

    def byte(self) -> int:
        return self._get(">B")

    def small(self) -> int:
        v = self.byte()
        if v == 255:
            v = self._get(">H")
            if v == 65535:
                v = self.i32()
        return v

    def text(self) -> str:
        n = self.small()
        self.at += n
        return self.data[self.at - n : self.at].decode()

    def _step(self, last: int) -> int:
        d = self._get(">h")
        return self.i32() if d == -32768 else last + d

    def point(self) -> dict:
        self.x = self._step(self.x)
        self.y = self._step(self.y)
        return {"lon": self.x, "lat": self.y}

    def line(self) -> list[dict]:
        return [self.point() for _ in range(self.small())]


def put_row(w: Writer, r: dict, features: int) -> None:
    """Geometry, tags, members, metadata by feature bits; a collection always has its id."""
    kind = r["type"]
    if kind == "N":
        w.point(r["pts"][0])
    elif kind == "C":
        w.small(0)
    else:
        w.line(r["pts"])
        if kind == "A":
            w.small(len(r["holes"]))
            for h in r["holes"]:
                w.line(h)
    w.small(len(r["tags"]))
    for k, v in r["tags"]:
        w.text(k)
        w.text(v or "")
    links = r["member_of"] or []
    w.small(len(links))
    for m in links:
        w.i64(m["id"])
        w.text(m["role"] or "")
        w.small(m["nr"])
    if features & 1 or kind == "C":
        w.i64(r["id"])
    if features & 2:
        w.small(r["version"])
    if features & 4:
        w.i64(r["timestamp"])
    if features & 8:
        w.i64(r["changeset"])
    if features & 16:
        w.i32(r["uid"])
        w.text(r["user"])


def get_row(c: Reader, kind: str, features: int) -> dict:
    r: dict = {"type": kind, "pts": [], "holes": []}
    if kind == "N":
        r["pts"] = [c.point()]
    elif kind == "C":
        c.small()
    else:
        r["pts"] = c.line()
        if kind == "A":
            r["holes"] = [c.line() for _ in range(c.small())]
    r["tags"] = [(c.text(), c.text()) for _ in range(c.small())]
    r["member_of"] = [{"id": c.i64(), "role": c.text(), "nr": c.small()} for _ in range(c.small())]
    r["id"] = c.i64() if features & 1 or kind == "C" else 0
    r["version"] = c.small() if features & 2 else 0
    r["timestamp"] = c.i64() if features & 4 else 0
    r["changeset"] = c.i64() if features & 8 else 0
    r["uid"], r["user"] = (c.i32(), c.text()) if features & 16 else (0, "")
    return r


def _slice(rows: list[dict], features: int, deflate: bool) -> bytes:
    w = Writer()
    for r in rows:
        put_row(w, r, features)
    body = zlib.compress(bytes(w), 9) if deflate else bytes(w)
    return struct.pack(">i", len(rows)) + (struct.pack(">i", len(body)) if deflate else b"") + body


def _with_table(parts: list[tuple[str, bytes]]) -> bytes:
    """Parts after the offset of their jump table."""
    w, starts = Writer(4), []
    for name, body in parts:
        starts.append((len(w), name))
        w += body
    w.put_i32(0, len(w))
    w.small(len(starts))
    for at, name in starts:
        w.i32(at)
        w.text(name)
    return bytes(w)


def encode_chunk(rows: list[dict], features: int, deflate: bool) -> bytes:
    """A chunk from rows in order of block and slice."""
    blocks = []
    for key, block in groupby(rows, lambda r: r["block_key"]):
        slices = [(value, _slice(list(x), features, deflate)) for value, x in groupby(block, lambda r: r["slice_value"])]
        blocks.append((key, _with_table(slices)))
    return _with_table(blocks)


def decode_chunk(data: bytes, kind: str, features: int, deflate: bool, key: str | None = None, value: str | None = None) -> Iterator[dict]:
    """Rows of a chunk, or of one key and value, found by the jump tables."""

    def table(at: int) -> list[tuple[str, int]]:
        c = Reader(data, at)
        c.at = at + c.i32()
        return [(at + c.i32(), c.text())[::-1] for _ in range(c.small())]

    for block_key, block in table(0):
        if key is not None and block_key != key:
            continue
        for slice_value, at in table(block):
            if value is not None and slice_value != value:
                continue
            c = Reader(data, at)
            n = c.i32()
            if deflate:
                size = c.i32()
                c = Reader(zlib.decompress(data[c.at : c.at + size]))
            for _ in range(n):
                yield get_row(c, kind, features) | {"block_key": block_key, "slice_value": slice_value}


def _head(features: int, box: Sequence[int], deflate: bool, rules: Rules) -> bytes:
    w = Writer(MAGIC)
    w += bytes([VERSION, features])
    for v in box:
        w.i32(v)
    w.i64(0)  # place of the chunk table, put in at the end
    w += b"c"
    name = "DEFLATE" if deflate else "NONE"
    w.i32(len(w) + 5 + len(name))
    w.text(name)
    t = Writer()
    t.small(4)
    for kind in "NWAC":
        t += kind.encode()
        t.small(len(rules.of(kind)))
        for r in rules.of(kind):
            t.text(r.key)
            values = r.area_values if kind == "A" else r.values
            t.small(len(values))
            for v in values:
                t.text(v)
    body = zlib.compress(bytes(t), 9) if deflate else bytes(t)
    w += bytes([ord("t") + (128 if deflate else 0)])
    w.i32(len(w) + 4 + 4 * deflate + len(body))
    if deflate:
        w.i32(len(body))
    w += body
    w += b"\0"
    return bytes(w)


_COLUMNS = ("type", "chunk_id", "part", "block_key", "slice_value", "pts", "holes", "tags", "member_of", "id", "version", "timestamp", "changeset", "uid", "user")


def write_container(features: DataFrame, tiles: DataFrame, path: str, options: Options = Options(), box: Sequence[int] = NO_BOUNDS) -> None:
    """Write features to one local file. options.compression ``none`` leaves slices uncompressed, all else deflates."""
    spark, bits, deflate = features.sparkSession, options.feature_bits, options.compression != "none"
    folder = Path(f"{work_dir(spark)}/{uuid.uuid4().hex[:12]}".removeprefix("file://").removeprefix("file:"))
    folder.mkdir(parents=True)
    index = chunk_index(features, tiles)
    parts = index.select("type", "chunk_id", F.ceil(F.col("n_features") / CHUNK_ROWS).cast("int").alias("parts"))
    f = features.join(broadcast_checked(parts), ["type", "chunk_id"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    order = ["type", "chunk_id", "part", "key_ord", "value_ord", "id"]
    f = f.repartition("type", "chunk_id", "part").sortWithinPartitions(*order).select(*_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        rows = (r for b in batches for r in b.to_pylist())
        for (kind, chunk, part), group in groupby(rows, lambda r: (r["type"], r["chunk_id"], r["part"])):
            name = uuid.uuid4().hex
            (folder / name).write_bytes(encode_chunk(list(group), bits, deflate))
            done.append((kind, chunk, part, name))
        yield pa.RecordBatch.from_pylist([dict(zip(("type", "chunk_id", "part", "name"), x)) for x in done], pa.schema([("type", pa.string()), ("chunk_id", pa.int32()), ("part", pa.int64()), ("name", pa.string())]))

    written = f.mapInArrow(run, "type string, chunk_id int, part bigint, name string").collect()  # one row a physical chunk
    bounds = {r["chunk_id"]: tuple(r)[1:] for r in index.select("chunk_id", "minlon", "minlat", "maxlon", "maxlat").distinct().collect()}
    table = []
    with open(path, "wb") as out:
        out.write(_head(bits, box, deflate, default_rules(options.rules)))
        for r in sorted(written, key=lambda r: (TYPES.index(r["type"]), r["chunk_id"], r["part"])):
            b = bounds[r["chunk_id"]]
            table.append((out.tell(), r["type"], NO_BOUNDS if b[0] is None else b))
            with open(folder / r["name"], "rb") as part:
                shutil.copyfileobj(part, out)
        end = out.tell()
        out.write(struct.pack(">i", len(table)))
        for start, kind, b in table:
            out.write(struct.pack(">qc4i", start, kind.encode(), *b))
        out.seek(21)
        out.write(struct.pack(">q", end))
    shutil.rmtree(folder)


def read_head(path: str) -> dict:
    """version, features, box, deflate, and chunks as (start, end, type, bounds)."""
    with open(path, "rb") as f:
        magic, version, bits, *box, table = struct.unpack(">3sBB4iq", f.read(29))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} is no container of version {VERSION}")
        head = Reader(f.read(16))
        head.at = 5
        codec = head.text() if head.data[:1] == b"c" else "NONE"
        f.seek(table)
        (n,) = struct.unpack(">i", f.read(4))
        rows = [struct.unpack(">qc4i", f.read(25)) for _ in range(n)]
    ends = [r[0] for r in rows[1:]] + [table]
    chunks = [(r[0], end, r[1].decode(), tuple(r[2:])) for r, end in zip(rows, ends)]
    return {"version": version, "features": bits, "box": tuple(box), "deflate": codec == "DEFLATE", "chunks": chunks}


_OUT = (
    "type string, block_key string, slice_value string, id bigint, version int, timestamp bigint, changeset bigint, uid int, user string, "
    "pts array<struct<lon:int,lat:int>>, holes array<array<struct<lon:int,lat:int>>>, tags map<string,string>, member_of array<struct<id:bigint,role:string,nr:int>>"
)


def read_container(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, types: Sequence[str] | None = None, key: str | None = None, value: str | None = None) -> DataFrame:
    """Features of a container: only chunks that meet the box (or have no bounds) and types, only blocks and slices of the
    key and value, are read and decoded, each chunk in a task of its own. The path must be readable by the executors."""
    head = read_head(path)
    bits, deflate = head["features"], head["deflate"]
    meets = lambda b: b == NO_BOUNDS or box is None or (b[2] >= box[0] and b[0] <= box[2] and b[3] >= box[1] and b[1] <= box[3])
    wanted = [(start, end, kind) for start, end, kind, b in head["chunks"] if meets(b) and (not types or kind in types)]
    point = pa.struct([("lon", pa.int32()), ("lat", pa.int32())])
    schema = pa.schema(
        [(c, pa.string()) for c in ("type", "block_key", "slice_value")] + [("id", pa.int64()), ("version", pa.int32()), ("timestamp", pa.int64()), ("changeset", pa.int64()), ("uid", pa.int32()), ("user", pa.string())]
        + [("pts", pa.list_(point)), ("holes", pa.list_(pa.list_(point))), ("tags", pa.map_(pa.string(), pa.string())), ("member_of", pa.list_(pa.struct([("id", pa.int64()), ("role", pa.string()), ("nr", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                for r in b.to_pylist():
                    f.seek(r["start"])
                    rows = list(decode_chunk(f.read(r["end"] - r["start"]), r["kind"], bits, deflate, key, value))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    chunks = spark.createDataFrame(wanted, "start bigint, end bigint, kind string")
    return chunks.repartition(max(1, min(len(wanted), 1000))).mapInArrow(run, _OUT)


def describe(path: str) -> str:
    """The head of a container as JSON, for people."""
    h = read_head(path)
    names = [n for n, b in FEATURES.items() if h["features"] & b]
    return json.dumps({"version": h["version"], "features": names, "box": h["box"], "compression": "DEFLATE" if h["deflate"] else "NONE", "chunks": len(h["chunks"])})
