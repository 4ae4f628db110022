"""PBF extracts: blobs of primitive blocks, decoded independently of each other, one input partition per run of blobs.

A block becomes Arrow batches; numbers of packed fields are decoded as arrays.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Collection, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geochunk import schema as S
from geochunk.sources.files import input_files, open_file
from geochunk.sources.rows import KINDS, batch, with_kind
from geochunk.sources.varint import Cursor, unsigned_array

#: Features of a file this reader knows.
KNOWN_FEATURES = ("OsmSchema-V0.6", "DenseNodes")
#: Blobs decoded by one task; files whose blobs are listed at a time; bytes from which a packed field is worth an array.
BLOBS_A_TASK, LISTED_AT_ONCE, LEAST_ARRAY = 8, 16, 32


def fields(c: Cursor) -> Iterator[tuple[int, int | Cursor]]:
    """(number, value) of a message's fields; byte fields come as cursors."""
    while c:
        key = c.unsigned()
        kind = key & 7
        if kind == 0:
            yield key >> 3, c.unsigned()
        elif kind == 2:
            yield key >> 3, c.part(c.unsigned())
        elif kind in (1, 5):
            yield key >> 3, c.part(8 if kind == 1 else 4)
        else:
            raise ValueError(f"wire type {kind}")


def _zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _int(v: int) -> int:
    """A number of 64 bits as a signed one."""
    return v - (1 << 64) if v >= 1 << 63 else v


def _array(c: Cursor, signed: bool = False, delta: bool = False) -> np.ndarray:
    v = unsigned_array(c.data, c.at, c.end)
    out = (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64) if signed else v.astype(np.int64)
    return np.cumsum(out) if delta else out


def _packed(c: Cursor, signed: bool = False, delta: bool = False) -> list[int]:
    if c.end - c.at >= LEAST_ARRAY:
        return _array(c, signed, delta).tolist()
    out, last = [], 0
    while c:
        v = c.signed() if signed else _int(c.unsigned())
        last = last + v if delta else v
        out.append(last)
    return out


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(type, offset, size) of every blob; only headers are read."""
    out, at = [], 0
    with open_file(path) as f:
        size = f.size()
        while at < size:
            f.seek(at)
            (n,) = struct.unpack(">i", f.read(4))
            head = dict(fields(Cursor(f.read(n))))
            kind, length = bytes(head[1].rest()).decode(), head[3]
            if kind not in ("OSMHeader", "OSMData"):
                raise ValueError(f"{path}: unknown blob {kind!r}")
            out.append((kind, at + 4 + n, length))
            at += 4 + n + length
    return out


def inflate(data: bytes) -> bytes:
    """Content of a blob, raw or zlib."""
    f = dict(fields(Cursor(data)))
    if 3 in f:
        return zlib.decompress(f[3].rest())
    if 1 in f:
        return f[1].rest()
    raise ValueError("a blob is neither raw nor zlib")


def header(data: bytes) -> dict:
    """bbox (minlon, minlat, maxlon, maxlat in 1e-7 degrees) and features of a header block; unknown features raise."""
    out: dict = {"bbox": None, "features": []}
    for n, v in fields(Cursor(data)):
        if n == 1:
            b = {k: _zigzag(x) // 100 for k, x in fields(v)}
            out["bbox"] = (b.get(1, 0), b.get(4, 0), b.get(2, 0), b.get(3, 0))
        elif n == 4:
            name = v.rest().decode()
            if name not in KNOWN_FEATURES:
                raise ValueError(f"the file needs {name!r}")
            out["features"].append(name)
    return out


class _Block:
    """A primitive block: string table, units, groups."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.groups: list[Cursor] = []
        self.step, self.lat0, self.lon0, self.date_step = 100, 0, 0, 1000
        for n, v in fields(Cursor(data)):
            if n == 1:
                self.strings = [s.rest().decode("utf-8", "replace") for k, s in fields(v) if k == 1]
            elif n == 2:
                self.groups.append(v)
            elif n == 17:
                self.step = v
            elif n == 18:
                self.date_step = v
            elif n == 19:
                self.lat0 = _int(v)
            elif n == 20:
                self.lon0 = _int(v)

    def place(self, v: int, start: int) -> int:
        return (start + self.step * v) // 100

    def seconds(self, v: int) -> int:
        return v * self.date_step // 1000

    def tags(self, keys: list[int], values: list[int]) -> dict[str, str]:
        return {self.strings[k]: self.strings[v] for k, v in zip(keys, values)}

    def info(self, c: Cursor | None) -> tuple:
        f = dict(fields(c)) if c is not None else {}
        return (_int(f.get(1, 0)), self.seconds(_int(f.get(2, 0))), _int(f.get(3, 0)), _int(f.get(4, 0)), self.strings[f[5]] if 5 in f else "")

    def dense(self, c: Cursor) -> pa.RecordBatch:
        f = dict(fields(c))
        ids, lats, lons = (_array(f[n], True, True) if n in f else np.zeros(0, np.int64) for n in (1, 8, 9))
        m = dict(fields(f[5])) if 5 in f else {}
        none = np.zeros(len(ids), np.int64)
        version = _array(m[1]) if 1 in m else none
        time, changeset, uid = (_array(m[n], True, True) if n in m else none for n in (2, 3, 4))
        strings = pa.array(self.strings, pa.string())
        user = strings.take(pa.array(_array(m[5], True, True))) if 5 in m else pa.array([""] * len(ids), pa.string())
        place = lambda v, start: (start + self.step * v) // 100
        columns = [ids, version, time * self.date_step // 1000, changeset, uid, user, place(lons, self.lon0), place(lats, self.lat0), self.dense_tags(f.get(10), len(ids), strings)]
        return batch("node", columns)

    def dense_tags(self, c: Cursor | None, n: int, strings: pa.Array) -> pa.Array:
        """Tags of n nodes from one list of keys and values, each node's ended by 0; of a key that comes twice the last."""
        words = _array(c) if c is not None else np.zeros(0, np.int64)
        ends = np.flatnonzero(words == 0)
        sizes = np.diff(np.concatenate([[-1], ends])) - 1
        if len(words) and (len(ends) != n or (sizes % 2).any()):  # 0 may be a value, too (an empty text)
            out, at = [], 0
            for _ in range(n):
                tags = {}
                while at < len(words) and words[at]:
                    tags[self.strings[words[at]]] = self.strings[words[at + 1]]
                    at += 2
                at += 1
                out.append(list(tags.items()))
            return pa.array(out, pa.map_(pa.string(), pa.string()))
        flat, node = words[words != 0], np.repeat(np.arange(n), sizes // 2 if len(words) else 0)
        keys, values = flat[0::2], flat[1::2]
        code = node * (len(self.strings) + 1) + keys
        last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
        if len(last) < len(code):
            last.sort()
            keys, values, node = keys[last], values[last], node[last]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n))]) if n else [0]
        return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), strings.take(pa.array(keys)), strings.take(pa.array(values)))

    def batches(self, kinds: Collection[str]) -> Iterator[tuple[str, pa.RecordBatch]]:
        """The rows of some kinds, all in one pass."""
        for g in self.groups:
            rows: dict[str, list] = {k: [] for k in kinds}
            for n, v in fields(Cursor(g.data, g.at, g.end)):
                if n == 2:
                    if "node" in kinds:
                        yield "node", self.dense(v)
                elif n in (1, 3, 4) and (kind := KINDS[max(0, n - 2)]) in kinds:
                    rows[kind].append(self.row(n, v))
            for kind, r in rows.items():
                if r:
                    yield kind, batch(kind, list(zip(*r)))

    def row(self, n: int, c: Cursor) -> tuple:
        """An element that stands by itself, n being the number of its field."""
        f: dict = dict(fields(c))
        tags = list(self.tags(*(_packed(f[k]) if k in f else [] for k in (2, 3))).items())
        head = (_zigzag(f[1]) if n == 1 else _int(f[1]), *self.info(f.get(4)))
        if n == 1:
            return *head, self.place(_zigzag(f[9]), self.lon0), self.place(_zigzag(f[8]), self.lat0), tags
        if n == 3:
            return *head, _packed(f[8], True, True) if 8 in f else [], tags
        roles, refs, types = (_packed(f[8]), _packed(f[9], True, True), _packed(f[10])) if 9 in f else ([], [], [])
        return *head, [(KINDS[t], r, self.strings[s]) for t, r, s in zip(types, refs, roles)], tags


def read_blob(path: str, offset: int, size: int) -> bytes:
    with open_file(path) as f:
        f.seek(offset)
        return inflate(f.read(size))


class _Run(InputPartition):
    def __init__(self, path: str, parts: list[tuple[int, int]]):
        self.path, self.parts = path, parts


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "node")
        if self.kind not in S.BY_KIND:
            raise ValueError(f"kind is one of {', '.join(S.BY_KIND)}")

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        files = input_files(self.path)
        with ThreadPoolExecutor(LISTED_AT_ONCE) as pool:
            for path, found in zip(files, pool.map(blobs, files)):
                data = []
                for kind, offset, size in found:
                    if kind == "OSMHeader":
                        header(read_blob(path, offset, size))
                    else:
                        data.append((offset, size))
                out += [_Run(path, data[i : i + BLOBS_A_TASK]) for i in range(0, len(data), BLOBS_A_TASK)]
        return out or [_Run("", [])]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        kinds = KINDS if self.kind == "any" else (self.kind,)
        for offset, size in partition.parts:
            for kind, b in _Block(read_blob(partition.path, offset, size)).batches(kinds):
                yield with_kind(kind, b) if self.kind == "any" else b


class PbfSource(DataSource):
    """``spark.read.format("osmpbf").option("kind", "node"|"way"|"relation"|"any").load(path)``; ``any`` gives all kinds
    in one pass, see schema.ANY. path: a file or folder that driver and executors see, or a URI pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return S.BY_KIND.get(self.options.get("kind", "node"), S.NODES)

    def reader(self, schema) -> PbfReader:
        return PbfReader(dict(self.options))
