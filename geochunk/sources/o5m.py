"""O5M extracts: one stream of delta-coded datasets per file, with a table of recent strings that spans the whole file,
so a file is one partition (a folder of files is read in parallel), read piece by piece."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geochunk import schema as S
from geochunk.sources.files import input_files, open_file
from geochunk.sources.rows import KINDS, batch, with_kind
from geochunk.sources.varint import Cursor, unsigned

#: Bytes read at a time, and rows of a batch.
READ_BYTES, BATCH_ROWS = 1 << 20, 10_000

#: Fixed values of the format.
TABLE_SIZE, LONGEST_PAIR = 15_000, 250
NODE, WAY, RELATION, RESET, FIRST_BARE = 0x10, 0x11, 0x12, 0xFF, 0xF0


class _Strings:
    """The latest pairs, by distance."""

    def __init__(self):
        self.pairs: list[tuple] = [("", "")] * TABLE_SIZE
        self.next = 0

    def back(self, first: int, c: Cursor) -> tuple:
        distance = first if first < 0x80 else first - 0x80 + (c.byte() << 7)
        return self.pairs[(self.next - distance) % TABLE_SIZE]

    def keep(self, pair: tuple, size: int) -> tuple:
        if size <= LONGEST_PAIR:
            self.pairs[self.next] = pair
            self.next = (self.next + 1) % TABLE_SIZE
        return pair

    def tag(self, c: Cursor) -> tuple[str, str]:
        if first := c.byte():
            return self.back(first, c)
        key, value = c.text(), c.text()
        return self.keep((key.decode("utf-8", "replace"), value.decode("utf-8", "replace")), len(key) + len(value))

    def author(self, c: Cursor) -> tuple[int, str]:
        if first := c.byte():
            return self.back(first, c)
        uid = c.unsigned()
        if uid:  # uid 0 is its own separator
            c.byte()
        name = c.text()
        return self.keep((uid, name.decode("utf-8", "replace")), len(unsigned(uid)) + len(name))

    def role(self, c: Cursor) -> tuple[int, str]:
        if first := c.byte():
            return self.back(first, c)
        kind, role = c.byte() - ord("0"), c.text()
        return self.keep((kind, role.decode("utf-8", "replace")), 1 + len(role))


def datasets(f) -> Iterator[tuple[int, Cursor]]:
    """(type, content) of the datasets of an open file, which is read piece by piece; bare ones have no content."""
    data, at, more = b"", 0, True

    def have(n: int) -> bool:
        """Whether n bytes stand ready from ``at`` on."""
        nonlocal data, at, more
        while more and len(data) - at < n:
            piece = f.read(max(READ_BYTES, n))
            more = bool(piece)
            data, at = data[at:] + piece, 0
        return len(data) - at >= n

    while have(1):
        what = data[at]
        at += 1
        if what >= FIRST_BARE:
            yield what, Cursor(b"")
            continue
        have(10)  # the longest number
        head = Cursor(data, at)
        size = head.unsigned()
        at = head.at
        if not have(size):
            raise EOFError("the data end inside a part")
        yield what, Cursor(data, at, at + size)
        at += size


def decode(f, kinds: Collection[str]) -> Iterator[tuple[str, tuple]]:
    """(kind, row) of some kinds from an open file; the others are read for their deltas and strings."""
    strings = _Strings()
    ident = time = changeset = lon = lat = 0
    refs = [0, 0, 0]
    for what, part in datasets(f):
        if what == RESET:
            ident = time = changeset = lon = lat = 0
            refs = [0, 0, 0]
            continue
        if what not in (NODE, WAY, RELATION):
            continue
        ident += part.signed()
        version, uid, user, meta = part.unsigned(), 0, "", (0, 0)
        if version:
            time += part.signed()
            if time:
                changeset += part.signed()
                uid, user = strings.author(part)
                meta = (time, changeset)
        else:
            time = 0
        head = (ident, version, *meta, uid, user)
        if what == NODE:
            if part:  # a deleted node ends here
                lon, lat = lon + part.signed(), lat + part.signed()
                place = (lon, lat)
            else:
                place = (None, None)
            row = (*head, *place)
        else:
            listed = part.part(part.unsigned()) if part else Cursor(b"")
            members: list = []
            while listed:
                step = listed.signed()
                t, role = (0, "") if what == WAY else strings.role(listed)
                refs[t] += step
                members.append(refs[0] if what == WAY else (KINDS[t], refs[t], role))
            row = (*head, members)
        tags = {}
        while part:
            k, v = strings.tag(part)
            tags[k] = v
        if (kind := KINDS[what - NODE]) in kinds:
            yield kind, (*row, list(tags.items()))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class O5mReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "node")
        if self.kind not in S.BY_KIND:
            raise ValueError(f"kind is one of {', '.join(S.BY_KIND)}")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in input_files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        kinds = KINDS if self.kind == "any" else (self.kind,)
        rows: dict[str, list] = {k: [] for k in kinds}

        def flush(kind: str) -> pa.RecordBatch:
            b = batch(kind, list(zip(*rows[kind])))
            rows[kind] = []
            return with_kind(kind, b) if self.kind == "any" else b

        with open_file(partition.path) as f:
            for kind, row in decode(f, kinds):
                rows[kind].append(row)
                if len(rows[kind]) >= BATCH_ROWS:
                    yield flush(kind)
        for kind in kinds:
            if rows[kind]:
                yield flush(kind)


class O5mSource(DataSource):
    """``spark.read.format("o5m").option("kind", ...).load(path)``, as PbfSource."""

    @classmethod
    def name(cls) -> str:
        return "o5m"

    def schema(self) -> str:
        return S.BY_KIND.get(self.options.get("kind", "node"), S.NODES)

    def reader(self, schema) -> O5mReader:
        return O5mReader(dict(self.options))
