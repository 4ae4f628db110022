"""Writers of small PBF and O5M files, for exchange and for tests of the readers."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Sequence

from geochunk.sources.pbf import KINDS
from geochunk.sources.varint import signed, unsigned


def _field(n: int, v: int | bytes) -> bytes:
    return unsigned(n << 3) + unsigned(v & (1 << 64) - 1) if isinstance(v, int) else unsigned(n << 3 | 2) + unsigned(len(v)) + v


def _list(n: int, values: Iterable[int], zigzag: bool = False, delta: bool = False) -> bytes:
    out, last = b"", 0
    for v in values:
        out += signed(v - last if delta else v) if zigzag else unsigned(v)
        last = v
    return _field(n, out)


def _blob(kind: str, data: bytes) -> bytes:
    body = _field(2, len(data)) + _field(3, zlib.compress(data))
    head = _field(1, kind.encode()) + _field(3, len(body))
    return struct.pack(">i", len(head)) + head + body


def pbf(nodes: Sequence[dict] = (), ways: Sequence[dict] = (), relations: Sequence[dict] = (), block: int = 1000) -> bytes:
    """A PBF file of elements given as dicts with the columns of geochunk.schema."""
    out = _blob("OSMHeader", _field(4, b"OsmSchema-V0.6") + _field(4, b"DenseNodes"))
    for kind, rows in zip(KINDS, (nodes, ways, relations)):
        for i in range(0, len(rows), block):
            out += _blob("OSMData", _primitive_block(kind, rows[i : i + block]))
    return out


def _primitive_block(kind: str, rows: Sequence[dict]) -> bytes:
    words: dict[str, int] = {"": 0}
    word = lambda s: words.setdefault(s, len(words))
    if kind == "node":
        pairs: list[int] = []
        for r in rows:
            pairs += [x for k, v in r["tags"].items() for x in (word(k), word(v))] + [0]
        info = _list(1, [r["version"] for r in rows])
        info += b"".join(_list(n, [f(r) for r in rows], True, True) for n, f in ((2, lambda r: r["timestamp"]), (3, lambda r: r["changeset"]), (4, lambda r: r["uid"]), (5, lambda r: word(r["user"]))))
        dense = _list(1, [r["id"] for r in rows], True, True) + _field(5, info) + _list(8, [r["lat"] for r in rows], True, True) + _list(9, [r["lon"] for r in rows], True, True) + _list(10, pairs)
        group = _field(2, dense)
    else:
        group = b""
        for r in rows:
            info = _field(1, r["version"]) + _field(2, r["timestamp"]) + _field(3, r["changeset"]) + _field(4, r["uid"]) + _field(5, word(r["user"]))
            body = _field(1, r["id"]) + _list(2, map(word, r["tags"])) + _list(3, map(word, r["tags"].values())) + _field(4, info)
            if kind == "way":
                group += _field(3, body + _list(8, r["nds"], True, True))
            else:
                m = r["members"]
                group += _field(4, body + _list(8, [word(x["role"]) for x in m]) + _list(9, [x["ref"] for x in m], True, True) + _list(10, [KINDS.index(x["type"]) for x in m]))
    return _field(1, b"".join(_field(1, w.encode()) for w in words)) + _field(2, group)


def o5m(nodes: Sequence[dict] = (), ways: Sequence[dict] = (), relations: Sequence[dict] = (), reuse: bool = True) -> bytes:
    """An O5M file; with ``reuse`` repeated strings become back references."""
    table: list[bytes] = []

    def pair(body: bytes, size: int) -> bytes:
        if reuse and body in table[-15_000:]:
            distance = table[::-1].index(body) + 1
            return bytes([distance]) if distance < 0x80 else bytes([distance & 0x7F | 0x80, distance >> 7])
        if size <= 250:
            table.append(body)
        return b"\0" + body

    def author(r: dict) -> bytes:
        uid, user = unsigned(r["uid"]), r["user"].encode()
        return pair(uid + (b"\0" if r["uid"] else b"") + user + b"\0", len(uid) + len(user))

    out = b"\xff\xe0\x04o5m2"
    for what, rows in zip((0x10, 0x11, 0x12), (nodes, ways, relations)):
        out += b"\xff"
        last = {k: 0 for k in ("id", "timestamp", "changeset", "lon", "lat", *KINDS)}

        def step(k: str, v: int) -> bytes:
            d, last[k] = v - last[k], v
            return signed(d)

        for r in rows:
            body = step("id", r["id"]) + unsigned(r["version"])
            if r["version"]:
                body += step("timestamp", r["timestamp"])
                if r["timestamp"]:
                    body += step("changeset", r["changeset"]) + author(r)
            else:
                last["timestamp"] = 0
            if what == 0x10:
                body += step("lon", r["lon"]) + step("lat", r["lat"])
            else:
                refs = b""
                for m in r["nds"] if what == 0x11 else r["members"]:
                    if what == 0x11:
                        refs += step("node", m)
                    else:
                        role = m["role"].encode()
                        refs += step(m["type"], m["ref"]) + pair(str(KINDS.index(m["type"])).encode() + role + b"\0", 1 + len(role))
                body += unsigned(len(refs)) + refs
            for k, v in r["tags"].items():
                k, v = k.encode(), v.encode()
                body += pair(k + b"\0" + v + b"\0", len(k) + len(v))
            out += bytes([what]) + unsigned(len(body)) + body
    return out + b"\xfe"
