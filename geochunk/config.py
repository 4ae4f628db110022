"""Tile grids and tag rules: text files, read on the driver; both are small by nature and bounded here."""

from __future__ import annotations

from dataclasses import dataclass, field
from importlib.resources import files
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: bits of the feature mask.
FEATURES = {"id": 1, "version": 2, "timestamp": 4, "changeset": 8, "user": 16, "one_element": 32}
#: Short names of the metadata to preserve.
ALIASES = {"v": "version", "time": "timestamp", "ts": "timestamp", "cs": "changeset"}
PRESERVABLE = ("id", "version", "timestamp", "changeset", "user")


def read_text(path: str | None, shipped: str) -> str:
    """A file of that name if there is one, else the shipped resource."""
    if path is not None and Path(path).is_file():
        return Path(path).read_text(encoding="utf-8")
    return (files("geochunk.resources") / (path or shipped)).read_text(encoding="utf-8")


@dataclass(frozen=True)
class Grid:
    """Rectangles x0+i*dx .. +dx by y0+j*dy .. +dy for i < nx, j < ny, numbered longitude first."""

    x0: int
    dx: int
    nx: int
    y0: int
    dy: int
    ny: int

    def __len__(self) -> int:
        return self.nx * self.ny


def parse_tiles(text: str) -> list[Grid]:
    """One Grid per line; blank lines and lines starting with # are skipped."""
    out = []
    for line in text.splitlines():
        n = line.split()
        if not n or line.startswith("#"):
            continue
        v = [int(x) for x in n]
        if len(v) == 6:
            out.append(Grid(v[0], v[2], max(0, -(-(v[1] - v[0]) // v[2])), v[3], v[5], max(0, -(-(v[4] - v[3]) // v[5]))))
        elif len(v) == 4:
            out.append(Grid(v[0], v[1] - v[0], 1, v[2], v[3] - v[2], 1))
        else:
            raise ValueError(f"a line of tiles has 4 or 6 numbers: {line!r}")
    return out


@dataclass(frozen=True)
class Rule:
    key: str
    is_area: bool = False
    exceptions: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    area_values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rules:
    """Ordered rules by kind; prefixes[0] is the empty one, the others end in a colon."""

    node: tuple[Rule, ...] = ()
    way: tuple[Rule, ...] = ()
    collection: tuple[Rule, ...] = ()
    prefixes: tuple[str, ...] = ("",)

    def of(self, kind: str) -> tuple[Rule, ...]:
        """Rules of an element type N, W, A or C; areas go by the way rules."""
        return {"N": self.node, "C": self.collection}.get(kind, self.way)

    def independent(self) -> bool:
        """Whether no lifecycle rewrite can make or undo another rule's match, so that matches are a set."""
        for rules in (self.node, self.way, self.collection):
            plain = {r.key for r in rules}
            if len(plain) < len(rules):
                return False
            if "lifecycle" in plain or any(p + k in plain for p in self.prefixes[1:] for k in plain):
                return False
            if any(p + "lifecycle" in plain for p in self.prefixes):
                return False
            spelt = [p + k for p in self.prefixes for k in plain]
            if len(set(spelt)) < len(spelt) or "lifecycle" in spelt or "area" in plain:
                return False
        return True


@dataclass
class _Open:
    key: str
    is_area: bool = False
    lists: dict[str, list[str]] = field(default_factory=lambda: {"EXCEPTIONS": [], "": [], "WAY": [], "AREA": []})

    def close(self) -> Rule:
        return Rule(self.key, self.is_area, tuple(self.lists["EXCEPTIONS"]), tuple(self.lists[""] + self.lists["WAY"]), tuple(self.lists["AREA"]))


def parse_rules(text: str) -> Rules:
    """Blocks by indentation under NODE, WAY, COLLECTION and LIFECYCLE: keys, and under a key its values; under a key of
    ways IS_AREA, and the values below EXCEPTIONS, WAY and AREA. Blank lines and lines starting with # are skipped."""
    kinds: dict[str, list] = {"NODE": [], "WAY": [], "COLLECTION": [], "LIFECYCLE": []}
    kind, part, steps = "", "", {}
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        word, depth = line.strip(), len(line) - len(line.lstrip())
        steps = {d: n for d, n in steps.items() if d <= depth}
        level = steps.setdefault(depth, len(steps))
        if level == 0:
            kind = word
            if kind not in kinds:
                raise ValueError(f"unknown block {word!r}")
        elif kind == "LIFECYCLE":
            kinds[kind].append(word + ":")
        elif level == 1:
            kinds[kind].append(_Open(word))
            part = ""
        elif kind == "WAY" and level == 2:
            part = word
            if word == "IS_AREA":
                kinds[kind][-1].is_area = True
            elif word not in ("EXCEPTIONS", "WAY", "AREA"):
                raise ValueError(f"unknown part {word!r} of {kinds[kind][-1].key}")
        else:
            kinds[kind][-1].lists[part if kind == "WAY" else ""].append(word)
    return Rules(*(tuple(o.close() for o in kinds[k]) for k in ("NODE", "WAY", "COLLECTION")), ("", *kinds["LIFECYCLE"]))


def default_tiles(path: str | None = None) -> list[Grid]:
    return parse_tiles(read_text(path, "tiles.txt"))


def default_rules(path: str | None = None) -> Rules:
    return parse_rules(read_text(path, "rules.txt"))


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rules as a table: kind, key_ord, key, is_area, exceptions, way_values, area_values."""
    rows = [
        (kind, i, r.key, r.is_area, list(r.exceptions), list(r.values), list(r.area_values))
        for kind, rs in (("node", rules.node), ("way", rules.way), ("collection", rules.collection))
        for i, r in enumerate(rs)
    ]
    schema = "kind string, key_ord int, key string, is_area boolean, exceptions array<string>, way_values array<string>, area_values array<string>"
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Options:
    """What a conversion can be told.

    tiles, rules: files, or the shipped ones; preserve: metadata to keep; one_element: first matching key only;
    compression: of the written files; orientation: ``compat`` multiplies in 32 bits, ``exact`` in 64.
    """

    tiles: str | None = None
    rules: str | None = None
    preserve: tuple[str, ...] = ()
    one_element: bool = False
    compression: str = "zstd"
    orientation: str = "compat"

    @property
    def feature_bits(self) -> int:
        return sum(FEATURES[p] for p in self.preserve) + (FEATURES["one_element"] if self.one_element else 0)


def parse_preserve(text: str) -> tuple[str, ...]:
    """``id,version,timestamp,changeset,user``, short names, or ``all`` or ``none`` on its own."""
    words = [ALIASES.get(w, w) for w in text.split(",") if w]
    if "all" in words or "none" in words:
        if len(words) > 1:
            raise ValueError("all and none stand alone")
        return PRESERVABLE if words == ["all"] else ()
    if bad := [w for w in words if w not in PRESERVABLE]:
        raise ValueError(f"unknown metadata: {', '.join(bad)}")
    return tuple(p for p in PRESERVABLE if p in words)
