"""Nested JSON records to related flat tables: a stream of path-value-ordinal triples, grouped by repeated ancestor.

A record is read unit by unit (a key with its scalar, an opening or a closing bracket); no tree is built. Every scalar
gives a triple: its path, its place in each list above it, its text. The nearest ancestor that is repeated (an entry of
a list, or an object whose name is repeated elsewhere) is the row it belongs to, what lies between is its column; all
rows under one name are one table. Rows keep the number of the row above, so no link is lost, whatever the shape.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table of the records themselves, and column of entries that are scalars.
ROOT, VALUE = "$", "value"

#: Names whose objects are elements, wherever they stand; and names of their children by table.
ELEMENTS = ("node", "way", "relation")
CHILDREN = {"tag": "tag", "tags": "tag", "nd": "nd", "member": "member"}
#: What identifies a child.
CHILD_COLUMNS = ("k", "type", "ref", "value")

#: Most names a set of records may use for lists; more are no schema but keys of a map, which ``maps`` is for.
MAX_NAMES = 10_000

_STR = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_WS = r"[ \t\n\r]*+"
_NUM = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_WORD = rf"{_NUM}|true|false|null"
_SCALAR = rf"{_STR}{_WS}:{_WS}(?:{_STR}|{_WORD}){_WS}"
#: One unit: a comma, a key, and a scalar, an object of scalars, or an opening bracket; or a closing bracket.
_UNIT = re.compile(
    rf"{_WS}(,?+){_WS}(?:(?:({_STR}){_WS}:{_WS})?+(?:({_STR})|({_WORD})|(\{{{_WS}(?:{_SCALAR}(?:,{_WS}{_SCALAR})*+)?+\}})|([{{\[]))|([}}\]]))"
)
_PAIR = re.compile(rf"({_STR}){_WS}:{_WS}(?:({_STR})|({_WORD}))")
_BLANK = re.compile(_WS)

#: A row: table, number, number of the row above (-1: none), steps from there, place in its list, path, columns.
TABLE, NUMBER, PARENT, STEP, ORDINAL, PATH, FIELDS = range(7)


def _plain(quoted: str) -> str:
    return json.loads(quoted) if "\\" in quoted else quoted[1:-1]


def _step(quoted: str, mark: str) -> str:
    """A key as one step of a path: without ``mark``; ``~`` and ``/`` as in JSON pointers."""
    name = (json.loads(quoted) if "\\" in quoted else quoted[1:-1]).lstrip(mark)
    return name.replace("~", "~0").replace("/", "~1") if "~" in name or "/" in name else name


def _name(step: str) -> str:
    return step.replace("~1", "/").replace("~0", "~") if "~" in step else step


def rows_of(text: str | None, single: Collection[str] = (), scalar: Collection[str] = (), maps: Collection[str] = (), mark: str = "@") -> list[list] | None:
    """Rows of one record in document order, the record's own first; None unless it is one complete JSON text.

    single: names whose objects are rows even outside a list (a list of one); scalar: names whose scalars are, too, if
    not null. Entries of lists always are; a scalar entry, null included, has the one column VALUE. maps: names whose
    objects are one row per key, with columns k and v, unless they have a key k. mark: is cut from the front of names.
    Of a scalar whose key comes twice in an object the last counts; of objects and lists all do. Any depth is read.
    """
    if not text:
        return None
    root: dict[str, str | None] = {}
    rows: list[list] = [[ROOT, 0, -1, "", 0, "", root]]
    stack: list[tuple] = []
    names: list[str] = []  # the open keys
    # of the open container: an object (None: the top); nothing in it yet; number, columns and depth of its row; steps
    # below the row (None: not yet joined); of a list: name, path, place
    inside, fresh, row, fields, base, steps, name, path, place = None, True, 0, root, 0, "", ROOT, "", 0
    m = None
    for m in iter(_UNIT.scanner(text).match, None):
        comma, key, string, word, flat, opens, closes = m.groups()
        if closes is not None:
            if comma or inside is None or inside != (closes == "}"):
                return None
            keyed, inside, fresh, row, fields, base, steps, name, path, place = stack.pop()
            if keyed:
                names.pop()
            continue
        if (comma != "") == fresh or (key is None) == (inside is True) or inside is None and not fresh:
            return None
        fresh = False
        step = None if key is None else _step(key, mark)
        if steps is None and (opens is None or not inside):  # only where needed: deep records hold many steps
            steps = "/".join(names[base:]) + "/" * bool(inside)
        if flat is not None:
            pairs = {_step(k, mark): _plain(s) if s else None if w == "null" else w for k, s, w in _PAIR.findall(flat)}
            lone = {c: pairs.pop(c) for c in scalar if c in pairs} if scalar else {}
            owner, below, at = len(rows), "", path
            if inside is False:
                rows.append([name, owner, row, steps, place, path, pairs])
                place += 1
            elif inside is None:
                owner = 0
                root.update(pairs)
            else:
                if steps == "" and rows[row][TABLE] in maps:
                    fields.setdefault(step, None)
                at = "/".join([*names, step])
                if step in single:
                    rows.append([step, owner, row, steps + step, 0, at, pairs])
                else:
                    owner, below = row, f"{steps}{step}/"
                    fields.update((below + c, v) for c, v in pairs.items())
            for c, v in lone.items():
                if v is not None:
                    rows.append([c, len(rows), owner, below + c, 0, f"{at}/{c}" if at else c, {VALUE: v}])
        elif opens is not None:
            stack.append((step is not None, inside, False, row, fields, base, steps, name, path, place + 1))
            if step is not None:
                if steps == "" and rows[row][TABLE] in maps:
                    fields.setdefault(step, None)
                names.append(step)
                inside, steps = opens == "{", None
                if not inside:
                    name, path, place = step, "/".join(names), 0
                elif step in single:
                    path = "/".join(names)
                    row, fields = len(rows), {}
                    rows.append([step, row, stack[-1][3], "/".join(names[base:]), 0, path, fields])
                    base, steps = len(names), ""
            elif inside is None:
                inside, steps, place = opens == "{", "" if opens == "{" else ROOT, 0
            else:
                fields, above, row = {}, row, len(rows)
                rows.append([name, row, above, steps, place, path, fields])
                inside, steps, base, place = opens == "{", "" if opens == "{" else name, len(names), 0
            fresh = True
        else:
            value = _plain(string) if string is not None else None if word == "null" else word
            if inside is False:
                rows.append([name, len(rows), row, steps, place, path, {VALUE: value}])
                place += 1
            elif step is None:
                root[VALUE] = value
            elif step not in scalar:
                fields[steps + step] = value
            elif value is not None:
                rows.append([step, len(rows), row, steps + step, 0, "/".join([*names, step]), {VALUE: value}])
    if m is None or stack or fresh or _BLANK.match(text, m.end()).end() != len(text):
        return None
    return _without_maps(rows, maps) if maps else rows


def _without_maps(rows: list[list], maps: Collection[str]) -> list[list]:
    """``rows`` with those of maps, none of whose keys is k, turned into one row a key. Rows of maps are numbered through
    below the row above, whatever lists and maps they stand in."""
    out, count, moved, size = [], {}, {}, len(rows)
    for r in rows:
        if r[PARENT] in moved:  # hangs in a map: on the row of its key
            r[PARENT] = moved[r[PARENT]][r[STEP].partition("/")[0]]
        if r[TABLE] not in maps:
            out.append(r)
            continue
        n, fields = count.get(r[PARENT], 0), r[FIELDS]
        if "k" in fields or VALUE in fields and len(fields) == 1:
            r[ORDINAL] = n
            out.append(r)
            count[r[PARENT]] = n + 1
            continue
        made: dict[str, list] = {}
        for path, v in fields.items():
            head, _, tail = path.partition("/")
            if head not in made:
                made[head] = [r[TABLE], size, r[PARENT], r[STEP], n, r[PATH], {"k": _name(head)}]
                size, n = size + 1, n + 1
            made[head][FIELDS]["v/" + tail if tail else "v"] = v
        out.extend(made.values())
        moved[r[NUMBER]] = {h: x[NUMBER] for h, x in made.items()}
        count[r[PARENT]] = n
    return out


def triples(text: str | None, **shape) -> Iterator[tuple[str, tuple[int, ...], str | None]]:
    """(path, ordinals, value) of every scalar of a record, the ordinals being the places of the rows above it from the
    record down; nothing of a broken text. ``shape`` as in rows_of."""
    rows = rows_of(text, **shape) or []
    above = {r[NUMBER]: r for r in rows}
    for r in rows:
        places, up = [], r
        while up[PARENT] >= 0:
            places.append(up[ORDINAL])
            up = above[up[PARENT]]
        for c, v in r[FIELDS].items():
            yield f"{r[PATH]}/{c}" if r[PATH] else c, tuple(reversed(places)), v


def repeated_names(df: DataFrame, text: str, mark: str = "@") -> set[str]:
    """Names under which some record has a list: all strings are scanned in the JVM, those that open a list are kept.

    These are a schema's names, few at any size; more than MAX_NAMES raise."""
    strings = F.regexp_extract_all(F.col(text), F.lit(r'"(?:[^"\\]|\\.)*+"(?:\s*+:\s*+\[)?'), F.lit(0))
    opening = F.transform(F.filter(strings, lambda s: s.endswith("[")), lambda s: F.regexp_replace(s, r"\s*:\s*\[$", ""))
    names = df.select(F.explode(F.array_distinct(opening)).alias("n")).distinct().limit(MAX_NAMES + 1).collect()
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} names of lists")
    out = set()
    for r in names:
        try:
            out.add(_step(r["n"], mark))
        except ValueError:  # of a broken text
            pass
    return out


_SCHEMA = "rec long, tbl string, row_id int, parent_id int, parent_tbl string, parent_key string, step string, pos int, path string"
_FIELDS = pa.map_(pa.string(), pa.string())
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]


def flatten_records(
    df: DataFrame,
    key: str,
    text: str,
    single: Collection[str] | None = None,
    scalar: Collection[str] = (),
    maps: Collection[str] = (),
    tables: Collection[str] | None = None,
    ident: str = "id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One long table of the rows of all tables (or of ``tables``):

    key; rec, a hash of the text, which tells records of one key apart; tbl, the name of the repeated ancestor; row_id
    and parent_id, numbers inside the record; parent_tbl and parent_key, table and column ``ident`` of the row above;
    step, the names between the two; pos, the place in its list; path, all names from the record down; fields, the
    row's columns with their texts; or, if ``columns`` are named, those alone instead of fields. ``single``, ``scalar`` and ``maps`` as in rows_of; ``single`` None takes the names
    that are lists in any record, which costs one more scan.

    Each record is read on its own inside its task, so nothing is shuffled and memory is bounded by a record. Null,
    empty or broken texts (anything but one complete JSON text) give no rows; repeated records give repeated rows, alike
    in rec and all numbers; a null key is kept as null; an empty table gives no rows; further columns are ignored.
    """
    single = frozenset(repeated_names(df, text) if single is None else single) | frozenset(scalar) | frozenset(maps)
    scalar, maps, wanted = frozenset(scalar), frozenset(maps), None if tables is None else frozenset(tables)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kt = b.schema.field(0).type
            keys, out, names, values, ends = [], [], [], [], [0]
            for k, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows = rows_of(t, single, scalar, maps)
                if rows is None:
                    continue
                above = {r[NUMBER]: r for r in rows}
                n = len(out)
                for r in rows:
                    if wanted is not None and r[TABLE] not in wanted:
                        continue
                    up = above.get(r[PARENT])
                    f = r[FIELDS]
                    if columns is not None:
                        out.append((h, *r[:3], up and up[TABLE], up and up[FIELDS].get(ident), *r[3:6], *map(f.get, columns)))
                        continue
                    out.append((h, *r[:3], up and up[TABLE], up and up[FIELDS].get(ident), *r[3:6]))
                    names.extend(f)
                    values.extend(f.values())
                    ends.append(len(names))
                keys.extend([k] * (len(out) - n))
                if len(out) > 50_000:
                    yield _batch(kt, keys, out, columns, names, values, ends)
                    keys, out, names, values, ends = [], [], [], [], [0]
            if out:
                yield _batch(kt, keys, out, columns, names, values, ends)

    own = "fields map<string,string>" if columns is None else ", ".join(f"`{c}` string" for c in columns)
    return df.select(key, text, F.xxhash64(text).alias("_rec")).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}, {own}")


def _batch(key_type, keys: list, out: list, columns: Sequence[str] | None, names: list, values: list, ends: list) -> pa.RecordBatch:
    cols = [pa.array(c, t) for c, t in zip(zip(*out), [*_TYPES, *[pa.string()] * len(columns or ())])]
    if columns is None:
        cols.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())).cast(_FIELDS))
    title = ["key", "rec", "tbl", "row_id", "parent_id", "parent_tbl", "parent_key", "step", "pos", "path", *(["fields"] if columns is None else columns)]
    return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *cols], names=title)


def table(flat: DataFrame, names: str | Collection[str], columns: Collection[str]) -> DataFrame:
    """The group of rows under one or several names, pivoted: all of ``flat`` but fields, and a column for each path of
    ``columns`` (its last step, or the part after ``=``)."""
    names = [names] if isinstance(names, str) else list(names)
    field = (lambda c: F.element_at("fields", c)) if "fields" in flat.columns else (lambda c: F.col(f"`{c}`"))
    pick = [field(c.partition("=")[0]).alias(c.partition("=")[2] or c.rpartition("/")[2]) for c in columns]
    kept = [c for c in flat.columns if c != "fields" and c not in columns]
    return flat.where(F.col("tbl").isin(*names)).select(*(F.col(f"`{c}`") for c in kept), *pick)


def columns_of(flat: DataFrame) -> DataFrame:
    """(tbl, column, n): the columns every table has, found from the rows."""
    return flat.select("tbl", F.explode(F.map_keys("fields")).alias("column")).groupBy("tbl", "column").agg(F.count("*").alias("n"))


# --- uploads of map elements ------------------------------------------------------------------------------------------


def flatten_uploads(df: DataFrame, key: str = "upload_id", text: str = "payload", tables: Collection[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """flatten_records for map elements: elements and their children are rows even alone, tags may be maps."""
    names = {*ELEMENTS, *CHILDREN}
    return flatten_records(df, key, text, names, {"nd", "member"}, {"tag", "tags"}, tables, columns=columns)


def whole(c: Column) -> Column:
    """A text as a whole number of 64 bits, with blanks around it or zeros after the point; else null."""
    t = F.trim(c)
    return F.coalesce(t.try_cast("bigint"), F.when(t.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(t, r"\.0+$", "").try_cast("bigint")))


def elements(flat: DataFrame, columns: Collection[str]) -> DataFrame:
    """Rows of the element tables, with elem_type, elem_id and ``columns``; entries of lists that are no objects are none."""
    e = flat.where(~(F.map_contains_key("fields", F.lit(VALUE)) & (F.size("fields") == 1)))
    e = table(e, ELEMENTS, ["id=_id", *columns])
    return e.withColumn("elem_type", F.col("tbl")).withColumn("elem_id", whole(F.col("_id"))).drop("_id")


def of_elements(rows: DataFrame, direct: bool = True) -> DataFrame:
    """``rows`` whose row above is an element, with elem_type and elem_id; direct: with nothing in between."""
    r = rows.where(F.col("parent_tbl").isin(*ELEMENTS))
    r = r.where(~F.contains("step", F.lit("/"))) if direct else r
    return r.withColumn("elem_type", F.col("parent_tbl")).withColumn("elem_id", whole(F.col("parent_key")))


def children(flat: DataFrame, key: str) -> DataFrame:
    """Distinct children as (key, elem_type, elem_id, child, pos, child_key).

    pos is -1 for tags; child_key is the tag key, the reference in decimal, or the member's type/ref. A tag without
    key, or an nd whose reference is null or no whole number, gives no row.
    """
    c = of_elements(table(flat, CHILDREN, CHILD_COLUMNS))
    tag, nd = F.col("tbl").isin("tag", "tags"), F.col("tbl") == "nd"
    ref = F.coalesce("ref", VALUE)
    number = whole(ref).cast("string")
    # a null entry is a place without a child
    there = F.col("k").isNotNull() | F.col("type").isNotNull() | ref.isNotNull()
    child_key = F.when(tag, F.col("k")).when(nd, number).when(there, F.concat(F.coalesce("type", F.lit("")), F.lit("/"), F.coalesce(number, ref, F.lit(""))))
    child = F.when(tag, "tag").otherwise(F.col("tbl"))
    out = c.select(key, "elem_type", "elem_id", child.alias("child"), F.when(tag, -1).otherwise(F.col("pos")).alias("pos"), child_key.alias("child_key"))
    return out.where("child_key is not null").distinct()
