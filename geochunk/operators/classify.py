"""Tag rules: key blocks and value slices, lifecycle prefixes, and closed ways that are areas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geochunk.config import Rule, Rules
from geochunk.functions.geometry import is_closed, open_ring

#: A match is key ordinal * _STEP + prefix ordinal; so matches sort by key, then by prefix.
_STEP = 1000
_MATCHES = "array<int>"


def _text(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words) -> str:
    return f"array({', '.join(map(_text, words))})" if words else "cast(array() as array<string>)"


def _among(column: str, words) -> str:
    return f"{column} IN ({', '.join(map(_text, words))})" if words else "false"


def _lookup(words: dict[str, int]) -> str:
    return f"map({', '.join(f'{_text(k)}, {v}' for k, v in words.items())})"


# Expressions over rules are written as SQL: a lambda or a literal made call by call costs far more planning than work.


def matches(df: DataFrame, tags: str, rules: tuple[Rule, ...], prefixes: tuple[str, ...], out: str, one_element: bool) -> DataFrame:
    """Adds ``out``: for each rule that a tag matches, in rule order, the match with the first prefix.

    Tags are filtered by a hashed set of all prefixed keys first, so the few that can match are looked up alone.
    """
    place = {p + r.key: i * _STEP + j for i, r in reversed(list(enumerate(rules))) for j, p in reversed(list(enumerate(prefixes)))}
    if not place:
        return df.withColumn(out, F.array().cast(_MATCHES))
    df = df.withColumn("_hits", F.expr(f"filter(map_keys({tags}), k -> {_among('k', place)})"))
    df = df.withColumn("_hits", F.expr(f"if(size(_hits) > 0, array_sort(transform(_hits, k -> element_at({_lookup(place)}, k))), cast(array() as {_MATCHES}))"))
    first = f"filter(_hits, (m, i) -> i = 0 OR get(_hits, i - 1) div {_STEP} <> m div {_STEP})"
    return df.withColumn(out, F.expr(f"slice({first}, 1, 1)" if one_element else first)).drop("_hits")


def rewrite(df: DataFrame, found: str, rules: tuple[Rule, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """``df`` with tags after the lifecycle rewrites of ``found``: ``pfx:key=v`` becomes ``key=v`` and ``lifecycle=pfx``,
    the last rewrite giving the lifecycle."""
    if not rules:
        return df
    keys, pre = _array([r.key for r in rules]), _array(prefixes)
    name = f"named_struct('key', get({keys}, cast(m div {_STEP} as int)), 'prefix', get({pre}, m % {_STEP}))"
    df = df.withColumn("_moved", F.expr(f"filter({found}, m -> m % {_STEP} > 0)"))
    df = df.withColumn("_moved", F.expr(f"if(size(_moved) > 0, transform(_moved, m -> {name}), null)"))
    df = df.withColumn("_gone", F.expr("concat(transform(_moved, n -> concat(n.prefix, n.key)), transform(_moved, n -> n.key), array('lifecycle'))"))
    kept = "map_filter(tags, (k, v) -> NOT array_contains(_gone, k))"
    put = "map_from_entries(transform(_moved, n -> named_struct('key', n.key, 'value', element_at(tags, concat(n.prefix, n.key)))))"
    new = f"map_concat({kept}, {put}, map('lifecycle', rtrim(':', element_at(_moved, -1).prefix)))"
    return df.withColumn("tags", F.expr(f"if(_moved IS NULL, tags, {new})")).drop("_moved", "_gone")


def is_area_match(tags: str, rules: tuple[Rule, ...]) -> str:
    """Whether a match m makes a closed way an area: area=yes or no decide, else the rule, turned round by its exceptions
    (which look at the plain key only)."""
    key = f"get({_array([r.key for r in rules])}, cast(m div {_STEP} as int))"
    odd = [r.key + "=" + v for r in rules for v in r.exceptions]
    exception = f"coalesce({_among(f"concat({key}, '=', element_at({tags}, {key}))", odd)}, false)"
    flagged = [str(i) for i, r in enumerate(rules) if r.is_area]
    area = f"m div {_STEP} IN ({', '.join(flagged)})" if flagged else "false"
    return f"CASE coalesce(element_at({tags}, 'area'), '') WHEN 'yes' THEN true WHEN 'no' THEN false ELSE ({area}) <> {exception} END"


def _blocks(df: DataFrame, kind: str, found: str, rules: tuple[Rule, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """One row per match (or one for the ``other`` block) with block_key, slice_value, key_ord, value_ord and new tags."""
    values = {r.key + "=" + v: n for r in rules for n, v in enumerate(r.area_values if kind == "A" else r.values)}
    df = rewrite(df, found, rules, prefixes)
    df = df.withColumn("key_ord", F.expr(f"explode(if(size({found}) > 0, transform({found}, m -> cast(m div {_STEP} as int)), array({len(rules)})))"))
    df = df.withColumn("block_key", F.expr(f"get({_array([*(r.key for r in rules), ''])}, key_ord)")).drop(found)
    if not values:
        return df.withColumns({"slice_value": F.lit(""), "value_ord": F.lit(1 << 30)})
    df = df.withColumn("_v", F.expr(f"if(key_ord < {len(rules)}, element_at(tags, block_key), null)"))
    df = df.withColumn("_listed", F.expr(f"coalesce({_among("concat(block_key, '=', _v)", values)}, false)"))
    ordinal = f"if(_listed, element_at({_lookup(values)}, concat(block_key, '=', _v)), {1 << 30})"
    return df.withColumns({"slice_value": F.expr("if(_listed, _v, '')"), "value_ord": F.expr(ordinal)}).drop("_v", "_listed")


def classify(elements: DataFrame, rules: Rules, one_element: bool = False) -> DataFrame:
    """Rows by block and slice: ``elements`` with block_key ('' = other), slice_value ('' = rest), key_ord, value_ord.

    An element comes once for each key it matches. Closed ways are split: matches that make them areas give rows of type
    A (ring open, tags with those matches' rewrites), any other match, or none, one pass as a way with the tags rewritten
    so far. Areas of relations match by key alone. Where a lifecycle rewrite can make or undo the match of another rule
    (a key that starts with a prefix, is ``lifecycle`` or is listed twice), rules are taken one after the other instead.
    """
    if not rules.independent():
        return _classify_in_order(elements, rules, one_element)
    pre, w = rules.prefixes, rules.way
    plain = []
    for kind in ("N", "A", "C"):
        rs = rules.of(kind)
        d = matches(elements.where(F.col("type") == kind), "tags", rs, pre, "_m", one_element)
        plain.append(_blocks(d, kind, "_m", rs, pre))
    ways = matches(elements.where("type = 'W'"), "tags", w, pre, "_m", one_element)
    closed, none = is_closed("pts"), F.size("_m") == 0
    area = F.expr(f"filter(_m, m -> {is_area_match('tags', w)})") if w else F.col("_m")
    ways = ways.withColumn("_a", F.when(closed, area).otherwise(F.array().cast(_MATCHES)))
    other_area = none & closed & F.coalesce(F.element_at("tags", "area") == "yes", F.lit(False))

    areas = ways.where((F.size("_a") > 0) | other_area)
    areas = areas.withColumn("type", F.lit("A")).withColumn("pts", open_ring("pts")).drop("_m")
    areas = _blocks(areas, "A", "_a", w, pre)

    lines = ways.where((F.size("_m") > F.size("_a")) | none & ~other_area)
    before = f"filter(_a, m -> m div {_STEP} < get(array_except(_m, _a), 0) div {_STEP})"
    lines = lines.withColumn("_a", F.expr(f"if(size(_m) = 0, cast(array() as {_MATCHES}), {before})"))
    lines = rewrite(lines, "_a", w, pre).drop("_m", "_a")
    lines = _blocks(matches(lines, "tags", w, pre, "_m", one_element), "W", "_m", w, pre)
    out = areas.unionByName(lines)
    for p in plain:
        out = out.unionByName(p)
    return out


# --- rules that touch each other --------------------------------------------------------------------------------------


def fold(tags: dict[str, str], rules: tuple[Rule, ...], prefixes: tuple[str, ...], one_element: bool, closed: bool | None) -> tuple[list[int], dict | None]:
    """Rules applied in order, each to the tags its predecessors left: ordinals of those that took the element in (of the
    ``other`` block len(rules)), and the tags of the line it passes on as, or None. ``tags`` are changed in place.

    closed: None takes everything that matches; else, of a way, only what makes it an area."""
    taken, line, matched = [], None, False
    area = tags.get("area")
    for j, r in enumerate(rules):
        prefix = next((p for p in prefixes if p + r.key in tags), None)
        if prefix is None:
            continue
        matched = True
        if closed is not None and not (closed and (area == "yes" or area != "no" and r.is_area != (tags.get(r.key) in r.exceptions))):
            line = dict(tags) if line is None else line
        else:
            if prefix:
                tags["lifecycle"] = prefix[:-1]
                tags[r.key] = tags[prefix + r.key]
                del tags[prefix + r.key]
            taken.append(j)
        if one_element:
            break
        area = tags.get("area")
    if not matched:
        if closed is None or closed and area == "yes":
            taken.append(len(rules))
        else:
            line = dict(tags)
    return taken, line


def _classify_in_order(elements: DataFrame, rules: Rules, one_element: bool) -> DataFrame:
    """classify by an Arrow UDF over the tags, for rules that touch each other."""
    entry = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("ords", T.ArrayType(T.IntegerType())), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))]))
    kind = pa.list_(pa.struct([("type", pa.string()), ("ords", pa.list_(pa.int32())), ("tags", pa.map_(pa.string(), pa.string()))]))
    pre = rules.prefixes

    @F.arrow_udf(entry)
    def folded(types: pa.Array, tags: pa.Array, closed: pa.Array) -> pa.Array:
        out = []
        for t, m, c in zip(types.to_pylist(), tags.to_pylist(), closed.to_pylist()):
            own, rows = dict(m or ()), []
            taken, line = fold(own, rules.of(t), pre, one_element, c if t == "W" else None)
            if taken:
                rows.append({"type": "A" if t == "W" else t, "ords": taken, "tags": list(own.items())})
            if line is not None:
                rows.append({"type": "W", "ords": fold(line, rules.way, pre, one_element, None)[0], "tags": list(line.items())})
            out.append(rows)
        return pa.array(out, kind)

    e = elements.withColumn("_rows", folded("type", "tags", is_closed("pts"))).withColumn("_was", F.col("type"))
    e = e.withColumn("_row", F.explode("_rows")).withColumns({"type": F.col("_row.type"), "tags": F.col("_row.tags"), "key_ord": F.explode("_row.ords")})
    e = e.withColumn("pts", F.when((F.col("_was") == "W") & (F.col("type") == "A"), open_ring("pts")).otherwise(F.col("pts"))).drop("_rows", "_row", "_was")
    out = None
    for t in ("N", "W", "A", "C"):
        rs = rules.of(t)
        values = {f"{j}={v}": n for j, r in enumerate(rs) for n, v in reversed(list(enumerate(r.area_values if t == "A" else r.values)))}
        d = e.where(F.col("type") == t).withColumn("block_key", F.expr(f"get({_array([*(r.key for r in rs), ''])}, key_ord)"))
        d = d.withColumn("_v", F.expr(f"if(key_ord < {len(rs)}, element_at(tags, block_key), null)"))
        d = d.withColumn("value_ord", F.expr(f"coalesce(try_element_at({_lookup(values)}, concat(key_ord, '=', _v)), {1 << 30})" if values else str(1 << 30)))
        d = d.withColumn("slice_value", F.expr(f"if(value_ord < {1 << 30}, _v, '')")).drop("_v")
        out = d if out is None else out.unionByName(d)
    return out
