"""Geometry over whole-number coordinates: expressions that stay in the JVM, and builders for rings and turn lines."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geochunk.schema import LINE, MISSING_BASE, MISSING_LON, NOWHERE

Point = tuple[int, int]


# --- expressions ------------------------------------------------------------------------------------------------------


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("int").alias("lon"), lat.cast("int").alias("lat"))


def missing_point(ref: Column) -> Column:
    """The stand-in position of an unresolved node: its id above MISSING_BASE, read as two 32-bit halves.

    Of a negative id the lower 56 bits are taken, so that it too stands beyond every real longitude."""
    v = F.lit(MISSING_BASE) + ref.bitwiseAND((1 << 56) - 1)
    low = v.bitwiseAND(0xFFFFFFFF)
    return point(F.shiftright(v, 32), F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low))


def settle(p: Column) -> Column:
    """Stand-in positions become NOWHERE on both axes."""
    return F.when(p["lon"] >= MISSING_LON, point(F.lit(NOWHERE), F.lit(NOWHERE))).otherwise(p)


def settle_line(line: Column | str) -> Column:
    return F.transform(line, settle)


def is_closed(line: Column | str) -> Column:
    """At least 3 points, the first equal to the last."""
    line = F.col(line) if isinstance(line, str) else line
    return (F.size(line) >= 3) & (F.get(line, F.lit(0)) == F.element_at(line, -1))


def open_ring(line: Column | str) -> Column:
    """A closed line without its last point."""
    line = F.col(line) if isinstance(line, str) else line
    return F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule over the edges of a closed ring: an edge counts when the latitude lies in its half-open span and
    its longitude there, by truncating division in 64 bits, is less than the point's."""
    x, y = lon.cast("long"), lat.cast("long")
    edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))
    edges = F.when(F.size(ring) >= 2, edges).otherwise(F.slice(edges, 1, 0))

    def crosses(e: Column) -> Column:
        x1, y1, x2, y2 = (e[p][c].cast("long") for p in "ab" for c in ("lon", "lat"))
        at = x1 + _div((x2 - x1) * (y - y1), y2 - y1)
        return (y1 != y2) & ((y1 <= y) == (y < y2)) & (at < x)

    return F.pmod(F.size(F.filter(edges, crosses)), F.lit(2)) == 1


def _div(a: Column, b: Column) -> Column:
    """Whole division that truncates; b = 0 is divided by 1 (no caller uses that, but it is evaluated)."""
    return F.call_function("div", a, F.when(b == 0, F.lit(1).cast("long")).otherwise(b))


def is_clockwise(ring: Column, exact: bool = False) -> Column:
    """Sum over edges of (x2-x1)*(y2+y1) not negative. In ``compat`` manner each factor and product wraps at 32 bits, as
    layouts made that way expect; ``exact`` uses 64 bits (factors of 33 bits can't overflow it for valid positions)."""
    wrap = lambda c: c if exact else F.pmod(c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    n = F.size(ring)

    def term(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i + 1 == n, 0).otherwise(i + 1))
        dx = wrap(b["lon"].cast("long") - a["lon"].cast("long"))
        sy = wrap(b["lat"].cast("long") + a["lat"].cast("long"))
        return wrap(dx * sy)

    terms = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), term)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda acc, t: acc + t) >= 0


def oriented(shell: Column, holes: Column, exact: bool = False) -> tuple[Column, Column]:
    """Shell clockwise, holes counter-clockwise."""
    turned = F.when(is_clockwise(shell, exact), shell).otherwise(F.reverse(shell))
    return turned, F.transform(holes, lambda h: F.when(is_clockwise(h, exact), F.reverse(h)).otherwise(h))


# --- ring assembly ----------------------------------------------------------------------------------------------------


def assemble_rings(lines: Sequence[Sequence[Point]]) -> list[list[Point]] | None:
    """Closed rings made of all lines, joined at equal end points; None if that can't be done.

    Rings exist just if at every point an even number of open lines ends; then a walk over unused lines can stop nowhere
    but where it began, so no step is ever taken back and the work grows with the lines. A walk begins with the first
    unused line (a closed one is a ring of its own), goes on with the first that starts, or else ends, at its tail, and
    is a ring as soon as it is back. Points where lines meet are kept twice.
    """
    if any(not line for line in lines):
        return None
    lines = [[tuple(p) for p in line] for line in lines]
    joins: dict[Point, deque[tuple[int, bool]]] = defaultdict(deque)
    for i, line in enumerate(lines):
        if line[0] != line[-1]:
            joins[line[0]].append((i, False))
            joins[line[-1]].append((i, True))
    if any(len(ends) % 2 for ends in joins.values()):
        return None
    taken, rings = [False] * len(lines), []
    for i, line in enumerate(lines):
        if taken[i]:
            continue
        taken[i], ring = True, list(line)
        while ring[0] != ring[-1]:
            ends = joins[ring[-1]]
            k, back = ends.popleft()
            if not taken[k]:
                taken[k] = True
                ring.extend(reversed(lines[k]) if back else lines[k])
        rings.append(ring)
    return rings


def _inside(p: Point, ring: Sequence[Point]) -> bool:
    x, y, odd = p[0], p[1], False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if y1 != y2 and (y1 <= y) == (y < y2):
            n, d = (x2 - x1) * (y - y1), y2 - y1
            cut = abs(n) // abs(d)
            odd ^= x1 + (cut if (n < 0) == (d < 0) else -cut) < x
    return odd


def ring_in_ring(a: Sequence[Point], b: Sequence[Point]) -> bool:
    """Whether any vertex of a is inside b."""
    return any(_inside(p, b) for p in a)


def polygons(outer: Sequence, inner: Sequence) -> list[tuple[list[Point], list[list[Point]]]]:
    """(shell, holes) of each outer ring, innermost first, rings open. A hole goes to the first shell that has any of
    its vertices inside, and to no other; a hole in none is dropped. Outer lines that don't close give nothing, inner
    lines that don't close give no holes."""
    shells = assemble_rings(outer)
    if shells is None:
        return []
    holes = assemble_rings(inner) or []
    depth = [sum(ring_in_ring(a, b) for j, b in enumerate(shells) if j != i) for i, a in enumerate(shells)]
    out, free = [], list(range(len(holes)))
    for i in sorted(range(len(shells)), key=lambda i: -depth[i]):
        mine = [h for h in free if ring_in_ring(holes[h], shells[i])]
        free = [h for h in free if h not in mine]
        out.append((shells[i][:-1], [holes[h][:-1] for h in mine]))
    return out


# --- turn lines -------------------------------------------------------------------------------------------------------


def _ends(line: Sequence[Point]) -> tuple[Point, Point]:
    return line[0], line[-1]


def via_line(parts: Sequence[Sequence[Point]]) -> list[Point] | None:
    """All parts as one line, or None if some stay apart.

    The first part is prolonged at its tail: of the parts with an end there by the next in order after the one added
    last, else by the first. When none is left there, the line is turned round, once, and goes on from its other end; so
    a line of several parts always comes out turned.
    """
    if len(parts) == 1:
        return list(parts[0])
    at: dict[Point, set[int]] = defaultdict(set)
    for k, part in enumerate(parts[1:], 1):
        for p in _ends(part):
            at[p].add(k)
    line, left, last = list(parts[0]), len(parts) - 1, 0
    for _ in range(2):
        while here := at[line[-1]]:
            last = min((k for k in here if k > last), default=None) or min(here)
            part = parts[last] if parts[last][0] == line[-1] else parts[last][::-1]
            for p in _ends(part):
                at[p].discard(last)
            line.extend(part[1:])
            left -= 1
        line.reverse()
        last = 0
    return None if left else line[::-1]


def turn_lines(from_: Sequence, via: Sequence, to: Sequence, persist: bool = True) -> list[list[Point]]:
    """Lines leading from each ``from`` over ``via`` into each ``to``: last but one point, via points, second point.

    Without via, an end point that all lines share takes its place (the first of ``to``'s first line before its last).
    A ``to`` hangs on the via line's first end, or else on its last; the other end is the head, where a ``from`` hangs on.
    A ``from`` that touches the second point of the ``to`` hangs on there instead, and the line runs backwards. Without
    from, the head comes twice. What doesn't meet gives no line, nor do lines too short to have the points needed.

    persist: lines once turned round stay so for the next pair. That shows where a closed ``from`` meets several ``to``
    (it is left by its first and last stretch in turns), and where a ``from`` touches head and second point (it takes
    the one that the ``from`` before it did not). Otherwise each pair stands for itself.
    """
    starts, vias, ends = ([[tuple(p) for p in line] for line in lines] for lines in (from_, via, to))
    if not ends or any(not line for line in (*starts, *vias, *ends)):
        return []
    if not vias:
        shared = next((p for p in _ends(ends[0]) if all(p in _ends(line) for line in ends[1:] + starts)), None)
        vias = [] if shared is None else [[shared]]
    base = via_line(vias) if vias else None
    if base is None:
        return []
    out, turned = [], [False] * len(starts)
    for target in ends:
        if base[0] in _ends(target):
            way = base[::-1]
        elif base[-1] in _ends(target):
            way = base
        else:
            continue
        if len(target) < 2:
            continue
        way = [*way, target[-2] if target[-1] == way[-1] else target[1]]
        if not starts:
            out.append([way[0], *way])
        backwards = False
        for k, source in enumerate(starts):
            backwards &= persist
            tail, head = (way[0], way[-1]) if backwards else (way[-1], way[0])
            if tail in _ends(source):
                backwards, head = not backwards, tail
            if head not in _ends(source) or len(source) < 2:
                continue
            closed = source[0] == source[-1]
            first = not turned[k] if closed else source[0] == head  # left by its first stretch
            turned[k] = closed and persist and first
            out.append([source[1 if first else -2], *(reversed(way) if backwards else way)])
    return out


# --- the builders as UDFs over already collected members --------------------------------------------------------------

AREAS = T.ArrayType(T.StructType([T.StructField("shell", LINE), T.StructField("holes", T.ArrayType(LINE))]))
LINES = T.ArrayType(LINE)
#: Lines of made-up points, whose longitudes may take 64 bits.
WIDE_LINES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("lon", T.LongType()), T.StructField("lat", T.IntegerType())])))
_LINE = pa.list_(pa.struct([("lon", pa.int32()), ("lat", pa.int32())]))
_WIDE_LINE = pa.list_(pa.struct([("lon", pa.int64()), ("lat", pa.int32())]))
_AREAS = pa.list_(pa.struct([("shell", _LINE), ("holes", pa.list_(_LINE))]))


def _points(lines) -> list[list[Point]]:
    return [[(p["lon"], p["lat"]) for p in line] for line in lines if line is not None] if lines is not None else []


def _dicts(line: Sequence[Point]) -> list[dict]:
    return [{"lon": x, "lat": y} for x, y in line]


@F.arrow_udf(AREAS)
def polygons_udf(outer: pa.Array, inner: pa.Array) -> pa.Array:
    rows = zip(outer.to_pylist(), inner.to_pylist())
    out = [[{"shell": _dicts(s), "holes": [_dicts(h) for h in hs]} for s, hs in polygons(_points(o), _points(i))] for o, i in rows]
    return pa.array(out, _AREAS)


def _turns(from_: pa.Array, via: pa.Array, to: pa.Array, line: pa.DataType) -> pa.Array:
    rows = zip(from_.to_pylist(), via.to_pylist(), to.to_pylist())
    return pa.array([[_dicts(x) for x in turn_lines(*map(_points, r))] for r in rows], pa.list_(line))


@F.arrow_udf(LINES)
def turn_lines_udf(from_: pa.Array, via: pa.Array, to: pa.Array) -> pa.Array:
    return _turns(from_, via, to, _LINE)


@F.arrow_udf(WIDE_LINES)
def wide_turn_lines_udf(from_: pa.Array, via: pa.Array, to: pa.Array) -> pa.Array:
    """turn_lines_udf for lines with bigint longitudes."""
    return _turns(from_, via, to, _WIDE_LINE)


@F.arrow_udf(WIDE_LINES)
def assemble_rings_udf(lines: pa.Array) -> pa.Array:
    """Closed rings of each row's lines; null where they don't close. Longitudes may be int or bigint and come out as bigint."""
    rings = (assemble_rings(_points(x)) for x in lines.to_pylist())
    return pa.array([None if r is None else [_dicts(x) for x in r] for r in rings], pa.list_(_WIDE_LINE))
