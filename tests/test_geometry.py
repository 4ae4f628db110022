import random
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geochunk.functions.geometry import assemble_rings, in_ring, is_clockwise, is_closed, missing_point, open_ring, polygons, ring_in_ring, settle, turn_lines, via_line
from geochunk.functions.geometry import _inside as inside

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
LINE = "array<struct<lon:int,lat:int>>"


def dicts(line):
    return [{"lon": x, "lat": y} for x, y in line]


def test_point_in_ring_rules(spark):
    want = {(5, 5): True, (15, 5): False, (-5, 5): False, (0, 5): False, (10, 5): True, (5, 0): True, (5, 10): False, (0, 0): False, (10, 0): True}
    assert {p: inside(p, SQUARE) for p in want} == want
    rnd = random.Random(2)
    rings = [[(rnd.randint(-50, 50), rnd.randint(-50, 50)) for _ in range(rnd.randint(0, 7))] for _ in range(40)]
    rings = [r + r[:1] for r in rings] + [SQUARE]
    data = [(i, *p, dicts(rings[i])) for i in range(len(rings)) for p in [(rnd.randint(-50, 50), rnd.randint(-50, 50)) for _ in range(9)] + list(want)]
    df = spark.createDataFrame(data, f"i int, lon int, lat int, ring {LINE}")
    got = df.select("i", "lon", "lat", in_ring(F.col("lon"), F.col("lat"), F.col("ring")).alias("x")).collect()
    assert all(r["x"] == inside((r["lon"], r["lat"]), rings[r["i"]]) for r in got)


def ring_of(points):
    return sorted(points)


def test_simple_rings():
    assert assemble_rings([SQUARE]) == [SQUARE]
    assert assemble_rings([]) == [] and assemble_rings([[]]) is None
    assert assemble_rings([SQUARE, [(20, 20), (30, 30)]]) is None  # one loose line spoils the whole role
    far = [(x + 100, y) for x, y in SQUARE]
    assert assemble_rings([SQUARE, far]) == [SQUARE, far]
    got = assemble_rings([SQUARE[:3], SQUARE[:1:-1]])
    assert len(got) == 1 and len(got[0]) == 6  # where lines meet the point stays twice


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 7), st.randoms())
def test_rings_don_t_depend_on_the_order_of_lines(n, rnd):
    pts = [(i * 10, i * i) for i in range(n)]
    lines = [[pts[i], (i, 1000 + i), pts[(i + 1) % n]] for i in range(n)]
    rnd.shuffle(lines)
    lines = [x[::-1] if rnd.random() < 0.5 else x for x in lines]
    (ring,) = assemble_rings(lines)
    assert sorted(ring) == sorted(p for x in lines for p in x) and ring[0] == ring[-1]


def test_ambiguous_junction():
    a, b, c, d = (0, 0), (10, 0), (10, 10), (0, 10)
    lines = [[a, b], [b, (50, 50), b], [b, c], [c, d], [d, a]]
    for order in permutations(lines):
        got = assemble_rings(list(order))
        assert got is not None and sum(map(len, got)) == sum(map(len, lines))
    got = assemble_rings([[a, b], [b, d], [b, c], [c, d], [d, a], [d, b]])
    assert got is not None and all(r[0] == r[-1] for r in got)


def test_many_lines_at_one_point():
    star = [[(0, 0), (i, 1)] for i in range(40)]
    assert assemble_rings(star) is None  # every far end is loose
    assert assemble_rings([[(0, 0), (0, 1)]] * 41) is None
    (*rings,) = assemble_rings([[(0, 0), (0, 1)]] * 40)
    assert len(rings) == 20 and all(r[0] == r[-1] for r in rings)
    petals = [[(0, 0), (i, 1)] for i in range(5000)] + [[(i, 1), (0, 0)] for i in reversed(range(5000))]
    assert len(assemble_rings(petals)) == 5000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), max_size=7))
def test_rings_exist_as_brute_force_says(pairs):
    lines = [[(a, 0), (a, b + 9), (b, 0)] for a, b in pairs]

    def closable(left, head, tail):
        if head == tail:
            return not left or closable(left[1:], left[0][0], left[0][-1])
        return any(closable(left[:k] + left[k + 1 :], head, x[-1] if x[0] == tail else x[0]) for k, x in enumerate(left) if tail in (x[0], x[-1]))

    got = assemble_rings(lines)
    assert (got is not None) == closable(lines, 0, 0)
    if got is not None:
        assert all(r[0] == r[-1] for r in got) and sorted(p for r in got for p in r) == sorted(p for x in lines for p in x)


def test_missing_nodes_join_only_themselves(spark):
    df = spark.createDataFrame([(5,), (6,), (-5,), (2**40,)], "ref bigint")
    p = [tuple(r[0]) for r in df.select(missing_point(F.col("ref"))).collect()]
    assert len(set(p)) == 4 and all(x >= 0x7F000000 for x, _ in p)
    gone = df.select(settle(missing_point(F.col("ref")))).distinct().collect()
    assert [tuple(r[0]) for r in gone] == [(2147483647, 2147483647)]
    same, other = [p[0], (1, 1), p[1]], [p[1], (2, 2), p[0]]
    assert assemble_rings([same, other]) is not None and assemble_rings([same, [p[1], (2, 2), p[2]]]) is None


def test_holes():
    def box(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    big, mid, small, out = box(0, 0, 100), box(10, 10, 50), box(20, 20, 10), box(500, 500, 9)
    assert polygons([big], [small]) == [(big[:-1], [small[:-1]])]
    assert polygons([big], [out]) == [(big[:-1], [])]
    assert polygons([], [small]) == []
    got = polygons([big, mid], [small])
    assert got == [(mid[:-1], [small[:-1]]), (big[:-1], [])]  # the innermost shell takes it
    assert polygons([big, [(1, 1), (2, 2)]], []) == [] and polygons([big], [[(1, 1), (2, 2)]]) == [(big[:-1], [])]
    assert ring_in_ring(small, big) and not ring_in_ring(big, small)


A, B, C, D, E = (0, 0), (1, 0), (2, 0), (3, 0), (4, 0)


def test_turns():
    assert turn_lines([[A, B]], [[B]], [[B, C]]) == [[A, B, C]]
    assert turn_lines([[B, A]], [[B]], [[C, B]]) == [[A, B, C]]
    assert turn_lines([[A, B]], [], [[B, C]]) == [[A, B, C]]  # via inferred
    assert turn_lines([], [[B]], [[B, C]]) == [[B, B, C]]
    assert turn_lines([[A, B]], [[D]], [[B, C]]) == []
    assert turn_lines([[A, B]], [[B]], []) == [] and turn_lines([[A, B]], [[B]], [[B]]) == [] and turn_lines([[A]], [], [[B]]) == []
    assert turn_lines([[A, B]], [[C, B], [C, D]], [[D, E]]) == [[A, B, C, D, E]]
    assert turn_lines([[A, B]], [[B, C], [D, E]], [[E, A]]) == []
    two = turn_lines([[A, B], [E, B]], [[B]], [[B, C], [B, D]])
    assert sorted(two) == sorted([[A, B, C], [E, B, C], [A, B, D], [E, B, D]])
    assert turn_lines([[A, B]], [[]], [[B, C]]) == []


points = st.integers(0, 4).map(lambda x: (x, 0))
long_lines = st.lists(points, min_size=2, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.lists(long_lines, max_size=3), st.lists(st.lists(points, min_size=1, max_size=3), min_size=1, max_size=3), st.lists(long_lines, min_size=1, max_size=3))
def test_turns_are_a_product_of_their_parts(f, v, t):
    base = via_line(v)
    got = turn_lines(f, v, t, persist=False)
    if base is None:
        assert got == []
        return
    assert sorted(Counter(tuple(x) for part in v for x in part).keys()) == sorted(set(base))
    want = []
    for target in t:  # each pair by itself
        for source in f or [None]:
            want += turn_lines([source] if f else [], [base], [target]) if f else turn_lines([], [base], [target])
    assert got == want
    assert [len(x) for x in got] == [len(base) + 2] * len(got)
    assert len(turn_lines(f, v, t)) == len(got) or any(x[0] != x[-1] for x in f)


def test_via_lines():
    assert via_line([[A, B]]) == [A, B]
    assert via_line([[A, B], [B, C]]) == [C, B, A]  # several parts come out turned
    assert via_line([[B, C], [A, B]]) == [C, B, A]  # goes on from the other end
    assert via_line([[A, B], [D, C], [C, B]]) == [D, C, B, A] and via_line([[A, B], [C, D]]) is None
    assert via_line([[A], [A]]) == [A] and via_line([[A], [B]]) is None
    assert via_line([[A, B], [B, D], [B, C], [C, B]]) is None  # the next in order leads away from the others


def test_turns_that_persist():
    loop = [B, (9, 9), (8, 8), B]
    assert turn_lines([loop], [[B]], [[B, C], [B, D]]) == [[(9, 9), B, C], [(8, 8), B, D]]
    assert turn_lines([loop], [[B]], [[B, C], [B, D]], persist=False) == [[(9, 9), B, C], [(9, 9), B, D]]
    back = [B, (5, 5), C]
    assert turn_lines([back, back], [[B]], [[B, C]]) == [[(5, 5), C, B], [(5, 5), B, C]]
    assert turn_lines([back, back], [[B]], [[B, C]], persist=False) == [[(5, 5), C, B]] * 2


def test_closing_and_direction(spark):
    lines = [SQUARE, SQUARE[::-1], SQUARE[:-1], [(1, 1), (1, 1)], [], [(1, 1), (2, 2), (1, 1)]]
    big = [(x * 90000000, y * 40000000 + 100) for x, y in SQUARE]
    df = spark.createDataFrame([(i, dicts(x)) for i, x in enumerate([*lines, big])], f"i int, pts {LINE}")
    got = {r["i"]: r for r in df.select("i", is_closed("pts").alias("c"), open_ring("pts").alias("o"), is_clockwise(F.col("pts")).alias("w"), is_clockwise(F.col("pts"), True).alias("e")).collect()}
    assert [got[i]["c"] for i in range(6)] == [True, True, False, False, False, True]
    assert len(got[0]["o"]) == 4 and got[4]["o"] == []
    assert [got[i]["e"] for i in (0, 1, 4)] == [False, True, True]

    def wrapped(ring):
        w = lambda v: (v + 2**31) % 2**32 - 2**31
        return sum(w(w(b[0] - a[0]) * w(b[1] + a[1])) for a, b in zip(ring, ring[1:] + ring[:1])) >= 0

    assert all(got[i]["w"] == wrapped(x) for i, x in enumerate([*lines, big]))


@pytest.mark.parametrize("x,y", [(-7, 2), (7, -2), (7, 2), (-7, -2)])
def test_division_truncates(spark, x, y):
    got = spark.range(1).select(F.call_function("div", F.lit(x).cast("long"), F.lit(y).cast("long"))).collect()[0][0]
    assert got == int(x / y)
