import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from geochunk.operators.proximity import EARTH_M, cover_ring, near_pairs, near_spots, points_in_regions
from tests.conftest import rows


def distance(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v * 1e-7) for v in p) for p in (a, b))
    h = math.sin((y1 - y2) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x1 - x2) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1, h)))


def test_near_equals_brute_force_also_at_poles_and_date_line(spark):
    rnd = random.Random(3)
    centres = [(100000000, 480000000), (1800000000, 10), (-1800000000, -10), (0, 900000000), (1200000000, 899999990), (5, -899999995), (-1234567, 0)]
    pts = []
    for i in range(420):
        x, y = rnd.choice(centres)
        x = max(-1800000000, min(1800000000, x + rnd.randint(-900, 900) * (1 if abs(y) < 800000000 else 1000000)))
        pts.append((i * 7 % 421, x, max(-900000000, min(900000000, y + rnd.randint(-900, 900)))))
    want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and distance(a[1:], b[1:]) <= 5)
    df = spark.createDataFrame([(*p, "x", 1) for p in pts] + [(1000, None, 1, "x", 1), (None, 1, 1, "x", 1)], "id bigint, lon int, lat int, cell string, x int")
    got = [tuple(r) for r in near_pairs(df, 5.0).collect()]
    assert len(want) > 100 and sorted(got) == want  # nothing twice
    assert near_pairs(df.limit(0), 5.0).count() == 0


def test_same_place(spark):
    df = spark.createDataFrame([(i, 7, 7) for i in range(30)], "id bigint, lon int, lat int")
    assert near_pairs(df, 5.0).count() == 30 * 29 // 2


def test_spots_stand_for_their_points(spark):
    rnd = random.Random(8)
    pts = [(i, rnd.choice([0, 300, 900]), rnd.choice([0, 200])) for i in range(60)]
    df = spark.createDataFrame([*pts, (99, None, 1)], "id bigint, lon int, lat int")
    pairs, members = near_spots(df, 5.0)
    spot = {r["id"]: r["spot"] for r in members.collect()}
    linked = {(r["id_a"], r["id_b"]) for r in pairs.collect()}
    assert spot.keys() == {p[0] for p in pts} and len(set(spot.values())) == 6
    want = {(r["id_a"], r["id_b"]) for r in near_pairs(df, 5.0).collect()}
    assert want == {(a, b) for a in spot for b in spot if a < b and (spot[a] == spot[b] or tuple(sorted((spot[a], spot[b]))) in linked)}


def holds(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            odd = not odd
    return odd


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 12), st.integers(3, 9))
def test_cover_agrees_with_containment(seed, corners, size):
    rnd = random.Random(seed)
    turns = sorted(rnd.random() * 2 * math.pi for _ in range(corners))
    ring = [(round(10**size * rnd.uniform(0.3, 1) * math.cos(t)) * 2, round(10**size * rnd.uniform(0.3, 1) * math.sin(t)) // 4 * 2) for t in turns]
    cells = list(cover_ring(ring))
    for _ in range(60):
        x, y = (rnd.randint(-(10**size), 10**size) * 2 + 1 for _ in range(2))
        y = max(-899999999, min(899999999, y // 4 * 2 + 1))
        mine = [(inner, edges) for s, cx, cy, inner, edges in cells if (x + 2**31) >> s == cx and (y + 2**31) >> s == cy]
        assert len(mine) <= 1
        found = bool(mine) and (mine[0][0] or sum((ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay) for ax, ay, bx, by in mine[0][1]) % 2 == 1)
        assert found == holds(ring, x, y)


def test_regions(spark):
    zones = [(1, [(0, 0), (1001000, 0), (1001000, 1001000), (0, 1001000)]), (2, [(500, 500), (700, 90000), (90000, 700)]), (3, []), (4, None), (5, [(1, 1), (2, 2)])]
    z = spark.createDataFrame([(i, None if r is None else [{"lon": x, "lat": y} for x, y in r], "k") for i, r in zones], "zone_id int, ring array<struct<lon:int,lat:int>>, cell string")
    rnd = random.Random(1)
    pts = [(i, rnd.randint(-1000, 1200000) * 2 // 2 | 1, rnd.randint(-1000, 120000) | 1) for i in range(500)]
    p = spark.createDataFrame([*pts, (999, None, 5), (998, 5, None)], "id bigint, lon int, lat int")
    want = sorted(((k, i) for k, r in zones if r for i, x, y in pts if len(r) > 2 and holds(r, x, y)), key=str)
    assert rows(points_in_regions(p, z)) == want
    assert points_in_regions(p, z.limit(0)).count() == points_in_regions(p.limit(0), z).count() == 0
