import itertools
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from geochunk.llm.packing import best_fit_decreasing, fill_containers, reduce_dominated, slots, solve


def content(patterns):
    c = Counter()
    for items, n in patterns:
        for size, each in items:
            c[size] += each * n
    return c


def check(patterns, hist, cap):
    assert content(patterns) == Counter(hist)
    assert all(sum(s * e for s, e in items) <= cap and n > 0 for items, n in patterns)


def best_fit_by_hand(sizes, cap):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(cap - s)
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=14))
def test_groups_pack_as_single_items_do(hist):
    got = best_fit_decreasing(hist, 40)
    check(got, hist, 40)
    rooms = sorted(40 - sum(s * e for s, e in items) for items, n in got for _ in range(n))
    assert rooms == best_fit_by_hand([s for s, n in hist.items() for _ in range(n)], 40)


def fewest(sizes, cap):
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - sizes[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_fixed_containers_belong_to_an_optimal_packing(sizes):
    hist = Counter(sizes)
    fixed, rest = reduce_dominated(dict(hist), 20)
    assert content(fixed) + Counter(rest) == hist
    n = sum(k for _, k in fixed)
    assert n + fewest([s for s, k in rest.items() for _ in range(k)], 20) == fewest(sizes, 20)


def test_large_histograms():
    rnd = random.Random(3)
    for cap in (512, 8192):
        hist = Counter(min(cap, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(30000))
        p = solve(dict(hist), cap)
        check(p, hist, cap)
        least = -(-sum(s * n for s, n in hist.items()) // cap)
        assert sum(n for _, n in p) <= least * 1.02 + 1
    s = slots([(((5, 2), (3, 1)), 4), (((5, 1),), 2)])
    assert s == [(5, 0, 8, 0, 2), (3, 0, 4, 0, 1), (5, 8, 10, 4, 1)]


def test_items_and_pieces(spark):
    rnd = random.Random(8)
    items = [(i, rnd.choice([0, None, 1, 7, 10, 10, 10, 11, 25, 30, 1000, rnd.randint(1, 60)])) for i in range(400)] + [(None, 4), (5, 9), (5, 9)]
    df = spark.createDataFrame([(*x, 0, "b") for x in items], "doc_id bigint, n_tokens bigint, rank int, bucket string")
    caps = spark.createDataFrame([(10,), (10,), (25,), (None,), (0,)], "capacity_tokens int")
    got = fill_containers(df, caps).collect()
    for cap in (10, 25):
        mine = [r for r in got if r["capacity_tokens"] == cap]
        total = Counter()
        for r in mine:
            total[r["doc_id"]] += r["n_tokens"]
        want = Counter()
        for k, n in items:
            want[k] += n or 0
        assert total == want and all((r["container_no"] is None) == (r["n_tokens"] == 0) for r in mine)
        load = Counter()
        for r in mine:
            if r["container_no"] is not None:
                load[r["container_no"]] += r["n_tokens"]
        assert max(load.values()) <= cap and set(load) == set(range(len(load)))
        pieces = Counter(r["doc_id"] for r in mine)
        assert all(pieces[k] == max(1, -(-(n or 0) // cap)) for k, n in items if k not in (5, None))
        for k, n in items:
            if n and n > cap and k not in (5, None):
                assert sorted((r["piece_no"], r["n_tokens"]) for r in mine if r["doc_id"] == k) == [(i, min(cap, n - i * cap)) for i in range(-(-n // cap))]
    assert fill_containers(df.limit(0), caps).count() == 0 and fill_containers(df, caps.limit(0)).count() == 0
    hot = spark.range(5000).selectExpr("id as doc_id", "case when id % 3 = 0 then 4L else 6L end as n_tokens")
    assert fill_containers(hot, caps).where("capacity_tokens = 10").agg({"container_no": "max"}).collect()[0][0] + 1 == 1667 + 1666


def test_no_split_when_it_fits():
    for sizes in itertools.product(range(1, 6), repeat=4):
        p = solve(dict(Counter(sizes)), 5)
        assert sum(n for _, n in p) <= fewest(list(sizes), 5) + 1
