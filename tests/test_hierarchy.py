import math
import random
from collections import defaultdict

import pytest

from geochunk.operators.hierarchy import hierarchies


def brute(links):
    down = defaultdict(set)
    for a, b in links:
        if a is not None and b is not None:
            down[a].add(b)
    every = set(down) | {b for v in down.values() for b in v}
    reach = {}
    for a in every:
        seen, todo = set(), list(down.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down.get(x, ())
        reach[a] = seen
    cyclic = {a for a in every if a in reach[a]}
    out = [("cycle", min(b for b in reach[a] if a in reach[b]), a, -1, ()) for a in cyclic]
    below = {b for v in down.values() for b in v}
    for root in set(down) - below:
        todo = [(root,)]
        while todo:
            p = todo.pop()
            out.append(("path", root, p[-1], len(p) - 1, p))
            todo += [(*p, c) for c in down.get(p[-1], ()) if c not in cyclic]
    return sorted(out, key=str)


def graph(seed):
    rnd = random.Random(seed)
    links, n = [], 0
    for _ in range(5):  # trees with some shared parts
        size = rnd.randint(1, 25)
        for i in range(1, size):
            links.append((n + rnd.randint(max(0, i - 3), i - 1), n + i))
            if rnd.random() < 0.1:
                links.append((n + rnd.randint(0, i - 1), n + i))
        n += size
    for length in (1, 2, 3, 7):  # cycles, with nodes above and below
        links += [(n + i, n + (i + 1) % length) for i in range(length)]
        links += [(n, n + length), (n + length, n + length + 1)]
        if rnd.random() < 0.5:
            links += [(rnd.randrange(n), n)]
        if rnd.random() < 0.5:
            links += [(n + length, rnd.randrange(n) if rnd.random() < 0.3 else n + length + 1)]
        n += length + 2
    links += [(n, n + 1), (n + 1, n), (n + 1, n + 2), (n + 2, n), (n + 2, n + 3), (n + 3, n + 4), (n + 4, n + 3)]  # linked cycles
    return links


@pytest.mark.parametrize("seed,every", [(1, 1), (2, 3), (3, 1000), (4, 4)])
def test_equals_brute_force(spark, seed, every):
    links = graph(seed)
    df = spark.createDataFrame([(*x, "p", 1) for x in [*links, *links[:5], (None, 3), (4, None)]], "parent bigint, child bigint, path string, s int")
    got = sorted(((*r[:4], tuple(r[4])) for r in hierarchies(df, every=every).collect()), key=str)
    assert got == brute(links)


def test_long_chain_and_nothing(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "parent bigint, child bigint")
    got = hierarchies(df).collect()
    assert len(got) == 301 and max(r["depth"] for r in got) == 300
    assert [r["path"] for r in got if r["depth"] == 300] == [list(range(301))]
    assert hierarchies(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1000])
def test_rounds_grow_with_the_logarithm(spark, n):
    def run(links):
        rounds = []
        got = hierarchies(spark.createDataFrame(links, "parent bigint, child bigint"), rounds=rounds)
        return got.groupBy("kind").count().collect(), rounds

    most = 2 * math.log2(n) + 10  # besides, the walks between splitters: some ten nodes
    got, rounds = run([(i, i + 1) for i in range(n)])
    assert got == [("path", n + 1)] and len(rounds) <= most
    got, rounds = run([(i, (i + 1) % (5 * n)) for i in range(5 * n)])
    assert got == [("cycle", 5 * n)] and len(rounds) <= most
    # a long tail below a cycle, a cycle of two stretches, and a chain in which every node has a root of its own besides
    got, rounds = run([(i, (i + 1) % 3) for i in range(3)] + [(i, i + 1) for i in range(2, n)])
    assert got == [("cycle", 3)] and len(rounds) <= most
    got, rounds = run([(i, (i + 1) % n) for i in range(n)] + [(0, n // 2)])
    assert got == [("cycle", n)] and len(rounds) <= 2 * most
    got, rounds = run([(i, i + 1) for i in range(200)] + [(1000 + i, i + 1) for i in range(200)])
    assert got == [("path", 200 + 201 * 202 // 2)] and len(rounds) <= most
