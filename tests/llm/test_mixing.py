import random
from collections import Counter, defaultdict

from geochunk.llm.mixing import blocks, mix_sources, schedule, shares_reached, source_table

SCHEMA = "doc_id bigint, source string, n_tokens bigint, block string, u int"
TARGETS = "source string, target_share double, max_repeat int"


def docs(seed=1, n=3000):
    rnd = random.Random(seed)
    return [(i, rnd.choices(["a", "b", "c", "other", None], [60, 10, 2, 10, 2])[0], rnd.choice([0, None, rnd.randint(1, 900)]) if i % 20 == 0 else rnd.randint(50, 900)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", 0) for d in data], SCHEMA)


def test_source_table(spark):
    items = frame(spark, [(1, "a", 1000), (2, "b", 60), (3, "b", 40), (4, "d", 0), (5, None, 9), (6, "e", 5)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("b", 0.1, 9), ("c", 0.1, 1), ("d", 0.1, 1), (None, 0.5, 1), ("e", 0.0, 1)], TARGETS)
    table, weight, total = source_table(items, targets, "source", "n_tokens", 10)
    rows = sorted(map(tuple, table.collect()))
    assert total == 1066 and [r[0] for r in rows] == ["a", "b"] and rows[0][1] == 0 and rows[0][2] == rows[1][1] and rows[1][2] == weight
    assert abs(rows[0][2] / weight - 0.625) < 1e-8 and [r[3:5] for r in rows] == [(100, 1), (10, 4)]
    assert source_table(items.limit(0), targets, "source", "n_tokens", 10)[1:] == (0, 0)


def test_schedule_is_exact_and_even(spark):
    sources = spark.createDataFrame([("a", 0, 700_000), ("b", 700_000, 1_000_000)], "source string, lo long, hi long")
    got = schedule(sources, 1_000_000, 100_000).orderBy("slot_no").collect()
    assert [r["slot_no"] for r in got] == list(range(100_000))
    rank, seen = Counter(), Counter()
    for i, r in enumerate(got):
        u = ((i + 1) * 11400714819323198485 % 2**64) / 2**64
        assert r["source"] == ("a" if u < 0.7 else "b") and r["rank"] == rank[r["source"]]
        rank[r["source"]] += 1
        seen[r["source"]] += 1
        assert abs(seen["a"] - 0.7 * (i + 1)) < 8  # every start of the schedule has the shares


def test_blocks_don_t_depend_on_the_number_of_ranges(spark):
    items = frame(spark, [(i, "a", 10) for i in range(500)])
    at = [sorted(map(tuple, blocks(items, spark.createDataFrame([("a", n)], "source string, buckets long"), 3, "doc_id", "source", "n_tokens", 100).collect())) for n in (1, 7, 100)]
    assert at[0] == at[1] == at[2] and Counter(r[3] for r in at[0]) == {b: 10 for b in range(50)}


def test_mixture(spark):
    data = docs()
    df = frame(spark, data)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 4), ("gone", 0.05, 3), (None, 0.2, 1)], TARGETS)
    mix = mix_sources(df, targets).collect()
    size = {d[0]: d[2] for d in data}
    source = {d[0]: d[1] for d in data}
    times, total = defaultdict(Counter), Counter()
    for r in mix:
        assert r["n_tokens"] == size[r["doc_id"]] and source[r["doc_id"]] == r["source"] and r["source"] in "abc"
        times[r["source"]][r["doc_id"]] += 1
        total[r["source"]] += r["n_tokens"]
    whole = sum(total.values())
    want = {"a": 0.5 / 0.95, "b": 0.3 / 0.95, "c": 0.15 / 0.95}
    assert all(abs(total[s] - w * whole) < 2 * 4096 for s, w in want.items())
    assert all(max(times[s].values()) <= m for s, m in (("a", 1), ("b", 2), ("c", 4)))
    assert max(times["c"].values()) - min(times["c"].values()) <= 1  # no document is favoured
    got = {r["source"]: (r["actual_share"], r["most_repeats"], r["share_error"]) for r in shares_reached(mix_sources(df, targets), targets).collect()}
    assert got["gone"] == (0.0, 0, -0.05) and abs(got["a"][0] - total["a"] / whole) < 1e-9 and abs(got["a"][2] - (got["a"][0] - 0.5)) < 1e-9
    assert sorted(map(tuple, mix)) == sorted(map(tuple, mix_sources(df.repartition(7), targets).collect()))  # the same on any layout
    assert mix_sources(df.limit(0), targets).count() == 0 and mix_sources(df, targets.limit(0)).count() == 0
    assert shares_reached(mix_sources(df.limit(0), targets), targets).count() == 5


def test_ten_thousand_sources(spark):
    n = 10_000
    items = spark.range(4 * n).selectExpr("id as doc_id", f"cast(id % {n} as string) as source", "10L as n_tokens")
    targets = spark.range(n).selectExpr("cast(id as string) as source", f"(1 + id % 3) / {2 * n - 1} as target_share", "2 as max_repeat")
    got = {r["source"]: r["n_tokens"] for r in mix_sources(items, targets, block=10).groupBy("source").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n_tokens").collect()}
    # the largest mixture repeats the sources of the largest share twice: 80 tokens each
    assert len(got) == n and all(abs(got[str(i)] - 80 * (1 + i % 3) / 3) <= 21 for i in range(n))


def test_one_long_document(spark):
    df = frame(spark, [(1, "a", 10**9), (2, "a", 5), (3, "b", 70)])
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    assert {r["source"] for r in mix_sources(df, targets, block=10).collect()} <= {"a", "b"}
