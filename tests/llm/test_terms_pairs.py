import itertools
import random
from collections import Counter

import pytest

from geochunk.llm import pairs as P
from geochunk.llm.pairs import cooccurrence
from geochunk.llm.terms import dictionary, term_frequencies

SCHEMA = "id bigint, terms array<struct<tag_key:string,term:string>>, n int, total boolean, blk string"


def test_frequencies(spark):
    rnd = random.Random(1)
    data = []
    for i in range(400):
        t = [("k", "hot")] * (i % 3 > 0) + [(rnd.choice("abc"), rnd.choice(["x", "", None, f"t{rnd.randint(0, 60)}"])) for _ in range(rnd.randint(0, 3))]
        data.append((i % 350, t or rnd.choice([None, []])))
    data += [(9000, [("k", "twice")] * 3), (9001, [("k", "twice")]), (9002, [("k", "twice")])]
    df = spark.createDataFrame([(i, None if t is None else [{"tag_key": k, "term": v} for k, v in t], 0, True, "") for i, t in data], SCHEMA)
    occ, has = Counter(), Counter()
    for _, t in data:
        occ.update(t or [])
        has.update(set(t or []))
    n = sum(bool(t) for _, t in data)
    got = term_frequencies(df, max_share=0.3).collect()
    assert {((r["tag_key"], r["term"])): (r["n_occurrences"], r["n_elements"]) for r in got} == {k: (occ[k], has[k]) for k in occ}
    assert {(r["tag_key"], r["term"]): r["mark"] for r in got} == {k: "rare" if v < 3 else "common" if v > 0.3 * n else "kept" for k, v in has.items()}
    assert sorted(r["term_no"] for r in got) == list(range(len(occ)))
    assert term_frequencies(df.limit(0)).count() == 0


def test_dictionary_is_dense(spark):
    d = dictionary(spark.range(10000).selectExpr("cast(id % 7000 as string) as w"))
    assert sorted(r["term_no"] for r in d.collect()) == list(range(7000)) and d.select("w").distinct().count() == 7000


@pytest.mark.parametrize("clash", [False, True])
def test_pairs(spark, clash, monkeypatch):
    if clash:  # as if two items shared a code
        real = P.item_marginals

        def same(*a):
            m, n = real(*a)
            return m.withColumn("h", P.F.lit(1)), n

        monkeypatch.setattr(P, "item_marginals", same)
    rnd = random.Random(2)
    data = [[rnd.choice(["a", "b", "é", "Z", "中", "hot", None]) for _ in range(rnd.randint(0, 5))] + ["hot"] * (i % 2) for i in range(300)] + [None, [], ["x", "x"], [f"r{i}" for i in range(60)]]
    df = spark.createDataFrame([(x, 1, "c") for x in data], "items array<string>, n_ab int, c string")
    one, two, n = Counter(), Counter(), 0
    for x in data:
        s = sorted({v for v in x or [] if v is not None})
        n += bool(s)
        one.update(s)
        two.update(itertools.combinations(s, 2))
    got = {(r["item_a"], r["item_b"]): tuple(r)[2:6] for r in cooccurrence(df).collect()}
    assert got == {k: (v, one[k[0]], one[k[1]], n) for k, v in two.items()}
    for count, lift in ((3, 1.2), (1, 10.0), (2, 0.0)):
        got = {(r["item_a"], r["item_b"]) for r in cooccurrence(df, min_count=count, min_lift=lift).collect()}
        assert got == {k for k, v in two.items() if v >= count and v * n * 10 >= round(lift * 10) * one[k[0]] * one[k[1]]}
    assert cooccurrence(df.limit(0), min_lift=10.0).count() == 0


def test_one_huge_basket(spark):
    df = spark.createDataFrame([([str(i) for i in range(1500)],)], "items array<string>")
    assert cooccurrence(df).count() == 1500 * 1499 // 2


def test_a_term_at_the_very_share_is_kept(spark):
    df = spark.createDataFrame([(i, [{"tag_key": "k", "term": "all"}] + [{"tag_key": "k", "term": "x"}] * (i < 7)) for i in range(140)], "id int, terms array<struct<tag_key:string,term:string>>")
    assert {r["term"]: r["mark"] for r in term_frequencies(df).collect()} == {"all": "common", "x": "kept"}
