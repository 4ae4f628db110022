import random

import pytest

from geochunk.config import Rule, Rules, default_rules
from geochunk.operators.classify import classify

SCHEMA = "type string, id int, pts array<struct<lon:int,lat:int>>, tags map<string,string>"
RING = [{"lon": x, "lat": y} for x, y in ((0, 0), (9, 0), (9, 9), (0, 0))]


def fold(rules, kind, tags, closed, one):
    """The rules read one after the other, with tags rewritten on the way."""
    rs, out = rules.of(kind), []

    def is_area(j, t):
        if not closed or t.get("area") == "no":
            return False
        if t.get("area") == "yes":
            return True
        return j >= 0 and (rs[j].is_area != (t.get(rs[j].key) in rs[j].exceptions))

    def run(t, split):
        t, blocks, used, line = dict(t), [], False, None
        for j, r in enumerate(rs):
            for p in rules.prefixes:
                if p + r.key in t:
                    used = True
                    if split and not is_area(j, t):
                        line = dict(t) if line is None else line
                    else:
                        if p:
                            v = t.pop(p + r.key)
                            t |= {"lifecycle": p[:-1]}
                            t[r.key] = v
                        blocks.append(j)
                    break
            if used and one:
                break
        if not used:
            if split and not is_area(-1, t):
                line = dict(t)
            else:
                blocks.append(-1)
        return t, blocks, line

    def rows(kind, t, blocks):
        for j in blocks:
            key = rs[j].key if j >= 0 else ""
            values = () if j < 0 else rs[j].area_values if kind == "A" else rs[j].values
            out.append((kind, key, t[key] if j >= 0 and t.get(key) in values else "", tuple(sorted(t.items()))))

    t, blocks, line = run(tags, kind == "W")
    rows("A" if kind == "W" else kind, t, blocks)
    if line is not None:
        t, blocks, _ = run(line, False)
        rows("W", t, blocks)
    return out


@pytest.mark.parametrize("one", [False, True])
def test_equals_the_rules_read_in_turn(spark, one):
    rules, rnd, data = default_rules(), random.Random(4), []
    for i in range(700):
        kind = rnd.choice("NWWWAC")
        tags = {}
        for r in rnd.sample(rules.of(kind), min(len(rules.of(kind)), rnd.choice([0, 1, 1, 2, 4]))):
            value = rnd.choice([*r.values, *r.area_values, *r.exceptions, "odd"])
            for p in rnd.sample(rules.prefixes, rnd.choice([1, 1, 2])) if rnd.random() < 0.4 else [""]:
                tags[p + r.key] = value
        if rnd.random() < 0.3:
            tags["area"] = rnd.choice(["yes", "no", "x"])
        if rnd.random() < 0.1:
            tags["lifecycle"] = "own"
        data.append((kind, i, RING if rnd.random() < 0.7 else RING[:2], tags))
    df = spark.createDataFrame(data, SCHEMA)
    got = sorted((r["id"], r["type"], r["block_key"], r["slice_value"], tuple(sorted(r["tags"].items()))) for r in classify(df, rules, one).collect())
    want = sorted((i, *x) for kind, i, pts, tags in data for x in fold(rules, kind, tags, kind == "W" and len(pts) > 2, one))
    assert got == want
    assert classify(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("one", [False, True])
def test_rules_that_touch_are_read_in_turn(spark, one):
    keys = ["shop", "disused:shop", "lifecycle", "area", "old:disused:shop", "craft", "shop"]
    rnd, words = random.Random(7), ["yes", "no", "a", "b", "disused", "old"]
    for _ in range(4):
        pick = lambda: tuple(rnd.sample(words, rnd.choice([0, 2, 3])))
        make = lambda: tuple(Rule(k, rnd.random() < 0.5, pick(), pick(), pick()) for k in rnd.sample(keys, 5))
        rules = Rules(make(), make(), make(), ("", "disused:", "old:"))
        assert not rules.independent()
        spelt = sorted({p + k for p in rules.prefixes for k in keys})
        data = [(rnd.choice("NWWWC"), i, RING if rnd.random() < 0.7 else RING[:2], {k: rnd.choice(words) for k in rnd.sample(spelt, rnd.choice([0, 1, 2, 4, 7]))}) for i in range(250)]
        df = spark.createDataFrame(data, SCHEMA)
        got = sorted((r["id"], r["type"], r["block_key"], r["slice_value"], tuple(sorted(r["tags"].items()))) for r in classify(df, rules, one).collect())
        assert got == sorted((i, *x) for kind, i, pts, tags in data for x in fold(rules, kind, tags, kind == "W" and len(pts) > 2, one))


def test_areas_lose_the_closing_point(spark):
    df = spark.createDataFrame([("W", 1, RING, {"building": "yes", "highway": "x"})], SCHEMA)
    got = sorted((r["type"], r["block_key"], len(r["pts"])) for r in classify(df, default_rules()).collect())
    assert got == [("A", "building", 3), ("W", "building", 4), ("W", "highway", 4)]
    assert [(r["type"], len(r["pts"])) for r in classify(df, Rules(way=(Rule("building", True), Rule("building")))).orderBy("type").collect()] == [("A", 3), ("W", 4), ("W", 4)]
    empty = classify(df, Rules()).collect()
    assert [(r["type"], r["block_key"]) for r in empty] == [("W", "")]
