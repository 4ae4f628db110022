import pytest

from geochunk.config import Grid, Options, Rule, Rules, default_rules, default_tiles, parse_preserve, parse_rules, parse_tiles


def test_shipped_sizes():
    r = default_rules()
    assert sum(map(len, default_tiles())) == 42338
    assert (len(r.node), len(r.way), len(r.collection), len(r.prefixes)) == (37, 30, 2, 15)
    assert sum(len(x.values) for x in r.node) == 41 and sum(len(x.values) for x in r.collection) == 4
    assert [sum(len(getattr(x, a)) for x in r.way) for a in ("values", "area_values", "exceptions")] == [22, 50, 111]
    assert r.independent()


def test_tiles_notation():
    assert parse_tiles("# x\n\n0 25 10 0 20 10\n1 2 3 4\n") == [Grid(0, 10, 3, 0, 10, 2), Grid(1, 1, 1, 3, 1, 1)]
    with pytest.raises(ValueError):
        parse_tiles("1 2 3")


INDENTED = """# comment
NODE
  natural
    tree
  shop

WAY
  highway
    EXCEPTIONS
      platform
    WAY
      service
  building
    IS_AREA
    AREA
      yes
COLLECTION
  route
    bus
LIFECYCLE
  disused
"""


def test_indented_notation():
    want = Rules((Rule("natural", values=("tree",)), Rule("shop")), (Rule("highway", False, ("platform",), ("service",)), Rule("building", True, (), (), ("yes",))), (Rule("route", values=("bus",)),), ("", "disused:"))
    assert parse_rules(INDENTED) == want


def test_options():
    assert parse_preserve("v,ts,user") == ("version", "timestamp", "user") and parse_preserve("none") == () and len(parse_preserve("all")) == 5
    for bad in ("all,id", "x"):
        with pytest.raises(ValueError):
            parse_preserve(bad)
    assert Options(preserve=("id", "user"), one_element=True).feature_bits == 1 + 16 + 32
    assert not Rules((Rule("disused:shop"), Rule("shop")), prefixes=("", "disused:")).independent()
