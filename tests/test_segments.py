"""The queries over customers' rings, on orders whose points leave 32 bits (from order 2,047,484 on)."""

import pytest

from geochunk.plans.queries import QUERIES
from tests.conftest import rows

#: Orders of three customers: on this side of the limit, across it, far beyond it.
RINGS = {1: [7, 8, 10, 1_000_003], 2: [5, 2_047_482, 2_047_484, 2_047_485, 9_000_000, 9_000_001], 3: [3_000_000_000, 4_294_967_296, 10**12 + 1]}


def at(o):
    return 100_000_000 + o * 1000, 480_000_000 + o * 7919 % 100_003 * 100


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("segments"))
    spark.createDataFrame([(o, c) for c, os in RINGS.items() for o in os], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{d}/orders.parquet")
    return d


def test_from_to(spark, folder):
    assert rows(QUERIES["from_to"](spark, folder)) == sorted(((c, k, *at(o)) for c, os in RINGS.items() for k, o in enumerate(os[:3])), key=str)


def test_ring_assembly(spark, folder):
    assert rows(QUERIES["ring_assembly"](spark, folder)) == [(c, 1, 2 * len(os) - 1) for c, os in RINGS.items()]


#: Per kind of turn the least number of segments, and at which points of the ring the line lies.
CASES = {"node": (3, (0, 1, 2)), "ways": (6, (0, 1, 2, 3, 4)), "no from": (3, (1, 1, 2)), "far": (4, (3, 2, 1))}


def test_turn_cases(spark, folder):
    want = [(kind, c, k, *at(os[i])) for kind, (least, points) in CASES.items() for c, os in RINGS.items() if len(os) >= least for k, i in enumerate(points)]
    assert rows(QUERIES["turn_cases"](spark, folder)) == sorted(want, key=str)
