import datetime

from geochunk.operators.orphans import orphan_cascade
from tests.conftest import rows

D = [datetime.datetime(2024, 1 + d // 28, 1 + d % 28) for d in range(60)]
N = "id bigint, version int, visible boolean, loaded_at timestamp, orphan string"
W = "id bigint, version int, visible boolean, loaded_at timestamp, nds array<bigint>, level int"
R = "id bigint, version int, visible boolean, loaded_at timestamp, members array<struct<type:string,ref:bigint,role:string>>, ref_id int"


def m(*refs):
    return [None if r is None else {"type": r[0], "ref": r[1], "role": None} for r in refs]


def test_cascade(spark):
    nodes = [(1, 1, True, D[0]), (2, 1, True, D[0]), (2, 2, False, D[9]), (3, 1, True, D[30]), (4, 1, True, None)]
    ways = [(1, 1, True, D[5], [1, 1, None]), (2, 1, True, D[40], [1, 2, 9]), (3, 1, True, D[6], [3, 4]), (4, 1, False, D[0], [9]), (5, 1, True, None, [3]), (6, 1, True, D[1], None), (7, 1, True, D[1], [])]
    rels = [
        (1, 1, True, D[50], m(("way", 2), ("way", 1), ("odd", 5), (None, 5), ("node", None), None)),
        (2, 1, True, D[50], m(("relation", 1), ("relation", 3))), (3, 1, True, D[50], m(("relation", 2))), (4, 1, True, D[50], m(("way", 4), ("way", 2))), (5, 1, True, D[50], None),
    ]
    t = [spark.createDataFrame([(*r, None) for r in x], s) for x, s in ((nodes, N), (ways, W), (rels, R))]
    got = rows(orphan_cascade(*t))
    assert got == sorted(
        [
            ("ways", "2024-02", 2, "node", 2, "deleted", "direct", 0), ("ways", "2024-02", 2, "node", 9, "missing", "direct", 0),
            ("ways", "2024-01", 3, "node", 3, "late", "direct", 0), ("relations", "2024-02", 4, "way", 4, "deleted", "direct", 0),
            ("relations", "2024-02", 1, "way", 2, "inherited", "inherited", 1), ("relations", "2024-02", 4, "way", 2, "inherited", "inherited", 1),
            ("relations", "2024-02", 2, "relation", 1, "inherited", "inherited", 2), ("relations", "2024-02", 3, "relation", 2, "inherited", "inherited", 3),
            ("relations", "2024-02", 2, "relation", 3, "inherited", "inherited", 4),
        ], key=str)
    assert orphan_cascade(*(x.limit(0) for x in t)).count() == 0
