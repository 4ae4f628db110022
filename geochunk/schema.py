"""Schemas and sentinels."""

from __future__ import annotations

from pyspark.sql import types as T

META = ("version", "timestamp", "changeset", "uid", "user")

_META_FIELDS = "id bigint, version int, timestamp bigint, changeset bigint, uid int, user string"
NODES = f"{_META_FIELDS}, lon int, lat int, tags map<string,string>"
WAYS = f"{_META_FIELDS}, nds array<bigint>, tags map<string,string>"
RELATIONS = f"{_META_FIELDS}, members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"
ANY = (
    f"kind string, {_META_FIELDS}, lon int, lat int, nds array<bigint>, "
    "members array<struct<type:string,ref:bigint,role:string>>, tags map<string,string>"
)
BY_KIND = {"node": NODES, "way": WAYS, "relation": RELATIONS, "any": ANY}

POINT = T.StructType([T.StructField("lon", T.IntegerType()), T.StructField("lat", T.IntegerType())])
LINE = T.ArrayType(POINT)

#: Coordinate of what has no position, on both axes.
NOWHERE = 2147483647
#: From this longitude on a position is no position: unresolved node i stands at MISSING_BASE + i, read as two halves,
#: so that the same missing node equals itself and no other.
MISSING_LON = 0x7F000000
MISSING_BASE = MISSING_LON << 32

TYPES = ("N", "W", "A", "C")
