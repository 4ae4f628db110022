"""References to geometry: way nodes, area rings, turn lines, collections and reverse membership.

Inputs are clean element tables with unique ids (see geochunk.operators.elements.live). Null entries of nds, and members
that are null, have a null ref or a type other than node, way, relation, are no references; a null role is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geochunk.functions.geometry import missing_point, point, polygons_udf, settle, settle_line, turn_lines_udf
from geochunk.schema import META, MISSING_LON
from geochunk.session import apart, materialize

AREA_TYPES = ("multipolygon", "boundary")
TURN_TYPES = ("restriction", "destination_sign")
AREA_ROLES = ("outer", "inner")
TURN_ROLES = ("from", "to", "via", "intersection")
VIA_ROLES = ("via", "intersection")

_LINE = "array<struct<lon:int,lat:int>>"


def _none(kind: str) -> Column:
    """An empty array (made when called: columns need a session)."""
    return F.array().cast(kind)


def positions(nodes: DataFrame) -> DataFrame:
    """(id, lon, lat) of nodes that have a position."""
    return nodes.select("id", "lon", "lat").where("lon is not null and lat is not null")


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, pts): the points of each way in order; a node that isn't there gets its stand-in position. Ways without
    references have no row."""
    refs = ways.select("id", F.posexplode(F.filter("nds", lambda x: x.isNotNull())).alias("pos", "ref"))
    at = positions(nodes).withColumnRenamed("id", "ref")
    p = F.when(F.col("lon").isNotNull(), point(F.col("lon"), F.col("lat"))).otherwise(missing_point(F.col("ref")))
    found = refs.join(apart(at), "ref", "left").select("id", F.struct("pos", p.alias("p")).alias("e"))
    ordered = found.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return ordered.select("id", F.transform("es", lambda e: e["p"]).alias("pts"))


def resolve_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``ways`` with pts (stand-in positions kept, empty for ways without references) in place of nds."""
    return ways.drop("nds", "pts").join(apart(way_points(ways, nodes)), "id", "left").withColumn("pts", F.coalesce("pts", _none(_LINE)))


def kind_of(relations: DataFrame) -> DataFrame:
    """``relations`` with sound members only, and with

    kind: ``area``, ``turn`` or null; used: members that go into its geometry; rest: the others, which make it a
    collection. A member is used by the kind's way roles, or, in a turn, as a via or intersection node.
    """
    sound = F.filter("members", lambda m: m["ref"].isNotNull() & m["type"].isin("node", "way", "relation"))
    sound = F.transform(sound, lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role")))
    r = relations.withColumn("members", F.coalesce(sound, F.array().cast(relations.schema["members"].dataType)))
    t = F.element_at("tags", "type")
    kind = F.when(t.isin(*AREA_TYPES), "area").when(t.isin(*TURN_TYPES), "turn")

    def used(m: Column) -> Column:
        way, k = m["type"] == "way", F.coalesce(F.col("kind"), F.lit(""))
        area = (k == "area") & way & m["role"].isin(*AREA_ROLES)
        turn = (k == "turn") & (way & m["role"].isin(*TURN_ROLES) | (m["type"] == "node") & m["role"].isin(*VIA_ROLES))
        return area | turn

    r = r.withColumn("kind", kind)
    return r.withColumn("used", F.filter("members", used)).withColumn("rest", F.filter("members", lambda m: ~used(m)))


def used_lines(kinds: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, kind, ord, role, line) of the used members that could be resolved: ways by inner join with resolved ``ways``,
    nodes by left join. ord keeps the members' order, ways before nodes."""
    m = kinds.select("id", "kind", F.posexplode("used").alias("pos", "m")).select("id", "kind", "pos", "m.*")
    lines = ways.select(F.col("id").alias("ref"), F.col("pts").alias("line"))
    w = m.where("type = 'way'").join(apart(lines), "ref").select("id", "kind", F.struct(F.lit(0).alias("pass"), "pos").alias("ord"), "role", "line")
    at = positions(nodes).withColumnRenamed("id", "ref")
    p = F.when(F.col("lon").isNotNull(), point(F.col("lon"), F.col("lat"))).otherwise(missing_point(F.col("ref")))
    n = m.where("type = 'node'").join(apart(at), "ref", "left").select("id", "kind", F.struct(F.lit(1).alias("pass"), "pos").alias("ord"), "role", F.array(p).alias("line"))
    return w.unionByName(n)


def _collected(lines: DataFrame, roles: dict[str, tuple[str, ...]]) -> DataFrame:
    aggs = [F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isin(*r), F.struct("ord", "line")))), lambda e: e["line"]).alias(n) for n, r in roles.items()]
    return lines.groupBy("id").agg(*aggs)


def relation_areas(lines: DataFrame) -> DataFrame:
    """(id, pts, holes): one row per outer ring of each area relation, rings open."""
    parts = _collected(lines.where("kind = 'area'"), {"outer": ("outer",), "inner": ("inner",)})
    areas = parts.select("id", polygons_udf("outer", "inner").alias("areas"))
    return areas.select("id", F.explode("areas").alias("a")).select("id", F.col("a.shell").alias("pts"), F.col("a.holes").alias("holes"))


def turn_ways(lines: DataFrame) -> DataFrame:
    """(id, pts): one row per line of each turn relation."""
    parts = _collected(lines.where("kind = 'turn'"), {"f": ("from",), "v": VIA_ROLES, "t": ("to",)})
    return parts.select("id", F.explode(turn_lines_udf("f", "v", "t")).alias("pts"))


def membership(kinds: DataFrame) -> DataFrame:
    """(kind, ref, members): for each element named by collections, array of (id, role, nr) in order of relation and
    member; nr counts the relation's members that went into no geometry."""
    m = kinds.select("id", F.posexplode("rest").alias("nr", "m"))
    key = F.struct("id", "nr", F.col("m.role").alias("role"))
    g = m.select(F.col("m.type").alias("kind"), F.col("m.ref").alias("ref"), key.alias("k")).groupBy("kind", "ref").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    return g.select("kind", "ref", F.transform("ks", lambda k: F.struct(k["id"].alias("id"), k["role"].alias("role"), k["nr"].alias("nr"))).alias("members"))


def with_members(df: DataFrame, kind: str, links: DataFrame) -> DataFrame:
    """``df`` with its reverse members; null where no collection names the element."""
    mine = links.where(F.col("kind") == kind).select(F.col("ref").alias("id"), F.col("members").alias("member_of"))
    return df.drop("member_of").join(apart(mine), "id", "left")


def significant(df: DataFrame) -> DataFrame:
    """Elements with tags, or named by a collection."""
    return df.where((F.size("tags") > 0) | F.col("member_of").isNotNull())


def all_elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """UNION ALL of the resolved elements: type, origin, id, metadata, pts, holes, tags, member_of.

    type N, W, A or C; origin node, way, turn, area or collection. Insignificant nodes and ways are dropped, what comes
    of relations never is. Points without position are at NOWHERE from here on. Further columns are ignored.

    ``nodes`` and ``relations`` are read by several branches: written tables are best (see plans.convert.staged). What
    several branches need besides (resolved ways, memberships, lines used by relations) is written here once.
    """
    own = ["id", *(c for c in META if c in nodes.columns), "tags"]
    nodes, ways, relations = nodes.select(*own, "lon", "lat"), ways.select(*own, "nds"), relations.select(*own, "members")
    kinds = kind_of(relations)
    links = materialize(membership(kinds), "links")
    resolved = materialize(resolve_ways(ways, nodes), "resolved")
    lines = materialize(used_lines(kinds, resolved, nodes), "lines")
    meta = [c for c in META if c in nodes.columns]
    cols = ["type", "origin", "id", *meta, "pts", "holes", "tags", "member_of"]

    def rows(df: DataFrame, kind: str, origin: str, pts: Column, holes: Column | None = None) -> DataFrame:
        holes = _none(f"array<{_LINE}>") if holes is None else holes
        return df.select(F.lit(kind).alias("type"), F.lit(origin).alias("origin"), "id", *meta, pts.alias("pts"), holes.alias("holes"), "tags", "member_of").select(cols)

    at = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull() & (F.col("lon") < MISSING_LON), point(F.col("lon"), F.col("lat"))).otherwise(settle(missing_point(F.lit(0).cast("long"))))
    heads = with_members(kinds.select("id", *meta, "tags", "rest"), "relation", links)
    out = rows(significant(with_members(nodes, "node", links)), "N", "node", F.array(at))
    out = out.unionByName(rows(significant(with_members(resolved, "way", links)), "W", "way", settle_line("pts")))
    out = out.unionByName(rows(heads.join(turn_ways(lines), "id"), "W", "turn", settle_line("pts")))
    out = out.unionByName(rows(heads.join(relation_areas(lines), "id"), "A", "area", settle_line("pts"), F.transform("holes", settle_line)))
    return out.unionByName(rows(heads.where(F.size("rest") > 0), "C", "collection", _none(_LINE)))
