"""Queries of the general problems and of the engine's own operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geochunk.config import default_rules, default_tiles
from geochunk.functions.geometry import assemble_rings_udf, in_ring, is_closed, is_clockwise, open_ring, polygons_udf, settle_line, wide_turn_lines_udf
from geochunk.operators import nested, resolve, tags
from geochunk.operators.classify import classify
from geochunk.operators.elements import all_live_tags, live, located
from geochunk.operators.hierarchy import hierarchies
from geochunk.operators.hotkeys import CELL, first_tile, salted_aggregate
from geochunk.operators.orphans import OrphanCascade
from geochunk.operators.proximity import near_pairs, points_in_regions
from geochunk.operators.tiling import assign_tiles, bbox as bbox_of
from geochunk.plans.convert import convert, data_tiles, staged
from geochunk.plans.fixtures import cleaned, dataset, segments
from geochunk.session import broadcast_checked, load, materialize, work_dir
from geochunk.sources import encode, sink
from geochunk.sources.read import read
from geochunk.sources.xml import read_xml, write_xml


# --- nested records ---------------------------------------------------------------------------------------------------


ELEMENT_COLUMNS = ("id", "version", "timestamp", "changeset", "lat", "lon")
ACTIONS = ("create", "modify", "delete")


def _action() -> Column:
    """The nearest of ACTIONS above a row; '' if none."""
    return F.coalesce(F.try_element_at(F.filter(F.split("path", "/"), lambda s: s.isin(*ACTIONS)), F.lit(-1)), F.lit(""))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per child of any element of any upload."""
    flat = nested.flatten_uploads(load(spark, d, "uploads"), tables=tuple(nested.CHILDREN), columns=nested.CHILD_COLUMNS)
    return nested.children(flat, "upload_id")


def p3_elements(spark: SparkSession, d: str) -> DataFrame:
    """The table of elements, each once per upload, and what was to be done with it."""
    e = nested.elements(nested.flatten_uploads(load(spark, d, "uploads"), tables=nested.ELEMENTS), ELEMENT_COLUMNS)
    return e.select("upload_id", "elem_type", "elem_id", *ELEMENT_COLUMNS, _action().alias("action")).distinct()


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """The table of members with their roles."""
    flat = nested.flatten_uploads(load(spark, d, "uploads"), tables=("member",), columns=("type", "ref", "role"))
    m = nested.of_elements(nested.table(flat, "member", ("type", "ref", "role")))
    return m.where(F.coalesce("type", "ref", "role").isNotNull()).select("upload_id", "elem_type", "elem_id", "pos", "type", "ref", "role").distinct()


def p3_meta(spark: SparkSession, d: str) -> DataFrame:
    """Columns that come from objects nested in an element: who made it."""
    e = nested.elements(nested.flatten_uploads(load(spark, d, "uploads"), tables=nested.ELEMENTS), ("meta/user/uid", "meta/user/name"))
    return e.where(F.coalesce("uid", "name").isNotNull()).select("upload_id", "elem_type", "elem_id", "uid", "name").distinct()


def p3_hints(spark: SparkSession, d: str) -> DataFrame:
    """A list of objects nested below an element."""
    flat = nested.flatten_uploads(load(spark, d, "uploads"), tables=("hints",))
    h = nested.of_elements(nested.table(flat, "hints", ("src",)), direct=False).where("step = 'meta/hints'")
    return h.select("upload_id", "elem_type", "elem_id", "pos", "src").distinct()


def p3_hint_values(spark: SparkSession, d: str) -> DataFrame:
    """A list of scalars in that list's objects, tied to the element over the row between."""
    flat = materialize(nested.flatten_uploads(load(spark, d, "uploads"), tables=("hints", "acc")), "hints")
    h = nested.of_elements(nested.table(flat, "hints", ()), direct=False).select("upload_id", "rec", F.col("row_id").alias("parent_id"), "elem_type", "elem_id", F.col("pos").alias("hint_pos"))
    v = nested.table(flat, "acc", (nested.VALUE,)).where("parent_tbl = 'hints' and step = 'acc'")
    keys = ["upload_id", "rec", "parent_id"]
    return v.select(*keys, "pos", nested.VALUE).distinct().join(h.distinct(), keys).select("upload_id", "elem_type", "elem_id", "hint_pos", "pos", nested.VALUE)


def p3_uploads(spark: SparkSession, d: str) -> DataFrame:
    """The records themselves, and how many elements each creates, modifies, deletes or just lists."""
    flat = nested.flatten_uploads(load(spark, d, "uploads"), tables=(nested.ROOT, *nested.ELEMENTS))
    root = F.col("tbl") == nested.ROOT
    own = {"generator": "generator", "changeset_id": "changeset/id", "changeset_comment": "changeset/comment"}
    rows = flat.select("upload_id", "rec", root.alias("root"), _action().alias("action"), *(F.when(root, F.element_at("fields", c)).alias(n) for n, c in own.items()))
    # a record that came twice has each of its rows twice
    times = F.count_if("root")
    n = lambda a: F.call_function("div", F.count_if(~F.col("root") & (F.col("action") == a)), times)
    g = rows.groupBy("upload_id", "rec").agg(*(F.max(c).alias(c) for c in own), *(n(a).alias(f"n_{a or 'listed'}") for a in (*ACTIONS, "")))
    return g.drop("rec")


# --- places -----------------------------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Located nodes at most 5 m apart, and the zones that hold located nodes."""
    points = materialize(located(load(spark, d, "nodes")), "located")
    near = near_pairs(points, 5.0).select(F.lit("near").alias("rel"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    zones = points_in_regions(points, load(spark, d, "zones")).select(
        F.lit("zone").alias("rel"), F.col("zone_id").cast("long").alias("key_a"), F.col("id").alias("key_b")
    )
    return near.unionByName(zones)


# --- hot keys ---------------------------------------------------------------------------------------------------------


def _tag_keys(spark: SparkSession, d: str) -> DataFrame:
    """(tag_key, kind, id) of live elements, and a row with a null key for each that has any tag."""
    e = all_live_tags(load(spark, d, "nodes"), load(spark, d, "ways"), load(spark, d, "relations")).where(F.size("tags") > 0)
    keys = F.concat(F.map_keys("tags"), F.array(F.lit(None).cast("string")))
    return e.select("kind", "id", F.explode(keys).alias("tag_key"))


def _node_tiles(spark: SparkSession, d: str) -> DataFrame:
    return first_tile(located(load(spark, d, "nodes")), load(spark, d, "tiles"))


def _hot(rows: DataFrame, key: str) -> DataFrame:
    return salted_aggregate(rows, [key], ["id"], {"n": F.count("*")}, {"n": F.sum("n")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Tag keys held by at least 5 % of the live elements with any tag; tiles with at least 5 % of the located nodes."""
    keys = materialize(_hot(materialize(_tag_keys(spark, d), "tag-keys"), "tag_key"), "per-key")
    tiles = materialize(_hot(materialize(_node_tiles(spark, d).select("id", "tile_id"), "node-tiles"), "tile_id"), "per-tile")
    tagged, nodes = keys.where("tag_key is null").select(F.col("n").alias("all")), tiles.agg(F.sum("n").alias("all"))
    hot = lambda t, total, name, key: t.where(F.col(key).isNotNull()).join(F.broadcast(total), F.col("n") * 20 >= F.col("all")).select(F.lit(name).alias("dim"), F.col(key).cast("string").alias("hot_key"))
    return hot(keys, tagged, "tag_key", "tag_key").unionByName(hot(tiles, nodes, "tile", "tile_id"))


def p5_tag_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per tag key: elements, elements by kind, smallest and largest id."""
    rows = materialize(_tag_keys(spark, d).where("tag_key is not null"), "tag-keys")
    kinds = {f"n_{k}": F.count_if(F.col("kind") == k) for k in "nwr"}
    part = {"n_elements": F.count("*"), **kinds, "min_id": F.min("id"), "max_id": F.max("id")}
    merge = {"n_elements": F.sum("n_elements"), **{c: F.sum(c) for c in kinds}, "min_id": F.min("min_id"), "max_id": F.max("max_id")}
    return salted_aggregate(rows, ["tag_key"], ["id"], part, merge)


def p5_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Per tile: located nodes and their extent."""
    rows = materialize(_node_tiles(spark, d), "node-tiles")
    part = {"n_nodes": F.count("*"), "west": F.min("lon"), "east": F.max("lon"), "south": F.min("lat"), "north": F.max("lat")}
    merge = {"n_nodes": F.sum("n_nodes"), "west": F.min("west"), "east": F.max("east"), "south": F.min("south"), "north": F.max("north")}
    return salted_aggregate(rows, ["tile_id"], ["id"], part, merge)


# --- orphans ----------------------------------------------------------------------------------------------------------


def _cascade(spark: SparkSession, d: str) -> OrphanCascade:
    return OrphanCascade(load(spark, d, "nodes"), load(spark, d, "ways"), load(spark, d, "relations"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 of the cascade; what is inherited from it is no case here and is not worked out."""
    return _cascade(spark, d).direct().select("src_table", "month_key", "src_id", "ref_type", "ref_id", "ref_state")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, month and state: references, and rows that hold them."""
    by = ["src_table", "month_key", "orphan", "ref_state"]
    rows = _cascade(spark, d).rows().groupBy(*by, "src_id").agg(F.count("*").alias("n"))
    return rows.groupBy(*by).agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_rows"))


# --- hierarchies ------------------------------------------------------------------------------------------------------


def relation_links(relations: DataFrame) -> DataFrame:
    """(parent, child) of live relations naming live relations."""
    r = materialize(live(relations, ["members"]), "live-relations")
    refs = F.array_distinct(F.transform(F.filter("members", lambda m: (m["type"] == "relation") & m["ref"].isNotNull()), lambda m: m["ref"]))
    links = r.select(F.col("id").alias("parent"), F.explode(refs).alias("child"))
    return links.join(r.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every downward path of every root, and the relations on cycles."""
    h = hierarchies(relation_links(load(spark, d, "relations")))
    path = F.array_join(F.col("path").cast("array<string>"), ">")
    return h.select("kind", "root_id", F.col("node_id").alias("relation_id"), F.col("depth").alias("tree_depth"), path.alias("id_path"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Per relation on some path: how many distinct relations lie below it, and how deep."""
    h = hierarchies(relation_links(load(spark, d, "relations"))).where("kind = 'path'")
    pairs = h.select("node_id", F.posexplode("path").alias("pos", "ancestor_id"), "depth")
    pairs = pairs.groupBy("ancestor_id", "node_id").agg(F.max(F.col("depth") - F.col("pos")).alias("below"))
    return pairs.groupBy("ancestor_id").agg((F.count("*") - 1).alias("n_descendants"), F.max("below").alias("height"))


# --- the engine's own operators ---------------------------------------------------------------------------------------

_KINDS = {"n": "nodes", "w": "ways", "r": "relations"}


def bbox(spark: SparkSession, d: str) -> DataFrame:
    return bbox_of(dataset(spark, d).nodes)


def _each(spark: SparkSession, d: str, f: Callable[[DataFrame], DataFrame], cleaned_: bool = False) -> DataFrame:
    """UNION ALL of f over the three tables, with their kind."""
    x = cleaned(spark, d) if cleaned_ else dataset(spark, d)
    parts = [f(getattr(x, t)).withColumn("kind", F.lit(k)) for k, t in _KINDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def clean_tags(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, lambda t: t.select("id", F.explode("tags").alias("tag_key", "tag_value")), True)


def discarded_tags(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, lambda t: t.agg(F.coalesce(tags.discarded(t), F.lit(0)).alias("n_discarded"), F.count("*").alias("n_elements")))


def project_meta(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, lambda t: tags.preserve(t, ("version", "user")).select("id", "version", "timestamp", "changeset", "uid", "user"))


def resolve_ways(spark: SparkSession, d: str) -> DataFrame:
    x = cleaned(spark, d)
    w = resolve.resolve_ways(x.ways, x.nodes).withColumn("pts", settle_line("pts"))
    n_missing = F.size(F.filter("pts", lambda p: p["lon"] == 2147483647))
    terms = F.transform("pts", lambda p, i: (i + 1) * (p["lon"].cast("long") + 31 * p["lat"].cast("long")))
    total = F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + t)
    return w.select("id", F.size("pts").alias("n_points"), n_missing.alias("n_missing"), total.alias("checksum"))


def closed_ways(spark: SparkSession, d: str) -> DataFrame:
    x = cleaned(spark, d)
    w = resolve.resolve_ways(x.ways, x.nodes).withColumn("pts", settle_line("pts"))
    return w.where(is_closed("pts")).select("id", F.size(open_ring("pts")).alias("n_vertices"))


def _significant(spark: SparkSession, d: str, kind: str) -> DataFrame:
    x = cleaned(spark, d)
    links = resolve.membership(resolve.kind_of(x.relations))
    return resolve.significant(resolve.with_members(getattr(x, kind + "s"), kind, links)).select("id")


def significant_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _significant(spark, d, "node")


def significant_ways(spark: SparkSession, d: str) -> DataFrame:
    return _significant(spark, d, "way")


def membership(spark: SparkSession, d: str) -> DataFrame:
    m = resolve.membership(resolve.kind_of(cleaned(spark, d).relations))
    return m.select("kind", "ref", F.posexplode("members").alias("place", "m")).select("kind", "ref", "place", F.col("m.id").alias("relation_id"), "m.role", "m.nr")


def relation_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = resolve.kind_of(cleaned(spark, d).relations)
    return k.select("id", F.coalesce("kind", F.lit("")).alias("kind"), F.size("used").alias("n_used"), F.size("rest").alias("n_rest"))


def counters(spark: SparkSession, d: str) -> DataFrame:
    """What a conversion counts: elements read, relations by kind, discarded tags, references that found nothing."""
    raw, x = dataset(spark, d), cleaned(spark, d)
    kinds = resolve.kind_of(x.relations)
    refs = x.ways.select(F.explode(F.filter("nds", lambda r: r.isNotNull())).alias("id"))
    used = kinds.select(F.explode("used").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id"))
    number = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    parts = [number(t, getattr(x, t)) for t in ("nodes", "ways", "relations")]
    parts += [number("area_relations", kinds.where("kind = 'area'")), number("turn_relations", kinds.where("kind = 'turn'")), number("collections", kinds.where(F.size("rest") > 0))]
    parts += [number("missing_nodes", refs.join(resolve.positions(x.nodes), "id", "left_anti")), number("missing_ways", used.join(x.ways, "id", "left_anti"))]
    gone = [t.agg(F.coalesce(tags.discarded(t), F.lit(0)).alias("n")) for t in (raw.nodes, raw.ways, raw.relations)]
    gone = gone[0].unionByName(gone[1]).unionByName(gone[2]).agg(F.sum("n").alias("n")).select(F.lit("discarded_tags").alias("counter"), "n")
    out = gone
    for p in parts:
        out = out.unionByName(p)
    return out


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return data_tiles(spark, dataset(spark, d).nodes, default_tiles()).drop("raw_id")


def _placed(spark: SparkSession, d: str, *origins: str) -> DataFrame:
    """Elements with their tiles: those of some origins, or all, what relations' members build included."""
    x, grids = staged(cleaned(spark, d)), default_tiles()
    e = resolve.all_elements(x.nodes, x.ways, x.relations)
    e = e.where(F.col("origin").isin(*origins)) if origins else e
    return materialize(assign_tiles(e, grids, materialize(data_tiles(spark, x.nodes, grids), "tiles")), "placed")


def tile_elements(spark: SparkSession, d: str) -> DataFrame:
    """First containing tile of every element; an area relation comes once an outer ring, a turn once a line."""
    return _placed(spark, d).select("type", "id", "chunk_id")


def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).groupBy("type", "chunk_id").agg(F.count("*").alias("n"))


def _classified(spark: SparkSession, d: str, *origins: str, one_element: bool = False) -> DataFrame:
    return classify(_placed(spark, d, *origins), default_rules(), one_element)


def classify_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = _classified(spark, d, "node")
    return c.select("id", "block_key", "slice_value", F.coalesce(F.element_at("tags", "lifecycle"), F.lit("")).alias("lifecycle"))


def classify_ways(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "way").select("type", "id", "block_key", "slice_value")


def classify_collections(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, "collection").select("id", "block_key", "slice_value")


def one_element(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d, one_element=True).select("type", "id", "block_key", "slice_value")


def slice_counts(spark: SparkSession, d: str) -> DataFrame:
    """Features per type, tile, key and value, relations' areas and turns included."""
    return _classified(spark, d).groupBy("type", "chunk_id", "block_key", "slice_value").agg(F.count("*").alias("n"))


def block_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, blocks and slices per type."""
    s = slice_counts(spark, d)
    return s.groupBy("type").agg(
        F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("chunk_id", "block_key").alias("n_blocks"), F.count("*").alias("n_slices"), F.sum("n").alias("n_rows")
    )


def cluster_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of each feature in its chunk: by key, value, id. (Equal ones, such as rings of one relation, share a place.)"""
    c = _classified(spark, d)
    w = Window.partitionBy("type", "chunk_id").orderBy("key_ord", "value_ord", "id")
    return c.select("type", "chunk_id", "id", "block_key", F.rank().over(w).alias("place"))


def union_elements(spark: SparkSession, d: str) -> DataFrame:
    x = staged(cleaned(spark, d))
    e = resolve.all_elements(x.nodes, x.ways, x.relations)
    return e.groupBy("type", "origin").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"), F.sum(F.coalesce(F.size("member_of"), F.lit(0))).alias("n_links"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """The whole conversion, relations' areas and turns included: rows per type, origin and key."""
    f, _ = convert(cleaned(spark, d))
    points = F.sum(F.size("pts") + F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h)))
    return f.groupBy("type", "origin", "block_key").agg(F.count("*").alias("n"), points.alias("n_points"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    x = staged(cleaned(spark, d))
    return resolve.used_lines(resolve.kind_of(x.relations), materialize(resolve.resolve_ways(x.ways, x.nodes), "resolved"), x.nodes)


def relation_areas(spark: SparkSession, d: str) -> DataFrame:
    """One row per area of a relation: points of its shell, holes and their points."""
    lines = _lines(spark, d)
    points = F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h))
    return resolve.relation_areas(lines).select("id", F.size("pts").alias("n_points"), F.size("holes").alias("n_holes"), points.alias("n_hole_points"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """One row per line of a turn relation: its points, and where it begins and ends."""
    t = resolve.turn_ways(_lines(spark, d)).withColumn("pts", settle_line("pts"))
    end = lambda i, c: F.element_at("pts", i)[c]
    return t.select("id", F.size("pts").alias("n_points"), *(end(i, c).alias(f"{n}_{c}") for i, n in ((1, "from"), (-1, "to")) for c in ("lon", "lat")))


def _rings(spark: SparkSession, d: str) -> DataFrame:
    z = load(spark, d, "zones").where(F.size("ring") > 0)
    return z.select("zone_id", F.concat("ring", F.slice("ring", 1, 1)).alias("ring"))


def point_in_ring(spark: SparkSession, d: str) -> DataFrame:
    """How many vertices of each zone lie in which other zones. Zones whose extents don't meet are no candidates."""
    z = _rings(spark, d)
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    box = z.select("zone_id", "ring", *(f(c).alias(n) for f, c, n in ((F.array_min, lons, "x0"), (F.array_min, lats, "y0"), (F.array_max, lons, "x1"), (F.array_max, lats, "y1"))))
    v = z.select(F.col("zone_id").alias("point_of"), F.explode(F.slice("ring", 1, F.size("ring") - 1)).alias("p")).select("point_of", "p.lon", "p.lat")
    # an equi-join on cells of one degree instead of comparing all with all
    cell = lambda a, b, n: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL))).alias(n)
    box = box.select("*", cell("x0", "x1", "cx")).select("*", cell("y0", "y1", "cy"))
    v = v.withColumns({"cx": F.floor(F.col("lon") / CELL), "cy": F.floor(F.col("lat") / CELL)})
    j = v.join(broadcast_checked(box), ["cx", "cy"]).where("point_of <> zone_id and lon between x0 and x1 and lat between y0 and y1")
    return j.where(in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("zone_id", "point_of").agg(F.count("*").alias("n_vertices"))


def orient_areas(spark: SparkSession, d: str) -> DataFrame:
    """Direction of the closed ways' rings, in 32-bit and in 64-bit arithmetic."""
    x = cleaned(spark, d)
    w = resolve.resolve_ways(x.ways, x.nodes).withColumn("pts", settle_line("pts")).where(is_closed("pts"))
    w = w.select("id", open_ring("pts").alias("ring"))
    return w.select("id", is_clockwise(F.col("ring")).alias("clockwise"), is_clockwise(F.col("ring"), True).alias("clockwise_exact"))


def ring_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled, partly reversed segments of one ring a customer: rings, and vertices of the ring stored open."""
    g = segments(spark, d).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("pos", "o", "line"))).alias("s"))
    r = g.select("owner", assemble_rings_udf(F.transform("s", lambda e: e["line"])).alias("rings"))
    return r.select("owner", F.size("rings").alias("n_rings"), F.aggregate("rings", F.lit(0), lambda a, x: a + F.size(x) - 1).alias("n_vertices"))


def from_to(spark: SparkSession, d: str) -> DataFrame:
    """From the first segment of a customer's ring over its shared point into the second, via inferred."""
    g = segments(spark, d).where("n >= 3").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("s"))
    at = lambda i: F.array(F.get("s", F.lit(i))["line"])
    none = F.slice(at(0), 1, 0)
    t = g.select("owner", F.explode(wide_turn_lines_udf(at(0), none, at(1))).alias("line"))
    return t.select("owner", F.posexplode("line").alias("place", "p")).select("owner", "place", "p.lon", "p.lat")


def turn_cases(spark: SparkSession, d: str) -> DataFrame:
    """Turns over segments of a customer's ring whose lines are known: over a node, over two ways, without from, and with
    a from that touches the far end."""
    g = segments(spark, d).groupBy("owner", "n").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("s"))
    seg = lambda *at: F.array(*(F.get("s", F.lit(i))["line"] for i in at))
    nodes = F.array_intersect(F.get("s", F.lit(0))["line"], F.get("s", F.lit(1))["line"])  # the point both share
    none = F.slice(seg(0), 1, 0)
    cases = {"node": (3, seg(0), F.array(nodes), seg(1)), "ways": (6, seg(0), seg(2, 1), seg(3)), "no from": (3, none, F.array(nodes), seg(1)), "far": (4, seg(2), F.array(nodes), seg(1))}
    out = None
    for name, (least, from_, via, to) in cases.items():
        t = g.where(F.col("n") >= least).select(F.lit(name).alias("kind"), "owner", F.explode(wide_turn_lines_udf(from_, via, to)).alias("line"))
        out = t if out is None else out.unionByName(t)
    return out.select("kind", "owner", F.posexplode("line").alias("place", "p")).select("kind", "owner", "place", "p.lon", "p.lat")


def nested_rings(spark: SparkSession, d: str) -> DataFrame:
    """A customer's nested squares, each of two lines, by turns shells and holes: every hole is in the shell around it."""
    c = load(spark, d, "customer").selectExpr("c_custkey AS owner", "int(1 + c_custkey % 6) AS n", "int(100000000 + c_custkey * 1000) AS x", "int(480000000) AS y")
    p = lambda dx, dy: f"named_struct('lon', x {dx} 50 * (n - i), 'lat', y {dy} 50 * (n - i))"
    a, b, c_, e = p("-", "-"), p("+", "-"), p("+", "+"), p("-", "+")
    lines = f"array(array({a}, {b}, {c_}), if(owner % 2 = 0, array({a}, {e}, {c_}), array({c_}, {e}, {a})))"
    of = lambda odd: F.expr(f"flatten(transform(filter(sequence(0, n - 1), i -> i % 2 = {odd}), i -> {lines}))")
    r = c.select("owner", F.explode(polygons_udf(of(0), of(1))).alias("a"))
    west = lambda c: F.array_min(F.transform(c, lambda q: q["lon"]))
    return r.select("owner", west("a.shell").alias("west"), F.size("a.shell").alias("n_points"), F.size("a.holes").alias("n_holes"), F.coalesce(west(F.flatten("a.holes")), F.lit(0)).alias("hole_west"))


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Tags of nodes after lifecycle rewrites, where there were any."""
    c = _classified(spark, d, "node").dropDuplicates(["id"])
    before = cleaned(spark, d).nodes.select("id", F.map_keys("tags").alias("was"))
    c = c.join(before, "id").where(F.size(F.array_except(F.map_keys("tags"), "was")) > 0)
    return c.select("id", F.explode("tags").alias("tag_key", "tag_value"))


def _new_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/{uuid.uuid4().hex[:12]}"


def read_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Write the whole layout, then read buildings (closed ways and relations' areas) and highways' tracks inside a box.

    The SQL knows ways only: it lacks the relations' areas."""
    x = cleaned(spark, d)
    rows, t = convert(x)
    path = _new_folder(spark)
    sink.write(rows, t, path)
    box = (50_000_000, 400_000_000, 300_000_000, 500_000_000)
    got = sink.read_features(spark, path, box, ("A",), "building").unionByName(sink.read_features(spark, path, box, ("W",), "highway", "track"))
    return got.select("type", "id", "block_key", "slice_value")


def _plain(df: DataFrame, own: str) -> DataFrame:
    """Elements as sources give them: no nulls but in lists."""
    fill = {"version": 0, "timestamp": 0, "changeset": 0, "uid": 0, "user": ""}
    text = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1f]", " ")
    df = df.withColumn("tags", F.transform_values("tags", lambda k, v: text(v))).fillna(fill)
    if own == "nds":
        df = df.withColumn("nds", F.coalesce(F.filter("nds", lambda x: x.isNotNull()), F.array().cast("array<bigint>")))
    if own == "members":
        good = F.filter("members", lambda m: m["ref"].isNotNull() & m["type"].isin("node", "way", "relation"))
        good = F.transform(good, lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), F.coalesce(m["role"], F.lit("")).alias("role")))
        df = df.withColumn("members", F.coalesce(good, F.array().cast(df.schema["members"].dataType)))
    return df


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    x = cleaned(spark, d)
    nodes = _plain(x.nodes, "").where("lon is not null and lat is not null")
    cols = ["id", "version", "timestamp", "changeset", "uid", "user"]
    return nodes.select(*cols, "lon", "lat", "tags"), _plain(x.ways, "nds").select(*cols, "nds", "tags"), _plain(x.relations, "members").select(*cols, "members", "tags")


def _summary(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """One row per element: kind, id, version, timestamp, uid, n_tags, place (a checksum of position or references)."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + t)
    place = {
        "n": F.col("lon").cast("long") * 31 + F.col("lat"),
        "w": total(F.transform("nds", lambda r, i: (i + 1) * r)),
        "r": total(F.transform("members", lambda m, i: (i + 1) * (m["ref"] + F.length(m["role"])))),
    }
    parts = [t.select(F.lit(k).alias("kind"), "id", "version", "timestamp", "uid", F.size("tags").alias("n_tags"), p.alias("place")) for (k, p), t in zip(place.items(), (nodes, ways, relations))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_xml_files(spark: SparkSession, d: str) -> DataFrame:
    """The live elements, written as XML and read again."""
    out = []
    for kind, t in zip(("node", "way", "relation"), _sources(spark, d)):
        path = _new_folder(spark)
        write_xml(t, kind, path)
        out.append(read_xml(spark, path, kind, exact=True))
    return _summary(*out)


def _binary(spark: SparkSession, d: str, format: str) -> DataFrame:
    """The live elements, written in files of a binary format by each partition and read again.

    A file is named by kind, partition and batch and put in place when it is whole, so a task run again writes the same
    files and doubles no rows. The format is written through the file system, which all executors must see."""
    path = _new_folder(spark)
    local = path.removeprefix("file://").removeprefix("file:")
    if "://" in local:
        raise ValueError("files of this format can be written to a mounted folder only")
    Path(local).mkdir(parents=True, exist_ok=True)
    for kind, t in zip(("nodes", "ways", "relations"), _sources(spark, d)):

        def put(batches, kind=kind):
            part = TaskContext.get().partitionId()
            for i, b in enumerate(batches):
                draft = Path(local) / f".{uuid.uuid4().hex}"
                draft.write_bytes(getattr(encode, format)(**{kind: [r | {"tags": dict(r["tags"])} for r in b.to_pylist()]}))
                draft.rename(Path(local) / f"{kind}-{part}-{i}")
                yield b.slice(0, 0).select(["id"])

        # written tables give every attempt of a task the same rows
        materialize(t, kind).mapInArrow(put, "id bigint").count()
    x = read(spark, path, format)
    return _summary(x.nodes, x.ways, x.relations)


def read_pbf(spark: SparkSession, d: str) -> DataFrame:
    return _binary(spark, d, "pbf")


def read_o5m(spark: SparkSession, d: str) -> DataFrame:
    return _binary(spark, d, "o5m")


_OWN = [
    bbox, clean_tags, discarded_tags, project_meta, resolve_ways, closed_ways, significant_nodes, significant_ways, membership, relation_kinds, counters,
    tiles, tile_elements, chunk_index, classify_nodes, classify_ways, classify_collections, one_element, slice_counts, block_stats, cluster_order,
    union_elements, features, relation_areas, turns, point_in_ring, orient_areas, ring_assembly, from_to, turn_cases, nested_rings, lifecycle, read_pruned, read_xml_files,
    read_pbf, read_o5m,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_elements": p3_elements,
    "p3_members": p3_members,
    "p3_meta": p3_meta,
    "p3_hints": p3_hints,
    "p3_hint_values": p3_hint_values,
    "p3_uploads": p3_uploads,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_tag_keys": p5_tag_keys,
    "p5_tiles": p5_tiles,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_descendants": p7_descendants,
    **{f.__name__: f for f in _OWN},
}
