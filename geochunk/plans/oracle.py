"""DuckDB SQL for the queries of geochunk.plans.queries: the same results by other means (plain joins over whole tables)."""

from __future__ import annotations

from geochunk.config import Rules, default_rules, default_tiles
from geochunk.operators.elements import DISCARDABLE


def _q(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: _q(v) if isinstance(v, str) else str(v).lower()
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


_DISCARD = ", ".join(map(_q, DISCARDABLE))


def _current(table: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, loaded_at ASC NULLS LAST) AS rn FROM {table} WHERE id IS NOT NULL) WHERE rn = 1)"


def live(table: str) -> str:
    return f"(SELECT * FROM {_current(table)} WHERE visible)"


LOCATED = f"(SELECT id, lon, lat FROM {live('nodes')} WHERE lon BETWEEN -1800000000 AND 1800000000 AND lat BETWEEN -900000000 AND 900000000 AND NOT (lon = 0 AND lat = 0))"

_ALL = (("n", "nodes"), ("w", "ways"), ("r", "relations"))


def _each(select: str) -> str:
    return " UNION ALL ".join(f"({select.format(kind=k, table=live(t))})" for k, t in _ALL)


def tag_rows(table: str, keep_discardable: bool = False) -> str:
    """(id, k, v) of the live elements of a table; null values are ''."""
    where = "" if keep_discardable else f" WHERE e.key NOT IN ({_DISCARD})"
    return f"(SELECT id, e.key AS k, coalesce(e.value, '') AS v FROM (SELECT id, unnest(map_entries(tags)) AS e FROM {live(table)}){where})"


#: Common tables of the reference's operators.
_BASE = f"""
cn AS (SELECT * FROM {live("nodes")}), cw AS (SELECT * FROM {live("ways")}), cr AS (SELECT * FROM {live("relations")}),
nt AS {tag_rows("nodes")}, wt AS {tag_rows("ways")}, rt AS {tag_rows("relations")},
pos AS (SELECT id, lon, lat FROM cn WHERE lon IS NOT NULL AND lat IS NOT NULL),
refs AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY place) AS place, ref FROM
  (SELECT id, unnest(nds) AS ref, generate_subscripts(nds, 1) AS place FROM cw) WHERE ref IS NOT NULL),
pts AS (SELECT r.id, r.place, CASE WHEN p.id IS NULL OR p.lon >= 2130706432 THEN 2147483647 ELSE p.lon END AS lon,
  CASE WHEN p.id IS NULL OR p.lon >= 2130706432 THEN 2147483647 ELSE p.lat END AS lat FROM refs r LEFT JOIN pos p ON r.ref = p.id),
shape AS (SELECT id, count(*) AS n, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1,
  count(*) >= 3 AND arg_min(lon, place) = arg_max(lon, place) AND arg_min(lat, place) = arg_max(lat, place) AS closed FROM pts GROUP BY id),
mem AS (SELECT c.id, c.place, c.m.type AS type, c.m.ref AS ref, coalesce(c.m.role, '') AS role, coalesce(t.v, '') AS rtype FROM
  (SELECT id, unnest(members) AS m, generate_subscripts(members, 1) AS place FROM cr) c LEFT JOIN rt t ON t.id = c.id AND t.k = 'type'
  WHERE c.m.ref IS NOT NULL AND c.m.type IN ('node', 'way', 'relation')),
sorted AS (SELECT *, (rtype IN ('multipolygon', 'boundary') AND type = 'way' AND role IN ('outer', 'inner'))
  OR (rtype IN ('restriction', 'destination_sign') AND (type = 'way' AND role IN ('from', 'to', 'via', 'intersection') OR type = 'node' AND role IN ('via', 'intersection'))) AS used FROM mem),
rest AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS nr FROM sorted WHERE NOT used),
sn AS (SELECT id FROM cn WHERE id IN (SELECT id FROM nt) OR id IN (SELECT ref FROM rest WHERE type = 'node')),
sw AS (SELECT id FROM cw WHERE id IN (SELECT id FROM wt) OR id IN (SELECT ref FROM rest WHERE type = 'way')),
coll AS (SELECT DISTINCT id FROM rest)
"""

#: Lines that go into relations' geometry. A missing node stands at a place of its own, so that it meets itself only.
_LINES = """
raw AS (SELECT r.id, r.place, coalesce(p.lon, 2130706432 + ((r.ref & 72057594037927935) >> 32)) AS lon,
  coalesce(p.lat, ((r.ref & 4294967295) + 2147483648) % 4294967296 - 2147483648) AS lat FROM refs r LEFT JOIN pos p ON r.ref = p.id),
way_line AS (SELECT id, list({'x': lon, 'y': lat} ORDER BY place) AS pts FROM raw GROUP BY id),
piece AS (SELECT m.id, m.rtype, m.role, m.place, 0 AS pass, coalesce(l.pts, []) AS pts FROM sorted m JOIN cw ON cw.id = m.ref LEFT JOIN way_line l ON l.id = m.ref WHERE used AND type = 'way'
  UNION ALL SELECT m.id, m.rtype, m.role, m.place, 1, [{'x': coalesce(p.lon, 2130706432 + ((m.ref & 72057594037927935) >> 32)), 'y': coalesce(p.lat, ((m.ref & 4294967295) + 2147483648) % 4294967296 - 2147483648)}]
  FROM sorted m LEFT JOIN pos p ON p.id = m.ref WHERE used AND type = 'node')
"""

#: Rings by walks over lines with equal ends, depth by containment, each hole to the first shell that holds a vertex of it.
_AREAS = """
ln AS (SELECT id, role, row_number() OVER (PARTITION BY id, role ORDER BY place) AS k, pts, len(pts) AS n, pts[1] AS h, pts[-1] AS t FROM piece WHERE rtype IN ('multipolygon', 'boundary')),
tip AS (SELECT id, role, h AS p FROM ln WHERE h <> t UNION ALL SELECT id, role, t FROM ln WHERE h <> t),
loose AS (SELECT id, role FROM tip GROUP BY id, role, p HAVING count(*) % 2 = 1 UNION SELECT id, role FROM ln WHERE n = 0),
good AS (SELECT * FROM ln WHERE (id, role) NOT IN (SELECT (id, role) FROM loose)),
walk(id, role, step, k, flip, head, tail, taken, ring) AS (
  SELECT id, role, 1, k, false, h, t, [k], 1 FROM good WHERE k = 1
  UNION ALL SELECT w.id, w.role, step + 1, g.k, w.head <> w.tail AND g.h <> w.tail, CASE WHEN w.head = w.tail THEN g.h ELSE w.head END,
    CASE WHEN w.head <> w.tail AND g.h <> w.tail THEN g.h ELSE g.t END, list_append(taken, g.k), ring + (w.head = w.tail)::INT
  FROM walk w JOIN good g ON g.id = w.id AND g.role = w.role AND NOT list_contains(taken, g.k) AND (w.head = w.tail OR g.h = w.tail OR g.t = w.tail)
  QUALIFY row_number() OVER (PARTITION BY w.id, w.role ORDER BY g.k) = 1),
vert AS (SELECT id, role, ring, row_number() OVER (PARTITION BY id, role, ring ORDER BY step, i) AS seq, p.x AS x, p.y AS y FROM
  (SELECT w.id, w.role, w.ring, w.step, unnest(CASE WHEN flip THEN list_reverse(pts) ELSE pts END) AS p, generate_subscripts(pts, 1) AS i FROM walk w JOIN good g USING (id, role, k))),
edge AS (SELECT id, role, ring, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS b_y FROM vert WINDOW w AS (PARTITION BY id, role, ring ORDER BY seq)),
inside AS (SELECT DISTINCT id, role, ring, shell FROM (SELECT v.id, v.role, v.ring, e.ring AS shell, v.seq FROM vert v JOIN edge e ON e.id = v.id AND e.role = 'outer' AND NOT (v.role = 'outer' AND v.ring = e.ring)
  WHERE ay <> b_y AND (ay <= y) = (y < b_y) AND ax + ((bx - ax)::HUGEINT * (y - ay)) // (b_y - ay) < x GROUP BY ALL HAVING count(*) % 2 = 1)),
shells AS (SELECT v.id, v.ring, count(*) - 1 AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
  (SELECT count(*) FROM inside i WHERE i.id = v.id AND i.role = 'outer' AND i.ring = v.ring) AS depth FROM vert v WHERE role = 'outer' GROUP BY v.id, v.ring),
hole AS (SELECT i.id, i.ring, arg_min(i.shell, (-s.depth, s.ring)) AS shell FROM inside i JOIN shells s ON s.id = i.id AND s.ring = i.shell WHERE i.role = 'inner' GROUP BY i.id, i.ring),
hole_pts AS (SELECT h.id, h.shell, count(DISTINCT h.ring) AS n_holes, count(*) - count(DISTINCT h.ring) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
  FROM hole h JOIN vert v ON v.id = h.id AND v.ring = h.ring AND v.role = 'inner' GROUP BY h.id, h.shell),
areas AS (SELECT s.id, s.ring AS part, s.n, s.x0, s.y0, s.x1, s.y1, coalesce(h.n_holes, 0) AS n_holes, coalesce(h.n, 0) AS n_hole_points,
  least(s.x0, h.x0) AS ox0, least(s.y0, h.y0) AS oy0, greatest(s.x1, h.x1) AS ox1, greatest(s.y1, h.y1) AS oy1 FROM shells s LEFT JOIN hole_pts h ON h.id = s.id AND h.shell = s.ring)
"""

#: Turn lines: the via line is grown part by part, then every to and from hang on its ends. (A closed from is left by its
#: first and last stretch in turns; from lines that touch both the head and the far point are taken each by itself.)
_TURNS = """
tp AS (SELECT id, CASE role WHEN 'from' THEN 'f' WHEN 'to' THEN 't' ELSE 'v' END AS part, pts, row_number() OVER (PARTITION BY id, CASE role WHEN 'from' THEN 'f' WHEN 'to' THEN 't' ELSE 'v' END ORDER BY pass, place) AS k
  FROM piece WHERE rtype IN ('restriction', 'destination_sign')),
fine AS (SELECT * FROM tp WHERE id NOT IN (SELECT id FROM tp WHERE len(pts) = 0)),
fr AS (SELECT * FROM fine WHERE part = 'f'), tt AS (SELECT * FROM fine WHERE part = 't'),
guess AS (SELECT id, o, p FROM (SELECT id, 1 AS o, pts[1] AS p FROM tt WHERE k = 1 UNION ALL SELECT id, 2, pts[-1] FROM tt WHERE k = 1) g WHERE id NOT IN (SELECT id FROM fine WHERE part = 'v')
  AND NOT EXISTS (SELECT 1 FROM fine x WHERE x.id = g.id AND NOT (x.part = 't' AND x.k = 1) AND x.pts[1] <> p AND x.pts[-1] <> p)),
tv AS (SELECT id, k, pts FROM fine WHERE part = 'v' UNION ALL SELECT id, 1, [arg_min(p, o)] FROM guess GROUP BY id),
grown(id, step, line, taken, last, turned) AS (
  SELECT id, 1, pts, [k], 1, false FROM tv WHERE k = 1
  UNION ALL SELECT g.id, step + 1, CASE WHEN v.k IS NULL THEN list_reverse(line) WHEN v.pts[1] = line[-1] THEN list_concat(line, v.pts[2:]) ELSE list_concat(line, list_reverse(v.pts)[2:]) END,
    CASE WHEN v.k IS NULL THEN taken ELSE list_append(taken, v.k) END, coalesce(v.k, 0), turned OR v.k IS NULL
  FROM grown g LEFT JOIN tv v ON v.id = g.id AND NOT list_contains(taken, v.k) AND (v.pts[1] = line[-1] OR v.pts[-1] = line[-1]) WHERE NOT (v.k IS NULL AND turned)
  QUALIFY row_number() OVER (PARTITION BY g.id ORDER BY v.k IS NULL, v.k <= g.last, v.k) = 1),
vias AS (SELECT id, count(*) AS n FROM tv GROUP BY id),
base AS (SELECT g.id, CASE WHEN n = 1 THEN arg_min(line, step) ELSE arg_max(line, step) END AS line FROM grown g JOIN vias USING (id) GROUP BY g.id, n HAVING arg_max(len(taken), step) = n),
into_ AS (SELECT t.id, t.k, way, CASE WHEN t.pts[-1] = way[-1] THEN t.pts[-2] ELSE t.pts[2] END AS far FROM
  (SELECT t.id, t.k, t.pts, CASE WHEN line[1] = t.pts[1] OR line[1] = t.pts[-1] THEN list_reverse(line) ELSE line END AS way FROM tt t JOIN base b USING (id) WHERE len(t.pts) > 1) t WHERE way[-1] = t.pts[1] OR way[-1] = t.pts[-1]),
met AS (SELECT i.id, i.k AS tk, f.k AS fk, way, far, f.pts, far = f.pts[1] OR far = f.pts[-1] AS back FROM into_ i JOIN fr f ON f.id = i.id AND len(f.pts) > 1),
hung AS (SELECT *, row_number() OVER (PARTITION BY id, fk ORDER BY tk) AS nth, CASE WHEN back THEN far ELSE way[1] END AS spot FROM met WHERE back OR way[1] = pts[1] OR way[1] = pts[-1]),
turn_line AS (
  SELECT id, list_concat([CASE WHEN pts[1] = spot AND (pts[-1] <> spot OR nth % 2 = 1) THEN pts[2] ELSE pts[-2] END], CASE WHEN back THEN list_concat([far], list_reverse(way)) ELSE list_append(way, far) END) AS pts FROM hung
  UNION ALL SELECT id, list_concat([way[1]], list_append(way, far)) FROM into_ WHERE id NOT IN (SELECT id FROM fr)),
turn AS (SELECT id, row_number() OVER () AS part, len(pts) AS n, list_min([q.x for q in pts]) AS x0, list_min([q.y for q in pts]) AS y0, list_max([q.x for q in pts]) AS x1, list_max([q.y for q in pts]) AS y1,
  pts[1] = pts[-1] OR pts[1].x >= 2130706432 AND pts[-1].x >= 2130706432 AS closed, pts FROM turn_line)
"""


def _grid_sql() -> str:
    """Every rectangle of the shipped grids with its ordinal, by cross joins of ranges."""
    parts, at = [], 0
    for g in default_tiles():
        parts.append(f"SELECT {at} + i * {g.ny} + j AS raw, {g.x0} + i * {g.dx} AS minlon, {g.y0} + j * {g.dy} AS minlat, {g.x0} + (i + 1) * {g.dx} AS maxlon, {g.y0} + (j + 1) * {g.dy} AS maxlat FROM range({g.nx}) a(i), range({g.ny}) b(j)")
        at += len(g)
    parts.append(f"SELECT {at}, -1800000000, -900000000, 1800000000, 900000000")
    return " UNION ALL ".join(parts)


_TILES = f"""
box AS (SELECT min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM cn),
tl AS (SELECT (row_number() OVER (ORDER BY raw) - 1)::INT AS tile_id, t.* FROM ({_grid_sql()}) t, box
  WHERE x0 IS NULL OR (maxlon >= x0 AND minlon <= x1 AND maxlat >= y0 AND minlat <= y1) OR raw = {sum(map(len, default_tiles()))}),
nn AS (SELECT count(*)::INT AS n FROM tl)
"""

#: Elements of all origins with their envelope (with holes: ox0 to oy1; of the shell alone: x0 to y1), n points in it.
#: Tiles are looked up by 1-degree cells of the point (or first corner), to spare the full comparison.
_PLACED = """
el AS (SELECT 'N' AS type, 'node' AS origin, id, 0 AS part, coalesce(CASE WHEN lat IS NULL OR lon >= 2130706432 THEN 2147483647 ELSE lon END, 2147483647) AS x0,
    coalesce(CASE WHEN lon IS NULL OR lon >= 2130706432 THEN 2147483647 ELSE lat END, 2147483647) AS y0, x0 AS x1, y0 AS y1, x0 AS ox0, y0 AS oy0, x0 AS ox1, y0 AS oy1, 1 AS n, 0 AS n_hole_points, false AS closed FROM cn WHERE id IN (SELECT id FROM sn)
  UNION ALL SELECT 'W', 'way', cw.id, 0, s.x0, s.y0, s.x1, s.y1, s.x0, s.y0, s.x1, s.y1, coalesce(s.n, 0), 0, coalesce(s.closed, false) FROM cw LEFT JOIN shape s ON s.id = cw.id WHERE cw.id IN (SELECT id FROM sw)
  UNION ALL SELECT 'W', 'turn', id, part, x0, y0, x1, y1, x0, y0, x1, y1, n, 0, closed FROM turn
  UNION ALL SELECT 'A', 'area', id, part, x0, y0, x1, y1, ox0, oy0, ox1, oy1, n, n_hole_points, false FROM areas
  UNION ALL SELECT 'C', 'collection', id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 0, false FROM coll),
cell AS (SELECT tile_id, minlon, minlat, maxlon, maxlat, unnest(range(minlon // 10000000 - 1, maxlon // 10000000 + 2)) AS cx FROM tl),
cells AS (SELECT *, unnest(range(minlat // 10000000 - 1, maxlat // 10000000 + 2)) AS cy FROM cell),
hit AS (SELECT el.origin, el.id, el.part, min(tile_id) AS t FROM el JOIN cells c ON el.ox0 // 10000000 = c.cx AND el.oy0 // 10000000 = c.cy
  AND el.ox0 >= c.minlon AND el.ox1 <= c.maxlon AND el.oy0 >= c.minlat AND el.oy1 <= c.maxlat GROUP BY ALL),
placed AS (SELECT el.*, (CASE WHEN el.type <> 'C' AND el.n = 0 THEN 0 ELSE coalesce(hit.t, nn.n) END)::INT AS chunk_id
  FROM el LEFT JOIN hit ON hit.origin = el.origin AND hit.id = el.id AND hit.part = el.part, nn)
"""


def _rules(rules: Rules) -> str:
    spelt, area, odd, listed = [], [], [], []
    for kind, rs in (("N", rules.node), ("W", rules.way), ("C", rules.collection)):
        for i, r in enumerate(rs):
            spelt += [(kind, i, r.key, j, p + r.key, p.rstrip(":")) for j, p in enumerate(rules.prefixes)]
            area.append((kind, i, r.is_area))
            odd += [(i, v) for v in r.exceptions]
            listed += [(kind, i, v, n) for n, v in enumerate(r.values)]
            if kind == "W":
                listed += [("A", i, v, n) for n, v in enumerate(r.area_values)]
    return f"""
spelt AS {_values(spelt, "kind, key_ord, key, prefix_ord, word, prefix")}, area AS {_values(area, "kind, key_ord, is_area")},
odd AS {_values(odd, "key_ord, v")}, listed AS {_values(listed, "type, key_ord, v, value_ord")},
tagged AS (SELECT 'node' AS origin, 'N' AS kind, * FROM nt UNION ALL SELECT 'way', 'W', * FROM wt UNION ALL SELECT 'turn', 'W', * FROM rt
  UNION ALL SELECT 'area', 'W', * FROM rt UNION ALL SELECT 'collection', 'C', * FROM rt),
found AS (SELECT origin, t.kind, id, key_ord, key, min(prefix_ord) AS prefix_ord, arg_min(t.v, prefix_ord) AS v, arg_min(prefix, prefix_ord) AS prefix
  FROM tagged t JOIN spelt s ON s.kind = t.kind AND s.word = t.k GROUP BY origin, t.kind, id, key_ord, key),
fnd AS (SELECT * FROM found f {{one}}),
yes AS (SELECT p.*, coalesce(a.v, '') AS area FROM placed p LEFT JOIN tagged a ON a.origin = p.origin AND a.id = p.id AND a.k = 'area'),
judged AS (SELECT y.*, f.key_ord, f.key, f.v, f.prefix, f.prefix_ord, y.type = 'A' OR y.type = 'W' AND
  y.closed AND (y.area = 'yes' OR y.area <> 'no' AND (r.is_area <> (f.prefix_ord = 0 AND EXISTS (SELECT 1 FROM odd o WHERE o.key_ord = f.key_ord AND o.v = f.v)))) AS is_area
  FROM yes y JOIN fnd f ON f.origin = y.origin AND f.id = y.id JOIN area r ON r.kind = f.kind AND r.key_ord = f.key_ord),
line AS (SELECT origin, id, part FROM judged WHERE type = 'W' GROUP BY ALL HAVING bool_or(NOT is_area)),
feat AS (
  SELECT * REPLACE ('A' AS type) FROM judged WHERE is_area
  UNION ALL SELECT * FROM judged WHERE type = 'W' AND (origin, id, part) IN (SELECT (origin, id, part) FROM line)
  UNION ALL SELECT * FROM judged WHERE type IN ('N', 'C')
  UNION ALL SELECT y.* REPLACE (CASE WHEN closed AND area = 'yes' THEN 'A' ELSE type END AS type), 1000000, '', NULL, NULL, NULL, NULL FROM yes y
    WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.origin = y.origin AND f.id = y.id)),
features AS (SELECT f.*, f.key AS block_key, CASE WHEN l.v IS NULL THEN '' ELSE l.v END AS slice_value, coalesce(l.value_ord, 1073741824) AS value_ord
  FROM feat f LEFT JOIN listed l ON l.type = f.type AND l.key_ord = f.key_ord AND l.v = f.v)
"""


_GEOMETRY = f"{_BASE}, {_LINES}, {_AREAS}, {_TURNS}"
_EVERY = f"WITH RECURSIVE {_GEOMETRY}, {_TILES}, {_PLACED} "
_FULL = f"{_EVERY}, {_rules(default_rules()).replace('{one}', '')} "
_ONE = f"{_EVERY}, {_rules(default_rules()).replace('{one}', 'WHERE key_ord = (SELECT min(key_ord) FROM found g WHERE g.origin = f.origin AND g.id = f.id)')} "
_B = f"WITH {_BASE} "

_META = "id, coalesce(version, 0) AS version, 0::BIGINT AS timestamp, 0::BIGINT AS changeset, coalesce(uid, 0) AS uid, coalesce(\"user\", '') AS \"user\""

#: Closed rings of zones as edges.
_EDGES = """
z AS (SELECT zone_id, list_concat(ring, ring[1:1]) AS ring FROM zones WHERE len(ring) > 0),
edges AS (SELECT zone_id, unnest(ring[1:len(ring) - 1]) AS a, unnest(ring[2:len(ring)]) AS b FROM z)
"""

_SEGMENTS = """
o AS (SELECT DISTINCT o_custkey AS owner, o_orderkey AS o FROM orders),
k AS (SELECT owner, o, row_number() OVER (PARTITION BY owner ORDER BY o) - 1 AS k, count(*) OVER (PARTITION BY owner) AS n FROM o)
"""

_PLAIN_TAGS = f"coalesce((SELECT count(*) FROM (SELECT unnest(map_keys(tags)) AS k) WHERE k NOT IN ({_DISCARD})), 0)::INT"

_SUMMARY = f"""
SELECT 'n' AS kind, id, coalesce(version, 0) AS version, coalesce(timestamp, 0) AS timestamp, coalesce(uid, 0) AS uid, {_PLAIN_TAGS} AS n_tags,
  lon::BIGINT * 31 + lat AS place FROM {live("nodes")} WHERE lon IS NOT NULL AND lat IS NOT NULL
UNION ALL SELECT 'w', id, coalesce(version, 0), coalesce(timestamp, 0), coalesce(uid, 0), {_PLAIN_TAGS},
  coalesce(list_sum(list_transform(list_filter(nds, lambda x: x IS NOT NULL), lambda x, i: x * i)), 0)::BIGINT FROM {live("ways")}
UNION ALL SELECT 'r', id, coalesce(version, 0), coalesce(timestamp, 0), coalesce(uid, 0), {_PLAIN_TAGS},
  coalesce(list_sum(list_transform(list_filter(members, lambda m: m.ref IS NOT NULL AND coalesce(m.type, '') IN ('node', 'way', 'relation')),
    lambda m, i: i * (m.ref + length(coalesce(m.role, ''))))), 0)::BIGINT FROM {live("relations")}
"""

SQL: dict[str, str] = {
    "bbox": f"SELECT min(lon) AS minlon, min(lat) AS minlat, max(lon) AS maxlon, max(lat) AS maxlat FROM {live('nodes')}",
    "clean_tags": " UNION ALL ".join(f"SELECT id, k AS tag_key, v AS tag_value, '{k}' AS kind FROM {tag_rows(t)}" for k, t in _ALL),
    "discarded_tags": " UNION ALL ".join(
        f"SELECT coalesce((SELECT count(*) FROM {tag_rows(t, True)} WHERE k IN ({_DISCARD})), 0) AS n_discarded, (SELECT count(*) FROM {live(t)}) AS n_elements, '{k}' AS kind" for k, t in _ALL
    ),
    "project_meta": _each(f"SELECT {_META}, '{{kind}}' AS kind FROM {{table}}"),
    "resolve_ways": _B + "SELECT cw.id, coalesce(n, 0)::INT AS n_points, coalesce(m, 0)::INT AS n_missing, coalesce(c, 0)::BIGINT AS checksum FROM cw LEFT JOIN "
    "(SELECT id, count(*) AS n, count(*) FILTER (WHERE lon = 2147483647) AS m, sum(place * (lon::BIGINT + 31 * lat::BIGINT)) AS c FROM pts GROUP BY id) s ON s.id = cw.id",
    "closed_ways": _B + "SELECT id, (n - 1)::INT AS n_vertices FROM shape WHERE closed",
    "significant_nodes": _B + "SELECT id FROM sn",
    "significant_ways": _B + "SELECT id FROM sw",
    "membership": _B + "SELECT type AS kind, ref, (row_number() OVER (PARTITION BY type, ref ORDER BY id, nr) - 1)::INT AS place, id AS relation_id, role, nr::INT AS nr FROM rest",
    "relation_kinds": _B + "SELECT cr.id, CASE WHEN t.v IN ('multipolygon', 'boundary') THEN 'area' WHEN t.v IN ('restriction', 'destination_sign') THEN 'turn' ELSE '' END AS kind, "
    "(SELECT count(*) FROM sorted s WHERE s.id = cr.id AND used)::INT AS n_used, (SELECT count(*) FROM sorted s WHERE s.id = cr.id AND NOT used)::INT AS n_rest "
    "FROM cr LEFT JOIN rt t ON t.id = cr.id AND t.k = 'type'",
    "counters": _B + "SELECT 'nodes' AS counter, count(*) AS n FROM cn UNION ALL SELECT 'ways', count(*) FROM cw UNION ALL SELECT 'relations', count(*) FROM cr "
    "UNION ALL SELECT 'area_relations', count(*) FROM rt WHERE k = 'type' AND v IN ('multipolygon', 'boundary') "
    "UNION ALL SELECT 'turn_relations', count(*) FROM rt WHERE k = 'type' AND v IN ('restriction', 'destination_sign') UNION ALL SELECT 'collections', count(*) FROM coll "
    "UNION ALL SELECT 'missing_nodes', count(*) FROM refs WHERE ref NOT IN (SELECT id FROM pos) UNION ALL SELECT 'missing_ways', count(*) FROM sorted WHERE used AND type = 'way' AND ref NOT IN (SELECT id FROM cw) "
    f"UNION ALL SELECT 'discarded_tags', count(*) FROM ({' UNION ALL '.join(f'SELECT k FROM {tag_rows(t, True)}' for _, t in _ALL)}) WHERE k IN ({_DISCARD})",
    "tiles": f"WITH cn AS {live('nodes')}, {_TILES} SELECT tile_id, minlon::INT AS minlon, minlat::INT AS minlat, maxlon::INT AS maxlon, maxlat::INT AS maxlat FROM tl",
    "tile_elements": _EVERY + "SELECT type, id, chunk_id FROM placed",
    "chunk_index": _EVERY + "SELECT type, chunk_id, count(*) AS n FROM placed GROUP BY ALL",
    "classify_nodes": _FULL + "SELECT f.id, block_key, slice_value, coalesce(l.prefix, t.v, '') AS lifecycle FROM features f "
    "LEFT JOIN (SELECT id, arg_max(prefix, key_ord) AS prefix FROM found WHERE origin = 'node' AND prefix_ord > 0 GROUP BY id) l ON l.id = f.id "
    "LEFT JOIN nt t ON t.id = f.id AND t.k = 'lifecycle' WHERE f.type = 'N'",
    "classify_ways": _FULL + "SELECT type, id, block_key, slice_value FROM features WHERE origin = 'way'",
    "classify_collections": _FULL + "SELECT id, block_key, slice_value FROM features WHERE type = 'C'",
    "one_element": _ONE + "SELECT type, id, block_key, slice_value FROM features",
    "slice_counts": _FULL + "SELECT type, chunk_id, block_key, slice_value, count(*) AS n FROM features GROUP BY ALL",
    "block_stats": _FULL + "SELECT type, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT (chunk_id, block_key)) AS n_blocks, count(DISTINCT (chunk_id, block_key, slice_value)) AS n_slices, count(*) AS n_rows FROM features GROUP BY type",
    "cluster_order": _FULL + "SELECT type, chunk_id, id, block_key, rank() OVER (PARTITION BY type, chunk_id ORDER BY key_ord, value_ord, id)::INT AS place FROM (SELECT * REPLACE (CASE WHEN key_ord = 1000000 THEN 1073741824 ELSE key_ord END AS key_ord) FROM features)",
    "union_elements": f"WITH RECURSIVE {_GEOMETRY}, lk AS (SELECT type, ref, count(*) AS n FROM rest GROUP BY ALL), "
    "un AS (SELECT 'N' AS type, 'node' AS origin, 'node' AS kind, id FROM sn UNION ALL SELECT 'W', 'way', 'way', id FROM sw UNION ALL SELECT 'W', 'turn', 'relation', id FROM turn "
    "UNION ALL SELECT 'A', 'area', 'relation', id FROM areas UNION ALL SELECT 'C', 'collection', 'relation', id FROM coll) "
    "SELECT un.type, origin, count(*) AS n, sum(id)::BIGINT AS id_sum, coalesce(sum(lk.n), 0)::BIGINT AS n_links FROM un LEFT JOIN lk ON lk.type = un.kind AND lk.ref = un.id GROUP BY un.type, origin",
    "features": _FULL + "SELECT type, origin, block_key, count(*) AS n, sum(n + n_hole_points - (type = 'A' AND origin <> 'area')::INT)::BIGINT AS n_points FROM features GROUP BY ALL",
    "relation_areas": f"WITH RECURSIVE {_GEOMETRY} SELECT id, n::INT AS n_points, n_holes::INT AS n_holes, n_hole_points::INT AS n_hole_points FROM areas",
    "turns": f"WITH RECURSIVE {_GEOMETRY} SELECT id, n::INT AS n_points, " + ", ".join(f"CASE WHEN pts[{i}].x >= 2130706432 THEN 2147483647 ELSE pts[{i}].{v} END::INT AS {n}_{c}" for i, n in ((1, "from"), (-1, "to")) for v, c in (("x", "lon"), ("y", "lat"))) + " FROM turn",
    "point_in_ring": f"WITH {_EDGES}, p AS (SELECT zone_id AS point_of, i, v.lon::BIGINT AS x, v.lat::BIGINT AS y FROM (SELECT zone_id, unnest(ring[1:len(ring) - 1]) AS v, generate_subscripts(ring[1:len(ring) - 1], 1) AS i FROM z)) "
    "SELECT zone_id, point_of, count(*) AS n_vertices FROM (SELECT zone_id, point_of, i FROM p JOIN edges ON point_of <> zone_id WHERE a.lat <> b.lat AND (a.lat <= y) = (y < b.lat) "
    "AND a.lon + ((b.lon - a.lon)::BIGINT * (y - a.lat)) // (b.lat - a.lat) < x GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY ALL",
    "orient_areas": _B + ", wrap AS (SELECT p.id, ((b.lon::BIGINT - a.lon + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS dx, "
    "((b.lat::BIGINT + a.lat + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS sy, b.lon::BIGINT - a.lon AS ex, b.lat::BIGINT + a.lat AS ey "
    "FROM (SELECT id, place, n FROM pts JOIN shape USING (id) WHERE closed AND place < n) p JOIN pts a ON a.id = p.id AND a.place = p.place "
    "JOIN pts b ON b.id = p.id AND b.place = CASE WHEN p.place = p.n - 1 THEN 1 ELSE p.place + 1 END) "
    "SELECT id, sum(((dx * sy + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) >= 0 AS clockwise, sum(ex * ey) >= 0 AS clockwise_exact FROM wrap GROUP BY id",
    "ring_assembly": f"WITH {_SEGMENTS} SELECT owner, 1 AS n_rings, (2 * count(*) - 1)::INT AS n_vertices FROM k GROUP BY owner",
    "from_to": f"WITH {_SEGMENTS} SELECT owner, k::INT AS place, (100000000 + o * 1000)::INT AS lon, (480000000 + (o * 7919 % 100003) * 100)::INT AS lat FROM k WHERE n >= 3 AND k < 3",
    "turn_cases": f"WITH {_SEGMENTS}, c AS {_values([(kind, least, place, at) for kind, least, points in (('node', 3, (0, 1, 2)), ('ways', 6, (0, 1, 2, 3, 4)), ('no from', 3, (1, 1, 2)), ('far', 4, (3, 2, 1))) for place, at in enumerate(points)], 'kind, least, place, at_k')} "
    "SELECT kind, owner, place::INT AS place, (100000000 + o * 1000)::INT AS lon, (480000000 + (o * 7919 % 100003) * 100)::INT AS lat FROM k JOIN c ON k = at_k AND n >= least",
    "nested_rings": "SELECT owner, (100000000 + owner * 1000 - 50 * (n - i))::INT AS west, 5 AS n_points, (i + 1 < n)::INT AS n_holes, "
    "CASE WHEN i + 1 < n THEN 100000000 + owner * 1000 - 50 * (n - i - 1) ELSE 0 END::INT AS hole_west FROM (SELECT c_custkey AS owner, 1 + c_custkey % 6 AS n, unnest(range(0, 1 + c_custkey % 6, 2)) AS i FROM customer)",
    "lifecycle": _FULL + ", moved AS (SELECT * FROM found WHERE origin = 'node' AND prefix_ord > 0 AND id IN (SELECT id FROM sn)), "
    "last AS (SELECT id, arg_max(prefix, key_ord) AS prefix FROM moved GROUP BY id) "
    "SELECT id, k AS tag_key, v AS tag_value FROM nt t WHERE id IN (SELECT id FROM moved) AND k <> 'lifecycle' AND NOT EXISTS (SELECT 1 FROM moved m WHERE m.id = t.id AND t.k = m.prefix || ':' || m.key) "
    "UNION ALL SELECT id, key, v FROM moved UNION ALL SELECT id, 'lifecycle', prefix FROM last",
    "read_pruned": _FULL + "SELECT type, id, block_key, slice_value FROM features f WHERE (type = 'A' AND block_key = 'building' OR type = 'W' AND block_key = 'highway' AND slice_value = 'track') "
    "AND x1 >= 50000000 AND x0 <= 300000000 AND y1 >= 400000000 AND y0 <= 500000000",
    "read_xml_files": _SUMMARY,
    "read_pbf": _SUMMARY,
    # that format has no author without a time, and no time without a version
    "read_o5m": f"SELECT kind, id, version, CASE WHEN version = 0 THEN 0 ELSE timestamp END AS timestamp, CASE WHEN version = 0 OR timestamp = 0 THEN 0 ELSE uid END AS uid, n_tags, place FROM ({_SUMMARY})",
    "p4_found": f"""WITH n AS (SELECT id, lon, lat, radians(lon / 1e7) AS lo, radians(lat / 1e7) AS la FROM {LOCATED}), {_EDGES},
bb AS (SELECT zone_id, min(a.lon) AS x0, max(a.lon) AS x1, min(a.lat) AS y0, max(a.lat) AS y1 FROM edges GROUP BY zone_id),
c AS (SELECT zone_id, id, n.lon, n.lat FROM n JOIN bb ON n.lon BETWEEN x0 AND x1 AND n.lat BETWEEN y0 AND y1),
nb AS (SELECT *, lat // 500 + unnest([-1, 0, 1]) AS band FROM n)
SELECT 'near' AS rel, a.id AS key_a, b.id AS key_b FROM n a JOIN nb b ON a.lat // 500 = b.band AND a.id < b.id AND abs(a.lat - b.lat) <= 450
WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin((a.la - b.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((a.lo - b.lo) / 2), 2)))) <= 5
UNION ALL SELECT 'zone', zone_id, id FROM (SELECT c.zone_id, c.id FROM c JOIN edges e ON e.zone_id = c.zone_id AND (e.a.lat > c.lat) <> (e.b.lat > c.lat)
AND CASE WHEN e.b.lat > e.a.lat THEN (c.lon - e.a.lon)::BIGINT * (e.b.lat - e.a.lat) < (c.lat - e.a.lat)::BIGINT * (e.b.lon - e.a.lon)
  ELSE (c.lon - e.a.lon)::BIGINT * (e.b.lat - e.a.lat) > (c.lat - e.a.lat)::BIGINT * (e.b.lon - e.a.lon) END GROUP BY ALL HAVING count(*) % 2 = 1)""",
}

_JSON = """
u AS (SELECT row_number() OVER () AS r, upload_id, payload::JSON AS doc FROM (SELECT DISTINCT upload_id, payload FROM uploads) WHERE payload IS NOT NULL AND json_valid(payload)),
j AS (SELECT u.r, u.upload_id, t.id, t.parent, t.key, t.type, t.value, t.path FROM u, json_tree(u.doc) t),
named AS (SELECT * FROM j WHERE key IN ('node', 'way', 'relation') AND type IN ('OBJECT', 'ARRAY')),
obj AS (SELECT r, upload_id, id, key AS elem_type, value, path FROM named WHERE type = 'OBJECT'
  UNION ALL SELECT j.r, j.upload_id, j.id, a.key, j.value, j.path FROM named a JOIN j ON j.r = a.r AND j.parent = a.id AND a.type = 'ARRAY' AND j.type = 'OBJECT'),
e AS (SELECT *, try_cast(coalesce(value->>'id', value->>'@id') AS BIGINT) AS elem_id,
  coalesce(list_filter(string_split(regexp_replace(path, '\\[[0-9]+\\]', '', 'g'), '.'), lambda s: s IN ('create', 'modify', 'delete'))[-1], '') AS action FROM obj),
box AS (SELECT e.r, e.upload_id, e.elem_type, e.elem_id, CASE WHEN j.key = 'tags' THEN 'tag' ELSE j.key END AS child, j.id, j.type, j.value
  FROM e JOIN j ON j.r = e.r AND j.parent = e.id AND j.key IN ('tag', 'tags', 'nd', 'member')),
kid AS (SELECT upload_id, elem_type, elem_id, child, 0 AS pos, value FROM box WHERE type = 'OBJECT'
  UNION ALL SELECT b.upload_id, b.elem_type, b.elem_id, b.child, j.key::INT, j.value FROM box b JOIN j ON j.r = b.r AND j.parent = b.id AND b.type = 'ARRAY' AND j.type = 'OBJECT'),
tagkey AS (SELECT *, coalesce(value->>'k', value->>'@k') AS k FROM kid WHERE child = 'tag')
"""
SQL["p3_found"] = f"""WITH {_JSON} SELECT DISTINCT upload_id, elem_type, elem_id, child, -1 AS pos, k AS child_key FROM tagkey WHERE k IS NOT NULL
UNION SELECT upload_id, elem_type, elem_id, child, -1, unnest(json_keys(value)) FROM tagkey WHERE k IS NULL
UNION SELECT upload_id, elem_type, elem_id, child, pos, coalesce(value->>'ref', value->>'@ref')::BIGINT::VARCHAR FROM kid WHERE child = 'nd'
UNION SELECT upload_id, elem_type, elem_id, child, pos, coalesce(value->>'type', value->>'@type') || '/' || coalesce(value->>'ref', value->>'@ref')::BIGINT FROM kid WHERE child = 'member'"""
_EITHER = lambda k: f"coalesce(value->>'{k}', value->>'@{k}') AS {k}"
SQL["p3_elements"] = f"""WITH {_JSON} SELECT DISTINCT upload_id, elem_type, elem_id, {', '.join(_EITHER(k) for k in ('id', 'version', 'timestamp', 'changeset', 'lat', 'lon'))}, action FROM e"""
SQL["p3_members"] = f"""WITH {_JSON} SELECT DISTINCT upload_id, elem_type, elem_id, pos, {', '.join(_EITHER(k) for k in ('type', 'ref', 'role'))} FROM kid WHERE child = 'member'"""

SQL["p3_meta"] = f"""WITH {_JSON} SELECT DISTINCT upload_id, elem_type, elem_id, uid, name FROM
(SELECT upload_id, elem_type, elem_id, value->'meta'->'user'->>'uid' AS uid, value->'meta'->'user'->>'name' AS name FROM e) WHERE uid IS NOT NULL OR name IS NOT NULL"""
_HINTS = """, hint AS (SELECT e.r, e.upload_id, e.elem_type, e.elem_id, i.id, i.key::INT AS pos, i.value FROM e JOIN j m ON m.r = e.r AND m.parent = e.id AND m.key = 'meta'
JOIN j h ON h.r = m.r AND h.parent = m.id AND h.key = 'hints' AND h.type = 'ARRAY' JOIN j i ON i.r = h.r AND i.parent = h.id)"""
SQL["p3_hints"] = f"""WITH {_JSON}{_HINTS} SELECT DISTINCT upload_id, elem_type, elem_id, pos, value->>'src' AS src FROM hint"""
SQL["p3_hint_values"] = f"""WITH {_JSON}{_HINTS} SELECT DISTINCT t.upload_id, elem_type, elem_id, t.pos AS hint_pos, v.key::INT AS pos, v.value->>'$' AS value FROM hint t
JOIN j a ON a.r = t.r AND a.parent = t.id AND a.key = 'acc' AND a.type = 'ARRAY' JOIN j v ON v.r = a.r AND v.parent = a.id"""
SQL["p3_uploads"] = f"""WITH {_JSON} SELECT u.upload_id, doc->>'generator' AS generator, doc->'changeset'->>'id' AS changeset_id, doc->'changeset'->>'comment' AS changeset_comment,
{', '.join(f"count(*) FILTER (WHERE action = '{a}') AS n_{a or 'listed'}" for a in ('create', 'modify', 'delete', ''))} FROM u LEFT JOIN e ON e.r = u.r GROUP BY u.r, u.upload_id, doc"""
_TAGGED = "(" + _each("SELECT '{kind}' AS kind, id, tags FROM {table} WHERE cardinality(tags) > 0") + ")"
_KEYS = f"(SELECT kind, id, unnest(map_keys(tags)) AS tag_key FROM {_TAGGED})"
_TILED = f"(SELECT n.id, n.lon, n.lat, min(tile_id) AS tile_id FROM {LOCATED} n LEFT JOIN tiles t ON n.lon BETWEEN t.minlon AND t.maxlon AND n.lat BETWEEN t.minlat AND t.maxlat GROUP BY ALL)"

SQL |= {
    "p5_found": f"SELECT 'tag_key' AS dim, tag_key AS hot_key FROM {_KEYS} GROUP BY tag_key HAVING count(*) * 20 >= (SELECT count(*) FROM {_TAGGED}) "
    f"UNION ALL SELECT 'tile', tile_id::VARCHAR FROM {_TILED} WHERE tile_id IS NOT NULL GROUP BY tile_id HAVING count(*) * 20 >= (SELECT count(*) FROM {LOCATED})",
    "p5_tag_keys": "SELECT tag_key, count(*) AS n_elements, count(*) FILTER (WHERE kind = 'n') AS n_n, count(*) FILTER (WHERE kind = 'w') AS n_w, count(*) FILTER (WHERE kind = 'r') AS n_r, "
    f"min(id) AS min_id, max(id) AS max_id FROM {_KEYS} GROUP BY tag_key",
    "p5_tiles": f"SELECT tile_id, count(*) AS n_nodes, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM {_TILED} GROUP BY tile_id",
}

_KIND = (("node", "nodes"), ("way", "ways"), ("relation", "relations"))
_TARGETS = " UNION ALL ".join(
    f"SELECT '{k}' AS ref_type, c.id AS ref_id, coalesce(c.visible, false) AS live, f.first_loaded FROM {_current(t)} c JOIN (SELECT id, min(loaded_at) AS first_loaded FROM {t} GROUP BY id) f ON f.id = c.id" for k, t in _KIND
)
_ORPHANS = f"""
targets AS ({_TARGETS}),
refs AS (SELECT DISTINCT 'ways' AS src_table, id AS src_id, loaded_at, 'node' AS ref_type, ref AS ref_id FROM (SELECT id, loaded_at, unnest(nds) AS ref FROM {live("ways")}) WHERE ref IS NOT NULL
  UNION ALL SELECT DISTINCT 'relations', id, loaded_at, m.type, m.ref FROM (SELECT id, loaded_at, unnest(members) AS m FROM {live("relations")}) WHERE m.ref IS NOT NULL AND m.type IN ('node', 'way', 'relation')),
direct AS (SELECT * FROM (SELECT r.*, CASE WHEN t.live IS NULL THEN 'missing' WHEN NOT t.live THEN 'deleted' WHEN t.first_loaded > r.loaded_at THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN targets t USING (ref_type, ref_id)) WHERE ref_state IS NOT NULL)
"""
_MONTH = "strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m')"
SQL["p6_found"] = f"WITH {_ORPHANS} SELECT src_table, {_MONTH} AS month_key, src_id, ref_type, ref_id, ref_state FROM direct"
SQL["p6_report"] = f"""WITH RECURSIVE {_ORPHANS},
bad(ref_type, ref_id) AS (SELECT CASE WHEN src_table = 'ways' THEN 'way' ELSE 'relation' END, src_id FROM direct
  UNION SELECT 'relation', r.src_id FROM refs r JOIN bad b ON r.ref_type = b.ref_type AND r.ref_id = b.ref_id WHERE NOT EXISTS
    (SELECT 1 FROM direct d WHERE d.src_table = r.src_table AND d.src_id = r.src_id AND d.ref_type = r.ref_type AND d.ref_id = r.ref_id)),
al AS (SELECT src_table, src_id, loaded_at, 'direct' AS orphan, ref_state FROM direct
  UNION ALL SELECT r.src_table, r.src_id, r.loaded_at, 'inherited', 'inherited' FROM refs r JOIN bad b ON r.ref_type = b.ref_type AND r.ref_id = b.ref_id WHERE r.src_table = 'relations' AND NOT EXISTS
    (SELECT 1 FROM direct d WHERE d.src_table = r.src_table AND d.src_id = r.src_id AND d.ref_type = r.ref_type AND d.ref_id = r.ref_id))
SELECT src_table, {_MONTH} AS month_key, orphan, ref_state, count(*) AS n_refs, count(DISTINCT src_id) AS n_rows FROM al GROUP BY ALL"""

_LINKS = f"""
lv AS (SELECT id, members FROM {live("relations")}),
links AS (SELECT DISTINCT id AS p, m.ref AS c FROM (SELECT id, unnest(members) AS m FROM lv) WHERE m.type = 'relation' AND m.ref IN (SELECT id FROM lv)),
reach(a, b) AS (SELECT p, c FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON r.b = l.p),
cyc AS (SELECT a AS id FROM reach WHERE a = b),
walk(root, id, depth, path) AS (SELECT DISTINCT p, p, 0, p::VARCHAR FROM links WHERE p NOT IN (SELECT c FROM links)
  UNION ALL SELECT w.root, l.c, w.depth + 1, w.path || '>' || l.c FROM walk w JOIN links l ON l.p = w.id WHERE l.c NOT IN (SELECT id FROM cyc))
"""
SQL["p7_found"] = f"""WITH RECURSIVE {_LINKS} SELECT 'path' AS kind, root AS root_id, id AS relation_id, depth AS tree_depth, path AS id_path FROM walk
UNION ALL SELECT 'cycle', min(r.b), r.a, -1, '' FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY r.a"""
SQL["p7_descendants"] = f"""WITH RECURSIVE {_LINKS}, parts AS (SELECT id, depth, unnest(string_split(path, '>'))::BIGINT AS anc, generate_subscripts(string_split(path, '>'), 1) - 1 AS pos FROM walk),
pairs AS (SELECT anc, id, max(depth - pos) AS below FROM parts GROUP BY ALL)
SELECT anc AS ancestor_id, count(*) - 1 AS n_descendants, max(below)::INT AS height FROM pairs GROUP BY anc"""
