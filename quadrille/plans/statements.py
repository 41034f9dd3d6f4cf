"""One DuckDB statement per map query."""

from __future__ import annotations

from quadrille.plans.oracle import LEAF, SHIFT, hilbert, q, signed
from quadrille.sources.manifest import STAR

TILES = """,
tiles AS (SELECT osm_id, (osm_id % 15)::INT AS z, x >> (32 - (osm_id % 15)::INT) AS x, y >> (32 - (osm_id % 15)::INT) AS y,
  (hu // (1::HUGEINT << (2 * (32 - (osm_id % 15)::INT))))::BIGINT AS h FROM nodes)"""


def tile_h(name: str, source: str, keys: str) -> str:
    """Table ``name``: the rows of ``source`` (z, x, y, ...) with h spot zoom z."""
    return f""",
{name}_p AS (SELECT row_number() OVER () AS rid, * FROM {source}),
{name}_g AS (SELECT rid, x << (32 - z) AS x, y << (32 - z) AS y FROM {name}_p WHERE x IS NOT NULL AND y IS NOT NULL),
{hilbert(name + "_w", name + "_g", "rid")},
{name} AS (SELECT {keys}, (hu // (1::HUGEINT << (2 * (32 - z))))::BIGINT AS h FROM {name}_p LEFT JOIN {name}_w USING (rid))"""


def project(z: str, tile: str, loc: str) -> str:
    return f"trunc(least(greatest({loc} / 4294967296.0::DOUBLE * (pow(2.0::DOUBLE, {z}) * 8192.0::DOUBLE) - {tile} * 8192.0::DOUBLE, -16384.0::DOUBLE), 16383.0::DOUBLE))::INT"


CORNERS = "(VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS c(place, a, b)"
GRAND = "(VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS c(p, a, b), (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0)) AS g(r, c, d)"
SMALL = TILES + ", small AS (SELECT DISTINCT z, x, y, h FROM tiles)"


def pyramid(roots: str, levels: int) -> str:
    out = f""",
roots AS ({roots}),
level0 AS (SELECT z AS root_z, x AS root_x, y AS root_y, z, x, y FROM roots)"""
    names = ["level0"]
    for k in range(1, levels + 1):
        limit = "" if k == 1 else "WHERE z < 14"
        out += f""",
level{k} AS (SELECT root_z, root_x, root_y, z + 2 AS z, x * 4 + 2 * a + c AS x, y * 4 + 2 * b + d AS y
  FROM (SELECT * FROM level{k - 1} {limit}), {GRAND})"""
        names.append(f"level{k}")
    union = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return out + f""",
pyramid AS (
  SELECT z AS root_z, x AS root_x, y AS root_y, a.range::INT AS z, x >> (z - a.range)::INT AS x, y >> (z - a.range)::INT AS y FROM roots, range(0, 32, 2) AS a WHERE a.range < z
  UNION ALL {union})"""


def bearing(source: str) -> str:
    """Table bearings: ``source`` (b, z, x, y, h) with the sides the curve passes."""
    sides = {"n": "y <> 0, x, y - 1", "w": "x <> 0, x - 1, y", "s": "y + 1 < (1::BIGINT << z), x, y + 1", "e": "x + 1 < (1::BIGINT << z), x + 1, y"}
    out = ""
    for k, (side, spec) in enumerate(sides.items()):
        there, px, py = (s.strip() for s in spec.split(", "))
        out += f", side_{side} AS (SELECT b, z, CASE WHEN {there} THEN {px} END AS x, CASE WHEN {there} THEN {py} END AS y FROM {source})"
        out += tile_h(f"near_{side}", f"side_{side}", "b")
    case = []
    for into, exits, otherwise in (("n", "wse", None), ("w", "sen", "WE"), ("s", "enw", "SN"), ("e", "nws", None)):
        ways = " ".join(f"WHEN {k} IS NOT DISTINCT FROM h + 1 THEN '{into.upper()}{k.upper()}'" for k in exits)
        case.append(f"WHEN {into} IS NOT DISTINCT FROM before THEN CASE {ways} ELSE {repr(otherwise) if otherwise else 'NULL'} END")
    return out + f""",
bearings AS (SELECT b, CASE {" ".join(case)} END AS bearing FROM (
  SELECT t.b, t.h, CASE WHEN t.h <> 0 THEN t.h - 1 END AS before, n.h AS n, w.h AS w, s.h AS s, e.h AS e
  FROM {source} t JOIN near_n n USING (b) JOIN near_w w USING (b) JOIN near_s s USING (b) JOIN near_e e USING (b)))"""


LON = "((x / 4294967295.0::DOUBLE - 0.5::DOUBLE) * 360.0::DOUBLE)"
LAT = "((2.0::DOUBLE * atan(exp((1.0::DOUBLE - 2.0::DOUBLE * (y / 4294967295.0::DOUBLE)) * pi())) - pi() / 2.0::DOUBLE) * (180.0::DOUBLE / pi()))"
NODE_STRINGS = """,
node_strings AS (
  SELECT CASE kind WHEN 'node' THEN 0 WHEN 'way' THEN 1 ELSE 2 END * 17592186044416 + osm_id * 16 + pos * 2 AS spot, k, v FROM tags),
first_strings AS (
  SELECT s, min(spot) AS first_pos FROM (SELECT spot, k AS s FROM node_strings UNION ALL SELECT spot + 1, v FROM node_strings) GROUP BY s)"""
PROPS = """,
props AS (
  SELECT kind, osm_id, -2 AS p, 'rule' AS k, rule AS v FROM rendered
  UNION ALL SELECT kind, osm_id, -1, 'osm_id', osm_id::VARCHAR FROM rendered WHERE include = 'All'
  UNION ALL SELECT r.kind, r.osm_id, t.pos, t.k, t.v FROM rendered r JOIN tags t ON t.kind = r.kind AND t.osm_id = r.osm_id
  WHERE include = 'All' OR (include = 'Keys' AND list_contains(string_split(include_keys, ','), t.k)))"""
PATHS = """,
paths AS (SELECT osm_id, pos, (x >> 16)::BIGINT AS px, (y >> 16)::BIGINT AS py FROM way_points WHERE h IS NOT NULL),
types AS (SELECT osm_id, CASE WHEN count(*) < 2 THEN 1 WHEN arg_min(px, pos) = arg_max(px, pos) AND arg_min(py, pos) = arg_max(py, pos) THEN 3 ELSE 2 END AS type
  FROM paths GROUP BY osm_id)"""
GEOMETRY = f""",
relation_walk AS (
  SELECT osm_id, CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h::HUGEINT END AS hu, 0 AS k, 0::BIGINT AS x, 0::BIGINT AS y FROM relation_h WHERE h IS NOT NULL
  UNION ALL
  SELECT osm_id, hu // 4, k + 1,
    CASE WHEN d = 0 THEN y WHEN d = 3 THEN 2 * s - 1 - y WHEN d = 1 THEN x ELSE x + s END,
    CASE WHEN d = 0 THEN x WHEN d = 3 THEN s - 1 - x ELSE y + s END
  FROM (SELECT *, (hu % 4)::INT AS d, 1::BIGINT << k AS s FROM relation_walk WHERE k < 32)),
feature_points AS (
  SELECT 'way' AS kind, osm_id, pos, x, y FROM way_points WHERE h IS NOT NULL
  UNION ALL SELECT 'node', osm_id, 0, x, y FROM nodes WHERE osm_id IN (SELECT osm_id FROM tags WHERE kind = 'node')
  UNION ALL SELECT 'relation', osm_id, 0, x, y FROM relation_walk WHERE k = 32),
leaf_walk AS (
  SELECT DISTINCT tile_h, tile_h AS t, 0 AS k, 0::BIGINT AS x, 0::BIGINT AS y FROM at_leaf
  UNION ALL
  SELECT tile_h, t // 4, k + 1,
    CASE WHEN d = 0 THEN y WHEN d = 3 THEN 2 * s - 1 - y WHEN d = 1 THEN x ELSE x + s END,
    CASE WHEN d = 0 THEN x WHEN d = 3 THEN s - 1 - x ELSE y + s END
  FROM (SELECT *, (t % 4)::INT AS d, 1::BIGINT << k AS s FROM leaf_walk WHERE k < {LEAF})),
leaf_points AS (
  SELECT a.tile_h, a.kind, a.osm_id, p.pos, {project(str(LEAF), "l.x", "p.x")} AS tx, {project(str(LEAF), "l.y", "p.y")} AS ty
  FROM at_leaf a JOIN feature_points p USING (kind, osm_id) JOIN leaf_walk l ON l.tile_h = a.tile_h AND l.k = {LEAF})"""
RULE_STRINGS = ", ".join(f"('{s}')" for s in sorted({x for r in STAR.rules.values() for x in (*r.keys, *r.values, *(y for t in r.tags for y in t))}))
WARN = [("layer", n) for n in sorted(set(STAR.layers) - set(STAR.layer_order))] + sorted({("rule", r) for ns in STAR.layers.values() for r in ns if r not in STAR.rules})
FANOUT = "SELECT z::INT AS z, tile_h, layer_pos, layer, count(*) AS n FROM content JOIN rendered USING (kind, osm_id) JOIN layer_rules USING (rule) GROUP BY ALL"

SQL = {
    "leaf_counts": q(f"SELECT (hu // {SHIFT})::BIGINT AS tile_h, count(*) AS n FROM nodes GROUP BY 1"),
    "lonlat_to_mercator_xy": q("SELECT osm_id, lon, lat, x, y FROM node_grid"),
    "xy_to_lonlat": q(f"SELECT osm_id, trunc({LON} * 1e7)::BIGINT AS lon, trunc({LAT} * 1e7)::BIGINT AS lat FROM node_grid"),
    "hilbert_encode": q("SELECT osm_id, x, y, h FROM nodes"),
    "hilbert_decode": q("SELECT osm_id, h, x, y FROM nodes"),
    "zoom_prefix": q("SELECT osm_id, " + ", ".join(f"(hu // {1 << (2 * (32 - z))}::HUGEINT)::BIGINT AS z{z}" for z in (0, 2, 4, 8, 12, 16)) + " FROM nodes"),
    "tile_at_zoom": q(TILES + " SELECT osm_id, z, h, greatest(z - 3, 0) AS up_z, h >> (2 * (z - greatest(z - 3, 0))) AS up_h, z + 2 AS down_z, h * 16 AS down_h, h * 16 AS h_from, h * 16 + 16 AS h_to FROM tiles"),
    "tile_bbox_center": q(TILES + """, e AS (SELECT *, 4294967295 >> z AS extent, x << (32 - z) AS nw_x, y << (32 - z) AS nw_y FROM tiles)
      SELECT osm_id, z, extent, nw_x, nw_y, nw_x + extent AS se_x, nw_y + extent AS se_y, nw_x + extent // 2 AS center_x, nw_y + extent // 2 AS center_y,
      x / pow(2.0::DOUBLE, z) AS float_x, y / pow(2.0::DOUBLE, z) AS float_y, 1::BIGINT << z AS axis_tiles, 1::BIGINT << (2 * z) AS all_tiles FROM e"""),
    "tile_children": q(SMALL + f", kids AS (SELECT s.z AS parent_z, h AS parent_h, place, s.z + 1 AS z, x * 2 + a AS x, y * 2 + b AS y FROM small s, {CORNERS})" + tile_h("out", "kids", "parent_z, parent_h, place, z, x, y") + " SELECT * FROM out"),
    "tile_grandchildren": q(SMALL + f", kids AS (SELECT s.z AS parent_z, h AS parent_h, p * 4 + r AS place, s.z + 2 AS z, x * 4 + 2 * a + c AS x, y * 4 + 2 * b + d AS y FROM small s, {GRAND})" + tile_h("out", "kids", "parent_z, parent_h, place, z, x, y") + " SELECT * FROM out"),
    "tile_pyramid": q(TILES + pyramid("SELECT DISTINCT z, x, y FROM tiles", 2) + " SELECT * FROM pyramid"),
    "tile_project": q(f""", p AS (SELECT osm_id, x, y, (osm_id % 15)::INT AS z, coalesce(lag(x) OVER w, x) AS ox, coalesce(lag(y) OVER w, y) AS oy FROM nodes WINDOW w AS (PARTITION BY osm_id // 1000 ORDER BY osm_id)),
      t AS (SELECT *, ox >> (32 - z) AS tx, oy >> (32 - z) AS ty FROM p)
      SELECT osm_id, z, tx, ty, {project("z", "tx", "x")} AS px, {project("z", "ty", "y")} AS py FROM t"""),
    "hilbert_bearing": q(TILES + ", b0 AS (SELECT row_number() OVER () AS b, * FROM (SELECT DISTINCT z, x, y, h FROM tiles))" + bearing("b0") + " SELECT z, x, y, h, bearing FROM b0 JOIN bearings USING (b)"),
    "nodes_scan": q("SELECT osm_id, lon, lat, (SELECT count(*) FROM tags t WHERE t.kind = 'node' AND t.osm_id = n.osm_id) AS n_tags FROM node_places n"),
    "header_bbox": q("SELECT min(lon) AS bbox_left, max(lon) AS bbox_right, max(lat) AS bbox_top, min(lat) AS bbox_bottom, 100 AS coord_scale FROM node_places"),
    "way_ref_resolution": q("SELECT osm_id, pos, ref, h IS NOT NULL AS resolved FROM way_points"),
    "member_resolution": q("SELECT relation, type, ref, role, e.osm_id IS NOT NULL AS resolved FROM members LEFT JOIN entities e ON e.kind = type AND e.osm_id = ref"),
    "conversion_stats": q("SELECT (SELECT count(*) FROM node_keys) AS n_nodes, (SELECT count(*) FROM orders) AS n_ways, (SELECT count(*) FROM relation_ids) AS n_relations, count(*) AS n_refs, count(*) FILTER (h IS NULL) AS unresolved_refs, (SELECT count(*) FROM members) AS n_members, " + ", ".join(f"(SELECT count(*) FROM members WHERE type = '{k}' AND (type, ref) NOT IN (SELECT (kind, osm_id) FROM entities)) AS unresolved_{k}s" for k in ("node", "way", "relation")) + " FROM way_points"),
    "dense_ids": q("SELECT osm_id, row_number() OVER (ORDER BY osm_id) - 1 AS idx FROM node_keys"),
    "string_table": q(NODE_STRINGS + " SELECT s, first_pos, coalesce(sum(strlen(s) + 1) OVER (ORDER BY first_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM first_strings"),
    "tag_dictionary": q(NODE_STRINGS + " SELECT k, v, row_number() OVER (ORDER BY min(spot)) - 1 AS tag_id FROM node_strings GROUP BY k, v"),
    "range_to_next": q(", n AS (SELECT o_orderkey AS osm_id, coalesce(n_refs, 0) AS n FROM orders LEFT JOIN way_sizes ON osm_id = o_orderkey), f AS (SELECT osm_id, (sum(n) OVER (ORDER BY osm_id) - n)::BIGINT AS first_ref FROM n) SELECT osm_id, first_ref, coalesce(lead(first_ref) OVER (ORDER BY osm_id), (SELECT sum(n) FROM n))::BIGINT AS next_first FROM f"),
    "delta_decode": q("SELECT osm_id, pos, ref - coalesce(lag(ref) OVER (PARTITION BY osm_id ORDER BY pos), 0) AS delta, ref AS decoded FROM refs"),
    "way_location_short": q("SELECT osm_id, h FROM way_h LEFT JOIN way_sizes USING (osm_id) WHERE coalesce(n_refs, 0) < 4 AND h IS NOT NULL"),
    "way_location_surface": q("SELECT osm_id, h FROM way_h JOIN way_sizes USING (osm_id) WHERE n_refs >= 4"),
    "relation_location": q("SELECT osm_id, h FROM relation_h"),
    "hilbert_sort": q("SELECT kind, osm_id, h, row_number() OVER (ORDER BY CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h::HUGEINT END, kind, osm_id) - 1 AS place FROM located"),
    "leaf_index": q("SELECT tile_h, n, w, r, (sum(n) OVER o - n)::BIGINT AS first_n, (sum(w) OVER o - w)::BIGINT AS first_w, (sum(r) OVER o - r)::BIGINT AS first_r FROM leaf_counts WINDOW o AS (ORDER BY tile_h)"),
    "tile_tree": q(f"SELECT z, h, bit_or(1 << (child & 15)::INT)::INT AS mask, count(*) AS children, min(child) AS first_child FROM (SELECT DISTINCT z::INT AS z, tile_h >> (2 * ({LEAF} - z))::INT AS h, tile_h >> (2 * ({LEAF} - z) - 4)::INT AS child FROM leaf_counts, levels) GROUP BY z, h"),
    "child_rank_lookup": q("SELECT tile_h, tile_h // 16 AS h, (sum(1 << (tile_h % 16)::INT) OVER p)::INT AS mask, (row_number() OVER (PARTITION BY tile_h // 16 ORDER BY tile_h) - 1)::INT AS rank, (count(*) OVER p)::INT AS children FROM leaf_counts WINDOW p AS (PARTITION BY tile_h // 16)"),
    "external_ways": q("SELECT tile_h, osm_id FROM external WHERE kind = 'way'"),
    "external_relations": q("SELECT tile_h, osm_id FROM external WHERE kind = 'relation'"),
    "leaf_externals": q("SELECT l.tile_h, count(*) FILTER (e.kind = 'way') AS w_ext, count(*) FILTER (e.kind = 'relation') AS r_ext, coalesce(string_agg(e.osm_id::VARCHAR, ',' ORDER BY e.osm_id) FILTER (e.kind = 'relation'), '') AS relations FROM leaf_counts l LEFT JOIN external e USING (tile_h) GROUP BY l.tile_h"),
    "rule_tables": q("SELECT class::INT AS class, coalesce(k, '') AS k, coalesce(v, '') AS v, rule FROM best_criteria"),
    "layer_warnings": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in WARN) + ") AS t(kind, name)",
    "unmatched_rule_strings": q(f"SELECT s FROM (VALUES {RULE_STRINGS}) AS t(s) WHERE s NOT IN (SELECT k FROM tags UNION SELECT v FROM tags)"),
    "classify_entities": q("SELECT kind, osm_id, rule FROM classified"),
    "untagged_filter": q("SELECT kind, count(*) AS n FROM rendered GROUP BY kind"),
    "zoom_filter": q(f"SELECT z::INT AS z, kind, rule, count(*) AS n FROM rendered, (SELECT range AS z FROM range(0, {LEAF + 1}, 2)) WHERE minzoom <= z AND maxzoom >= z GROUP BY ALL"),
    "tag_lookup": q("SELECT e.kind, e.osm_id, max(CASE WHEN k = 'status' THEN v END) AS status, coalesce(max(CASE WHEN k = 'status' THEN v END) = 'O', false) AS is_open, count(k)::INT AS n_tags FROM entities e LEFT JOIN tags t ON t.kind = e.kind AND t.osm_id = e.osm_id GROUP BY e.kind, e.osm_id"),
    "tile_content": q("SELECT z::INT AS z, tile_h, kind, osm_id FROM content"),
    "tile_content_independent": q(f"SELECT z::INT AS z, tile_h, kind, count(*) AS n FROM (SELECT DISTINCT z, tile_h >> (2 * ({LEAF} - z))::INT AS tile_h, kind, osm_id FROM at_leaf JOIN rendered USING (kind, osm_id), levels WHERE z BETWEEN minzoom AND maxzoom) GROUP BY ALL"),
    "leaf_compose": q("SELECT tile_h, kind, count(*) AS n, bit_xor(osm_id) AS ids FROM at_leaf JOIN rendered USING (kind, osm_id) GROUP BY tile_h, kind"),
    "htile_compose": q("SELECT z::INT AS z, tile_h, kind, count(*) AS n, bit_xor(osm_id) AS ids FROM content GROUP BY z, tile_h, kind"),
    "include_leaves": q("SELECT * FROM leaf_counts WHERE tile_h % 7 = 0"),
    "tag_projection": q(PROPS + " SELECT kind, osm_id, rule, string_agg(k || '=' || p.v, ';' ORDER BY p) AS props FROM props p JOIN rendered USING (kind, osm_id) GROUP BY kind, osm_id, rule"),
    "layer_fanout": q(FANOUT),
    "feature_geometry": q(GEOMETRY + " SELECT tile_h, kind, osm_id, string_agg(tx || ' ' || ty, ',' ORDER BY pos) AS path FROM leaf_points GROUP BY tile_h, kind, osm_id"),
    "geometry_type": q(PATHS + " SELECT osm_id, type FROM types"),
    "signed_area": q(PATHS + ", prior AS (SELECT *, coalesce(lag(px) OVER w, last_value(px) OVER v) AS qx, coalesce(lag(py) OVER w, last_value(py) OVER v) AS qy FROM paths WINDOW w AS (PARTITION BY osm_id ORDER BY pos), v AS (PARTITION BY osm_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT osm_id, sum((qx - px) * (py + qy))::BIGINT AS area FROM prior JOIN types USING (osm_id) WHERE type = 3 GROUP BY osm_id"),
    "tile_dictionary": q(PROPS + """, used AS (SELECT z, tile_h, CASE kind WHEN 'relation' THEN 0 WHEN 'node' THEN 1 ELSE 2 END AS o, osm_id, p, k, p.v FROM content JOIN props p USING (kind, osm_id)),
      firsts AS (SELECT z, tile_h, s, min([o, osm_id, p, side]) AS spot FROM (SELECT z, tile_h, o, osm_id, p, 0 AS side, k AS s FROM used UNION ALL SELECT z, tile_h, o, osm_id, p, 1, v FROM used) GROUP BY z, tile_h, s)
      SELECT z::INT AS z, tile_h, s, (row_number() OVER (PARTITION BY z, tile_h ORDER BY spot) - 1)::INT AS idx FROM firsts"""),
    "report_rows": q(""", shown AS (SELECT tile_h, rule FROM at_leaf JOIN rendered USING (kind, osm_id)), sizes AS (SELECT tile_h, count(*) * 8 + 28 AS bytes FROM shown GROUP BY tile_h)
      SELECT tile_h, layer, count(*) AS features, bytes, printf(CASE WHEN bytes > 1048576 THEN '%.2f M' ELSE '%.2f K' END, CASE WHEN bytes > 1048576 THEN bytes / 1048576.0::DOUBLE ELSE bytes / 1024.0::DOUBLE END) AS size
      FROM shown JOIN layer_rules USING (rule) JOIN sizes USING (tile_h) GROUP BY tile_h, layer, bytes"""),
    "style_filter": q(PATHS + " SELECT osm_id, type, v AS status FROM types JOIN tags USING (osm_id) WHERE kind = 'way' AND k = 'status' AND v = 'O' AND type IN (2, 3)"),
    "pick_bbox": q(GEOMETRY + " SELECT DISTINCT kind, osm_id FROM leaf_points WHERE tx BETWEEN 3696 AND 4496 AND ty BETWEEN 3696 AND 4496"),
    "info_layers": q(TILES + pyramid("SELECT DISTINCT z, x, y FROM tiles", 1) + tile_h("pyr", "pyramid", "root_z, root_x, root_y, z, x, y")
      + ", b0 AS (SELECT row_number() OVER () AS b, * FROM pyr)" + bearing("b0") + f""", g AS (SELECT b0.*, bearing, x << (32 - z) AS nx, y << (32 - z) AS ny, 4294967295 >> z AS ext FROM b0 JOIN bearings USING (b))
      SELECT root_z, root_x, root_y, z, x, y, h, bearing, {project("root_z", "root_x", "nx")} AS west, {project("root_z", "root_y", "ny")} AS north,
      {project("root_z", "root_x", "(nx + ext)")} AS east, {project("root_z", "root_y", "(ny + ext)")} AS south, {project("root_z", "root_x", "(nx + ext // 2)")} AS center_x,
      {project("root_z", "root_y", "(ny + ext // 2)")} AS center_y, z = root_z AND x = root_x AND y = root_y AS is_render_tile FROM g"""),
    "source_union": q(f" SELECT 0 AS source_pos, z, tile_h, layer, n FROM ({FANOUT}) UNION ALL SELECT 1, z::INT, tile_h, 'All entities', count(*) FROM content GROUP BY z, tile_h"),
    "tile_decode": q(" SELECT tile_h, layer, l.h AS id, rule, coalesce(n_points, 1)::INT AS n_points FROM at_leaf JOIN rendered USING (kind, osm_id) JOIN layer_rules USING (rule) JOIN located l USING (kind, osm_id) LEFT JOIN (SELECT 'way' AS kind, osm_id, count(h) AS n_points FROM way_points GROUP BY osm_id) USING (kind, osm_id)"),
    "layer_mute_solo": q(" SELECT DISTINCT state, layer_pos::INT AS layer_pos, layer FROM layer_rules, (VALUES ('mute'), ('solo'), ('all')) AS c(state) WHERE state = 'all' OR (state = 'mute' AND layer NOT IN ('Orders', 'Parts')) OR (state = 'solo' AND layer IN ('Parts', 'Regions'))"),
    "block_types": "WITH b AS (SELECT *, row_number() OVER (ORDER BY event_type, user_id, event_id) - 1 AS i FROM events) SELECT event_type, count(*) AS n, arg_min(event_id, i) AS first_block, min(i) AS first, max(i) + 1 AS next_first FROM b GROUP BY event_type",
}
SQL["tile_address"] = q(TILES + " SELECT osm_id, z, x, y, h, (z::BIGINT << 47) | h AS id, h || ' ' || z || '/' || x || '/' || y AS label FROM tiles")


def _at(x: str, y: str) -> str:
    return f"{project('root_z', 'root_x', x)} || ' ' || {project('root_z', 'root_y', y)}"


_SIDES = {"N": _at("(nx + ext // 2)", "ny"), "W": _at("nx", "(ny + ext // 2)"), "S": _at("(nx + ext // 2)", "(ny + ext)"), "E": _at("(nx + ext)", "(ny + ext // 2)")}
_CENTRE = _at("(nx + ext // 2)", "(ny + ext // 2)")
_RING = " || ',' || ".join(_at(x, y) for x, y in (("nx", "ny"), ("nx", "(ny + ext)"), ("(nx + ext)", "(ny + ext)"), ("(nx + ext)", "ny"), ("nx", "ny")))
_WAY = "CASE bearing " + " ".join(f"WHEN '{a}{b}' THEN {_SIDES[a]} || ',' || {_CENTRE} || ',' || {_SIDES[b]}" for a in "NWSE" for b in "NWSE" if a != b) + " ELSE '' END"
TREE = SQL["tile_tree"].removeprefix(q(""))
DOCUMENTS = PROPS + GEOMETRY + """,
listed AS (SELECT kind, osm_id, list(k ORDER BY p) AS keys, list(v ORDER BY p) AS vals FROM props GROUP BY kind, osm_id),
ways_of AS (SELECT tile_h, kind, osm_id, list({'x': tx, 'y': ty} ORDER BY pos) AS path FROM leaf_points GROUP BY tile_h, kind, osm_id),
feats AS (
  SELECT w.tile_h, kind, osm_id, CASE kind WHEN 'relation' THEN 0 WHEN 'node' THEN 1 ELSE 2 END AS o, l.h AS id, rule, keys, vals, path
  FROM ways_of w JOIN rendered r USING (kind, osm_id) JOIN listed USING (kind, osm_id) JOIN located l USING (kind, osm_id)),
grid AS (SELECT * FROM (SELECT DISTINCT tile_h FROM feats), (SELECT DISTINCT layer_pos, layer FROM layer_rules)),
filled AS (
  SELECT tile_h, layer, list({'o': o, 'osm_id': osm_id, 'id': id, 'keys': keys, 'values': vals, 'geometries': [path]} ORDER BY o, osm_id) AS features
  FROM feats JOIN layer_rules USING (rule) GROUP BY tile_h, layer),
docs AS (
  SELECT tile_h, list({'layer_pos': layer_pos, 'name': layer, 'features': coalesce(features, [])} ORDER BY layer_pos) AS layers
  FROM grid LEFT JOIN filled USING (tile_h, layer) GROUP BY tile_h)"""
SQL |= {
    "nested_relations": q(f""", world AS (SELECT 2000 AS osm_id, (sum(hu) // count(hu))::HUGEINT AS hu FROM (SELECT hu FROM region_h UNION ALL SELECT hu FROM nodes WHERE osm_id = 2000000001)),
      universe AS (SELECT 3000 AS osm_id, (sum(hu) // count(hu))::HUGEINT AS hu FROM (SELECT hu FROM world UNION ALL SELECT hu FROM nation_h WHERE osm_id = 1))
      SELECT osm_id, h, true AS settled FROM relation_h UNION ALL SELECT osm_id, {signed("hu")}, true FROM world UNION ALL SELECT osm_id, {signed("hu")}, true FROM universe
      UNION ALL SELECT 4000, {signed("hu")}, true FROM universe UNION ALL SELECT * FROM (VALUES (5001, NULL::BIGINT, false), (5002, NULL, false), (6000, NULL, false), (7000, NULL, true), (8000, NULL, true))"""),
    "tile_find": q(TILES + f""", tree AS ({TREE}), wanted AS (SELECT DISTINCT z, h FROM tiles)
      SELECT w.z, w.h, CASE WHEN l.tile_h IS NOT NULL THEN 'leaf' WHEN t.h IS NOT NULL THEN 'tile' ELSE 'none' END AS found, CASE WHEN l.tile_h IS NOT NULL THEN 0 ELSE t.mask END AS mask, l.n + l.w + l.r AS entities
      FROM wanted w LEFT JOIN leaf_counts l ON w.z = {LEAF} AND l.tile_h = w.h LEFT JOIN tree t ON t.z = w.z AND t.h = w.h"""),
    "archive_root": q(f", tree AS ({TREE}) SELECT kind, count(*) AS n, bit_xor(osm_id) AS ids, mask, children FROM content, tree WHERE content.z = 0 AND tree.z = 0 GROUP BY kind, mask, children"),
    "origin_leaf": q(f"SELECT z::INT AS z, tile_h >> (2 * ({LEAF} - z))::INT AS h, min(tile_h) AS leaf_h FROM leaf_counts, levels GROUP BY 1, 2"),
    "info_features": SQL["info_layers"][: SQL["info_layers"].rindex("SELECT root_z, root_x")]
      + f"SELECT root_z, root_x, root_y, z, x, y, h, 'Tile Boundary' AS layer, {_RING} AS path FROM g UNION ALL SELECT root_z, root_x, root_y, z, x, y, h, 'Tile Center', {_CENTRE} FROM g "
      + f"UNION ALL SELECT root_z, root_x, root_y, z, x, y, h, 'Tile Bearing', {_WAY} FROM g",
    "basic_tile": q(TILES + """, t AS (SELECT DISTINCT z, x, y, h FROM tiles) SELECT z, x, y, h AS id, z::DOUBLE AS p_z, x::DOUBLE AS p_x, y::DOUBLE AS p_y, h::DOUBLE AS p_h, layer, path
      FROM t, (VALUES ('tile_boundary', '0 0,0 8192,8192 8192,8192 0,0 0'), ('tile_center', '4096 4096')) AS f(layer, path)"""),
    "style_layers": q(""", ids AS (SELECT DISTINCT layer_pos * 4 + k AS place, layer_pos, layer, k, 'Osm ' || layer || ' ' || t AS id FROM layer_rules, (VALUES (0, 'fill'), (1, 'line'), (2, 'circle')) AS x(k, t) WHERE (layer_pos + k) % 3 <> 0)
      SELECT min(place)::INT AS place, 'Osm ' || layer AS name, max(CASE WHEN k = 0 THEN id END) AS fill, max(CASE WHEN k = 1 THEN id END) AS line, max(CASE WHEN k = 2 THEN id END) AS circle, (min(place) % 35)::INT AS colour FROM ids GROUP BY layer"""),
    "delimiter_scan": """SELECT p_partkey, (pos - 1)::INT AS pos, s, (sum(strlen(s) + 1) OVER (PARTITION BY p_partkey ORDER BY pos) - 1)::BIGINT AS ends
      FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS s, generate_subscripts(string_split(p_type, ' '), 1) AS pos FROM part)""",
    "utf8_validation": "SELECT p_partkey, p_partkey % 3 <> 0 AS valid, CASE WHEN p_partkey % 3 <> 0 THEN p_name || 'é' END AS s FROM part",
    "packed_ids": q("SELECT osm_id, printf('%02X%02X%02X%02X%02X', osm_id & 255, (osm_id >> 8) & 255, (osm_id >> 16) & 255, (osm_id >> 24) & 255, (osm_id >> 32) & 255) AS packed, osm_id AS unpacked FROM nodes"),
    "tile_document": q(DOCUMENTS + " SELECT tile_h, to_json(layers)::VARCHAR AS layers FROM docs"),
    "tile_report": q(DOCUMENTS + """,
      sizes AS (SELECT tile_h, strlen(to_json(layers)::VARCHAR) AS bytes, [x.name FOR x IN layers] AS names, [len(x.features) FOR x IN layers] AS counts FROM docs),
      shown AS (SELECT * FROM feats JOIN layer_rules USING (rule)),
      told AS (SELECT tile_h, layer, kind, osm_id, unnest(keys) AS k, unnest(vals) AS v FROM shown),
      said AS (SELECT tile_h, string_agg(p, '|' ORDER BY p) AS properties, sum(n)::INT AS n_points FROM (SELECT tile_h, array_to_string(list_transform(list_zip(keys, vals), lambda q: q[1] || '=' || q[2]), ';') AS p, len(path) AS n FROM shown) GROUP BY tile_h),
      dictionary AS (SELECT tile_h, count(DISTINCT s)::INT AS n_strings FROM (SELECT tile_h, k AS s FROM told UNION ALL SELECT tile_h, v FROM told WHERE k <> 'osm_id' UNION ALL SELECT tile_h, layer FROM grid) GROUP BY tile_h),
      typed AS (SELECT tile_h, count(DISTINCT (k = 'osm_id', v))::INT AS n_values FROM told GROUP BY tile_h)
      SELECT tile_h, printf(CASE WHEN bytes > 1048576 THEN '%.2f M' ELSE '%.2f K' END, CASE WHEN bytes > 1048576 THEN bytes / 1048576.0::DOUBLE ELSE bytes / 1024.0::DOUBLE END) AS size,
        array_to_string(names, ',') AS layer_names, array_to_string(counts, ',') AS counts, coalesce(properties, '') AS properties, n_strings, coalesce(n_values, 0) AS n_values, coalesce(n_points, 0) AS n_points
      FROM sizes JOIN dictionary USING (tile_h) LEFT JOIN said USING (tile_h) LEFT JOIN typed USING (tile_h)"""),
    "feature_geojson": q(DOCUMENTS + f""", lonlat AS (
        SELECT tile_h, kind, osm_id, ((l.x * 8192.0::DOUBLE + tx) * s / 4294967295.0::DOUBLE - 0.5::DOUBLE) * 360.0::DOUBLE AS lon,
          (2.0::DOUBLE * atan(exp((1.0::DOUBLE - 2.0::DOUBLE * ((l.y * 8192.0::DOUBLE + ty) * s / 4294967295.0::DOUBLE)) * pi())) - pi() / 2.0::DOUBLE) * (180.0::DOUBLE / pi()) AS lat
        FROM leaf_points JOIN leaf_walk l USING (tile_h), (SELECT pow(2.0::DOUBLE, 32 - {LEAF}) / 8192.0::DOUBLE AS s) WHERE k = {LEAF})
      SELECT f.tile_h, f.kind, f.osm_id, 'Feature' AS type, any_value(f.id) AS id,
        CASE WHEN any_value(len(path)) < 2 THEN 'MultiPoint' WHEN any_value(path[1] = path[-1]) THEN 'MultiPolygon' ELSE 'MultiLineString' END AS geometry, any_value(len(path))::INT AS n_points, any_value(rule) AS rule,
        round(min(lon) * 1000)::BIGINT AS west, round(max(lon) * 1000)::BIGINT AS east, round(min(lat) * 1000)::BIGINT AS south, round(max(lat) * 1000)::BIGINT AS north
      FROM feats f JOIN lonlat g ON g.tile_h = f.tile_h AND g.kind = f.kind AND g.osm_id = f.osm_id GROUP BY f.tile_h, f.kind, f.osm_id"""),
}
