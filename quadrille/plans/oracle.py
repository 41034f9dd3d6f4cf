"""DuckDB SQL for the map queries: shared table expressions and one statement per query."""

from __future__ import annotations

from quadrille.sources.manifest import STAR


def signed(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808 THEN ({h} - 18446744073709551616)::BIGINT ELSE {h}::BIGINT END)"


def hilbert(name: str, source: str, key: str) -> str:
    """Table ``name`` (key, hu) by the textbook recurrence over the points (key, x, y) of ``source``."""
    return f"""
{name}_walk AS (
  SELECT {key}, x::BIGINT AS px, y::BIGINT AS py, 31 AS k, 0::HUGEINT AS hu FROM {source}
  UNION ALL
  SELECT {key}, CASE WHEN ry = 1 THEN px WHEN rx = 1 THEN 4294967295 - py ELSE py END,
         CASE WHEN ry = 1 THEN py WHEN rx = 1 THEN 4294967295 - px ELSE px END, k - 1, hu * 4 + xor(3 * rx, ry)
  FROM (SELECT *, (px >> k) & 1 AS rx, (py >> k) & 1 AS ry FROM {name}_walk WHERE k >= 0)),
{name} AS (SELECT {key}, hu FROM {name}_walk WHERE k = -1)"""


def grid_x(lon: str) -> str:
    return f"least(floor(greatest(0.0, least(1.0, {lon} / 1e7 / 360.0::DOUBLE + 0.5::DOUBLE)) * 4294967296.0::DOUBLE), 4294967295)::BIGINT"


def mercator_y(lat: str) -> str:
    phi = f"({lat} / 1e7 * 0.017453292519943295::DOUBLE)"
    return f"greatest(0.0, least(1.0, (1.0::DOUBLE - ln(tan{phi} + 1.0::DOUBLE / cos{phi}) / pi()) / 2.0::DOUBLE))"


def grid_y(lat: str) -> str:
    return f"least(floor({mercator_y(lat)} * 4294967296.0::DOUBLE), 4294967295)::BIGINT"


def literal(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def rows(table: str, columns: str, values: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in values)
    return f"{table} AS (SELECT * FROM (VALUES {body}) AS t({columns}))"


def _criteria() -> list[tuple]:
    out = []
    for name, rule in STAR.rules.items():
        out += [(0, k, v, name) for k, v in rule.tags] + [(1, None, v, name) for v in rule.values] + [(2, k, None, name) for k in rule.keys]
    return out


LEAF = STAR.leaf_zoom
LAYERS = ["no_rule", *STAR.layer_order]
EVALS = [("no_rule", LEAF, LEAF, "All", "")] + [
    (n, r.minzoom, LEAF if r.maxzoom is None else r.maxzoom, r.include if isinstance(r.include, str) else "Keys",
     "" if isinstance(r.include, str) else ",".join(r.include)) for n, r in STAR.rules.items()
]
LAYER_RULES = [(0, "no_rule", "no_rule")] + [
    (LAYERS.index(layer), layer, rule) for layer, names in STAR.layers.items() if layer in LAYERS for rule in names if rule in STAR.rules
]
SHIFT = 1 << (2 * (32 - LEAF))

PRELUDE = f"""
WITH RECURSIVE node_keys AS (
  SELECT 1000000000 + s_suppkey AS osm_id, s_suppkey AS k, s_nationkey::BIGINT % 25 AS c, 1 AS g FROM supplier WHERE s_suppkey % 17 <> 0
  UNION ALL SELECT 2000000000 + c_custkey, c_custkey, c_nationkey::BIGINT % 25, 2 FROM customer
  UNION ALL SELECT 3000000000 + p_partkey, p_partkey, p_size::BIGINT % 25, 3 FROM part),
node_places AS (
  SELECT osm_id, (-1700000000 + (c % 5) * 700000000 + (k % 100000000 * 2654435761 + g * 17000001) % 100000000)::BIGINT AS lon,
         (-600000000 + c // 5 * 250000000 + (k % 50000000 * 2654404609 + g * 9000001) % 50000000)::BIGINT AS lat FROM node_keys),
node_grid AS (SELECT osm_id, lon, lat, {grid_x("lon")} AS x, {grid_y("lat")} AS y FROM node_places),
{hilbert("node_h", "node_grid", "osm_id")},
nodes AS (SELECT g.*, hu, {signed("hu")} AS h FROM node_grid g JOIN node_h USING (osm_id)),
items AS (
  SELECT l_orderkey AS osm_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS pos,
         1000000000 + l_suppkey AS ref FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
refs AS (
  SELECT * FROM items UNION ALL
  SELECT osm_id, n, ref FROM (SELECT osm_id, ref, pos, count(*) OVER (PARTITION BY osm_id) AS n FROM items) JOIN orders ON osm_id = o_orderkey
  WHERE pos = 0 AND o_custkey % 5 = 0),
way_sizes AS (SELECT osm_id, count(*) AS n_refs, arg_min(ref, pos) = arg_max(ref, pos) AS ring FROM refs GROUP BY osm_id),
way_points AS (
  SELECT r.osm_id, n_refs, ring, pos, ref, lon, lat, x, y, h, hu
  FROM refs r JOIN way_sizes USING (osm_id) LEFT JOIN nodes n ON n.osm_id = r.ref),
way_walk AS (
  SELECT *, count(*) OVER w AS n, lag(lon) OVER o AS plon, lag(lat) OVER o AS plat, lead(lon) OVER o AS nlon,
         (min(lat::DOUBLE) OVER w + max(lat::DOUBLE) OVER w) / 2 AS mid,
         first_value(lon) OVER o AS flon, first_value(lat) OVER o AS flat
  FROM way_points WHERE h IS NOT NULL WINDOW w AS (PARTITION BY osm_id), o AS (PARTITION BY osm_id ORDER BY pos)),
way_lengths AS (SELECT *, sqrt((lon - plon)::DOUBLE * (lon - plon) + (lat - plat)::DOUBLE * (lat - plat)) AS len FROM way_walk),
way_centres AS (
  SELECT osm_id, sum(len * ((lon + plon) / 2)) / sum(len) AS cx, sum(len * ((lat + plat) / 2)) / sum(len) AS cy
  FROM way_lengths GROUP BY osm_id HAVING sum(len) > 0),
way_inner AS (
  SELECT osm_id, arg_min(h, [d, pos]) AS inner_h FROM (
    SELECT l.osm_id, h, pos, (lon - coalesce(cx, flon)) * (lon - coalesce(cx, flon)) + (lat - coalesce(cy, flat)) * (lat - coalesce(cy, flat)) AS d
    FROM way_lengths l LEFT JOIN way_centres USING (osm_id) WHERE plon IS NOT NULL AND nlon IS NOT NULL) GROUP BY osm_id),
way_cuts AS (
  SELECT osm_id, mid, cut, row_number() OVER (PARTITION BY osm_id ORDER BY cut) AS rn, lead(cut) OVER (PARTITION BY osm_id ORDER BY cut) AS next
  FROM (SELECT osm_id, mid, plon + (mid - plat) * (lon - plon) / (lat - plat) AS cut FROM way_walk WHERE (lat <= mid) <> (plat <= mid))),
way_widest AS (
  SELECT osm_id, mid, (cut + next) / 2 AS cx, next - cut AS w FROM way_cuts WHERE rn % 2 = 1 AND next IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY osm_id ORDER BY next - cut DESC, rn) = 1),
way_ring_grid AS (SELECT osm_id, {grid_x("trunc(cx)")} AS x, {grid_y("trunc(mid)")} AS y FROM way_widest WHERE w > 0),
{hilbert("way_ring_h", "way_ring_grid", "osm_id")},
way_first AS (SELECT osm_id, n, arg_min(h, pos) AS first_h, max(CASE WHEN pos = n_refs // 2 THEN h END) AS median_h FROM way_walk GROUP BY osm_id, n),
way_h AS (
  SELECT o_orderkey AS osm_id, CASE WHEN n_refs < 4 OR n < 4 THEN first_h
    WHEN ring THEN coalesce({signed("r.hu")}, median_h, first_h) ELSE coalesce(inner_h, median_h, first_h) END AS h
  FROM orders LEFT JOIN way_sizes s ON s.osm_id = o_orderkey LEFT JOIN way_first f ON f.osm_id = o_orderkey
  LEFT JOIN way_inner i ON i.osm_id = o_orderkey LEFT JOIN way_ring_h r ON r.osm_id = o_orderkey),
members AS (
  SELECT (c_nationkey + 1)::BIGINT AS relation, 2000000000 + c_custkey AS pos, 'node' AS type, 2000000000 + c_custkey AS ref, 'customer' AS role FROM customer
  UNION ALL SELECT c_nationkey + 1, o_orderkey, 'way', o_orderkey, 'order' FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT n_regionkey + 1000, n_nationkey + 1, 'relation', n_nationkey + 1, 'nation' FROM nation),
nation_h AS (
  SELECT relation AS osm_id, (sum(CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h END)::HUGEINT // count(*)) AS hu FROM (
    SELECT relation, h FROM members JOIN nodes n ON type = 'node' AND ref = n.osm_id
    UNION ALL SELECT relation, h FROM members JOIN way_h w ON type = 'way' AND ref = w.osm_id WHERE h IS NOT NULL) GROUP BY relation),
region_h AS (
  SELECT relation AS osm_id, sum(hu)::HUGEINT // count(*) AS hu FROM members JOIN nation_h ON type = 'relation' AND ref = osm_id GROUP BY relation),
relation_ids AS (SELECT DISTINCT relation AS osm_id FROM members),
relation_h AS (
  SELECT i.osm_id, {signed("coalesce(n.hu, r.hu)")} AS h FROM relation_ids i LEFT JOIN nation_h n USING (osm_id) LEFT JOIN region_h r USING (osm_id)),
located AS (
  SELECT 'node' AS kind, osm_id, h FROM nodes UNION ALL SELECT 'way', osm_id, h FROM way_h WHERE h IS NOT NULL
  UNION ALL SELECT 'relation', osm_id, h FROM relation_h WHERE h IS NOT NULL),
placed AS (
  SELECT *, ((CASE WHEN h < 0 THEN h + 18446744073709551616::HUGEINT ELSE h::HUGEINT END) // {SHIFT})::BIGINT AS tile_h FROM located),
tags AS (
  SELECT 'node' AS kind, 1000000000 + s_suppkey AS osm_id, 0 AS pos, 'kind' AS k, 'supplier' AS v FROM supplier WHERE s_suppkey % 17 <> 0
  UNION ALL SELECT 'node', 1000000000 + s_suppkey, 1, 'nation', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 17 <> 0
  UNION ALL SELECT 'node', 2000000000 + c_custkey, 0, 'kind', 'customer' FROM customer
  UNION ALL SELECT 'node', 2000000000 + c_custkey, 1, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'node', 3000000000 + p_partkey, 0, 'type', p_type FROM part WHERE p_size >= 10
  UNION ALL SELECT 'node', 3000000000 + p_partkey, 1, 'brand', p_brand FROM part WHERE p_size >= 10
  UNION ALL SELECT 'way', o_orderkey, 0, 'priority', o_orderpriority FROM orders
  UNION ALL SELECT 'way', o_orderkey, 1, 'status', o_orderstatus FROM orders
  UNION ALL SELECT 'relation', n_nationkey + 1, 0, 'type', 'multipolygon' FROM nation
  UNION ALL SELECT 'relation', n_nationkey + 1, 1, 'name', n_name FROM nation
  UNION ALL SELECT 'relation', r_regionkey + 1000, 0, 'type', 'boundary' FROM region
  UNION ALL SELECT 'relation', r_regionkey + 1000, 1, 'name', r_name FROM region),
entities AS (
  SELECT 'node' AS kind, osm_id FROM node_keys UNION ALL SELECT 'way', o_orderkey FROM orders UNION ALL SELECT 'relation', osm_id FROM relation_ids),
{rows("criteria", "class, k, v, rule", _criteria())},
best_criteria AS (SELECT class, k, v, max(rule) AS rule FROM criteria GROUP BY class, k, v),
{rows("evals", "rule, minzoom, maxzoom, include, include_keys", EVALS)},
{rows("layer_rules", "layer_pos, layer, rule", sorted(set(LAYER_RULES)))},
matches AS (
  SELECT kind, osm_id, arg_min(rule, class * 1000 + pos) AS rule FROM tags t JOIN best_criteria c
  ON (class = 0 AND t.k = c.k AND t.v = c.v) OR (class = 1 AND t.v = c.v) OR (class = 2 AND t.k = c.k) GROUP BY kind, osm_id),
classified AS (SELECT kind, osm_id, coalesce(rule, 'no_rule') AS rule FROM entities LEFT JOIN matches USING (kind, osm_id)),
rendered AS (
  SELECT c.*, minzoom, maxzoom, include, include_keys FROM classified c JOIN evals USING (rule)
  WHERE kind <> 'node' OR (kind, osm_id) IN (SELECT kind, osm_id FROM tags)),
external AS (
  SELECT DISTINCT p.tile_h, 'way' AS kind, w.osm_id FROM way_points w JOIN placed p ON p.kind = 'node' AND p.osm_id = w.ref
  JOIN placed o ON o.kind = 'way' AND o.osm_id = w.osm_id WHERE p.tile_h <> o.tile_h
  UNION ALL
  SELECT DISTINCT p.tile_h, 'relation', m.relation FROM members m JOIN placed p ON p.kind = m.type AND p.osm_id = m.ref
  JOIN placed o ON o.kind = 'relation' AND o.osm_id = m.relation WHERE p.tile_h <> o.tile_h),
at_leaf AS (SELECT tile_h, kind, osm_id FROM placed UNION ALL SELECT * FROM external),
leaf_counts AS (
  SELECT tile_h, count(*) FILTER (kind = 'node') AS n, count(*) FILTER (kind = 'way') AS w, count(*) FILTER (kind = 'relation') AS r FROM placed GROUP BY tile_h),
levels AS (SELECT range AS z FROM range(0, {LEAF}, 2)),
content AS (
  SELECT DISTINCT z, (tile_h >> (2 * ({LEAF} - z)))::BIGINT AS tile_h, kind, osm_id FROM at_leaf JOIN rendered USING (kind, osm_id), levels
  WHERE minzoom <= z AND maxzoom >= {LEAF - 2})
"""


def q(body: str) -> str:
    return PRELUDE + body
