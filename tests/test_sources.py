"""Manifests, XML and PBF."""

import struct
import zlib

import pytest

from quadrille.operators import rules
from quadrille.sources import manifest, osm_pbf, osm_xml

XML = """<?xml version='1.0' encoding='UTF-8'?>
<osm version="0.6">
<node id="1" lat="37.0491457" lon="-122.0279745"><tag k="amenity" v="bench"/><tag k="note" v="a &amp; b"/></node>
<node id="2" lat="-0.0000001" lon="179.9999999"/>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="9"/><tag k="highway" v="path"/></way>
<relation id="5"><member type="way" ref="7" role="outer"/><member type="node" ref="1" role=""/></relation>
</osm>
"""


def test_xml(spark, tmp_path):
    path = tmp_path / "small.osm"
    path.write_text(XML)
    nodes = {r.osm_id: r for r in osm_xml.nodes(spark, str(path)).collect()}
    assert (nodes[1].lon, nodes[1].lat) == (-1220279745, 370491457)
    assert [(t.k, t.v) for t in nodes[1].tags] == [("amenity", "bench"), ("note", "a & b")]
    assert (nodes[2].lon, nodes[2].lat, nodes[2].tags) == (1799999999, -1, [])
    assert osm_xml.ways(spark, str(path)).first().refs == [1, 2, 9]
    _, members = osm_xml.relations(spark, str(path))
    assert [(m.type, m.ref, m.role) for m in members.orderBy("pos").collect()] == [("way", 7, "outer"), ("node", 1, "")]


def vint(n):
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return n << 1 ^ n >> 63


def number(k, n):
    return vint(k << 3) + vint(n)


def blob(k, data):
    return vint(k << 3 | 2) + vint(len(data)) + data


def pack(k, values):
    return blob(k, b"".join(map(vint, values)))


def delta(values):
    return [zig(b - a) for a, b in zip([0, *values], values)]


def block(kind, data, squeeze=True):
    body = number(2, len(data)) + blob(3, zlib.compress(data)) if squeeze else blob(1, data)
    head = blob(1, kind.encode()) + number(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf(spark, tmp_path):
    strings = blob(1, b"".join(blob(1, s) for s in (b"", b"kind", b"tree", b"name", b"Ash", b"outer")))
    box = b"".join(number(k, zig(v)) for k, v in ((1, -1220279745123), (2, 5), (3, 9), (4, -7)))
    header = blob(1, box) + blob(16, b"writer") + number(33, 4)
    dense = pack(1, delta([10, 11, 15])) + pack(8, delta([370491457, -5, 7])) + pack(9, delta([-1220279745, 6, 8])) + pack(10, [1, 2, 0, 0, 3, 4, 1, 2, 0])
    way = number(1, 70) + pack(2, [3]) + pack(3, [4]) + pack(8, delta([10, 11, 99]))
    relation = number(1, 80) + pack(8, [5, 0]) + pack(9, delta([70, 10])) + pack(10, [1, 0])
    path = tmp_path / "small.pbf"
    path.write_bytes(
        block("OSMHeader", header) + block("OSMData", strings + blob(2, blob(2, dense))) + block("OSMData", strings + blob(2, blob(3, way)) + blob(2, blob(4, relation)), False)
    )
    spark.dataSource.register(osm_pbf.OsmPbf)

    def read(kind):
        return spark.read.format("osm_pbf").option("kind", kind).load(str(path))

    nodes = {r.osm_id: r for r in read("nodes").collect()}
    assert (nodes[10].lon, nodes[10].lat) == (-1220279745, 370491457)
    assert [(t.k, t.v) for t in nodes[15].tags] == [("name", "Ash"), ("kind", "tree")] and nodes[11].tags == []
    assert read("ways").first().refs == [10, 11, 99]
    assert [(m.type, m.ref, m.role) for m in read("relations").first().members] == [("way", 70, "outer"), ("node", 10, "")]
    head = read("header").first()
    assert (head.bbox_left, head.bbox_right, head.writingprogram, head.replication_sequence_number) == (-12202797451, 0, "writer", 4)
    assert osm_pbf.granularities(spark, str(path)) == 100
    assert [(r.type, r.granularity) for r in osm_pbf.blocks(spark, str(path)).collect()] == [("header", None), ("nodes", 100), ("ways", 100)]
    whole = osm_pbf.block_index(str(path))
    path.write_bytes(path.read_bytes() + b"\0\0\0\3xyz and no block")
    with pytest.warns(UserWarning, match="no block"):
        assert osm_pbf.block_index(str(path)) == whole
    path.write_bytes(path.read_bytes()[: whole[-1].start + 3])
    with pytest.warns(UserWarning, match="ends within"):
        assert osm_pbf.block_index(str(path)) == whole[:-1]
    with pytest.raises(ValueError, match="plain nodes"):
        list(osm_pbf.data_rows(strings + blob(2, blob(1, b"")), "nodes"))


def test_manifest(tmp_path):
    text = "render: {leaf_zoom: 12, layer_order: [A]}\nlayers: {A: [x], B: [x, y]}\nrules: {x: {minzoom: 0, tags: [[admin_level, 2]], values: ['yes']}}\nreport_options: [include_strings, what]\n"
    (tmp_path / "manifest.yaml").write_text(text)
    m = manifest.load(str(tmp_path))
    assert m.rules["x"].tags == (("admin_level", "2"),) and m.rules["x"].values == ("yes",)
    assert m.warnings == ["unknown report option: what"]
    manifest.save(m, str(tmp_path / "out"))
    again = manifest.load(str(tmp_path / "out"))
    assert again.rules == m.rules and again.layers == m.layers
    with pytest.raises(ValueError):
        manifest.parse({"render": {"leaf_zoom": 7}})


def test_rule_precedence(spark):
    raw = {
        "render": {"leaf_zoom": 8, "layer_order": []},
        "rules": {"a": {"minzoom": 0, "keys": ["k1"]}, "b": {"minzoom": 0, "values": ["v2"]}, "c": {"minzoom": 0, "tags": [["k3", "v3"]]}, "d": {"minzoom": 0, "tags": [["k3", "v3"]]}},
    }
    m = manifest.parse(raw)
    rows = [("node", 1, [("k1", "x"), ("k2", "v2"), ("k3", "v3")]), ("node", 2, [("k1", "x"), ("k2", "v2")]), ("node", 3, [("k1", "x")]), ("node", 4, [])]
    df = spark.createDataFrame(rows, "kind string, osm_id long, tags array<struct<k:string,v:string>>")
    got = {r.osm_id: r.rule for r in rules.classify(df, m).collect()}
    assert got == {1: "d", 2: "b", 3: "a", 4: "no_rule"}


FOUR = [(137747, -1220279745, 370491457), (137750, -1220267360, 369514859), (137752, -1220267093, 369514589), (137754, -1220268977, 369495675)]
RULES = """
data: {source: four.osm, planet: out}
render: {leaf_zoom: 12, layer_order: [Paths, Areas]}
layers: {Paths: [path], Areas: [area]}
rules: {path: {minzoom: 4, keys: [path], include: {Keys: [path]}}, area: {minzoom: 0, tags: [[type, area]], include: All}}
"""


def four(tmp_path):
    nodes = "".join(f'<node id="{i}" lon="{lon / 1e7:.7f}" lat="{lat / 1e7:.7f}"><tag k="n" v="{i}"/></node>' for i, lon, lat in FOUR)
    way = '<way id="7"><nd ref="137747"/><nd ref="137754"/><tag k="path" v="yes"/></way>'
    relation = '<relation id="5"><member type="way" ref="7" role=""/><member type="node" ref="137752" role=""/><tag k="type" v="area"/><tag k="type" v="twice"/></relation>'
    (tmp_path / "four.osm").write_text(f"<osm>{nodes}{way}{relation}</osm>")
    (tmp_path / "manifest.yaml").write_text(RULES)
    return manifest.load(str(tmp_path))


def test_archive(spark, tmp_path):
    from quadrille.operators import document
    from quadrille.sources import archive

    m = four(tmp_path)
    archive.build(spark, m)
    found = archive.open_(spark, m.planet)
    assert found.manifest.rules == m.rules
    mean = (3660422102463285814 + 3660407336235658654) // 2 >> 40  # of the relation's members
    leaves = [(r.tile_h, r.n, r.w, r.r) for r in found.leaves.orderBy("tile_h").collect()]
    assert leaves == [(3329120, 1, 0, 0), (3329121, 2, 0, 0), (mean, 0, 0, 1), (3329134, 1, 1, 0)]
    assert found.find(12, 3329121).count() == 1 and found.find(12, 3329122).count() == 0
    assert found.find(11, 3329121 >> 2).count() == 0 and found.find(14, 3329121 << 4).count() == 0
    root = found.find(0, 0).first()
    assert (root.z, root.tile_h, root.children) == (0, 0, 1)
    above = found.find(10, 3329121 >> 4).first()
    assert above.children == 4 and above.mask == sum(1 << (h & 15) for h in (3329120, 3329121, mean, 3329134))

    def shown(z, h):
        return sorted((r.kind, r.osm_id) for r in found.compose(z, h).collect())

    # the way reaches into the leaf of its last node, the relation into those of its members
    assert shown(12, mean) == [("relation", 5)]
    assert shown(12, 3329120) == [("node", 137754), ("way", 7)]
    assert shown(12, 3329121) == [("node", 137750), ("node", 137752), ("relation", 5)]
    assert shown(12, 3329134) == [("node", 137747), ("relation", 5), ("way", 7)]
    assert shown(4, 3329121 >> 16) == [("relation", 5), ("way", 7)] and shown(0, 0) == [("relation", 5)]
    assert shown(3, 3329121 >> 18) == []
    layers = found.tile(12, 3329134).first().layers
    assert [(x.name, [f.osm_id for f in x.features]) for x in layers] == [("no_rule", [137747]), ("Paths", [7]), ("Areas", [5])]
    area = layers[2].features[0]
    assert list(zip(area["keys"], area["values"])) == [("rule", "area"), ("osm_id", "5"), ("type", "area"), ("type", "twice")]
    # of equal keys the last counts where properties are a map
    rows = {r.id: r.properties for r in document.decoded(found.tile(12, 3329134)).collect()}
    assert {"rule": "area", "osm_id": "5", "type": "twice"} in rows.values()
    plan = found.find(12, 3329121)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tile_h,3329121)" in plan
    plan = found.compose(4, 3329121 >> 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(tile_h," in plan


def test_archive_twice_and_rules_fallback(spark, tmp_path):
    from quadrille.sources import archive

    m = four(tmp_path)
    archive.build(spark, m)
    again = archive.build(spark, m)
    assert again.leaves.count() == 4
    assert rules.open_saved(m.planet).rules == m.rules
    assert rules.open_saved(str(tmp_path / "nowhere")).rules == {}
    (tmp_path / "rules.json").write_text("{")
    assert rules.open_saved(str(tmp_path)).leaf_zoom == 12


def test_polygons(spark):
    from pyspark.sql import functions as F

    from quadrille.operators import document

    def ring(x, y, n, back=False):
        points = [(x, y), (x, y + n), (x + n, y + n), (x + n, y), (x, y)]
        return points[::-1] if back else points

    rings = [ring(0, 0, 100), ring(10, 10, 5, True), ring(30, 30, 5, True), ring(200, 0, 50), ring(210, 10, 5, True)]
    df = spark.createDataFrame([(rings,), ([ring(0, 0, 9)],)], "g array<array<struct<x:int,y:int>>>")
    first, second = (r.p for r in df.select(document.polygons(F.col("g")).alias("p")).collect())
    assert [[tuple(map(tuple, q)) for q in p] for p in first] == [[tuple(rings[0]), tuple(rings[1]), tuple(rings[2])], [tuple(rings[3]), tuple(rings[4])]]
    assert len(second) == 1 and len(second[0]) == 1


def test_written_tiles_and_reports(spark, tmp_path):
    import datetime
    import json

    from quadrille.operators import document
    from quadrille.sources import archive

    found = archive.build(spark, four(tmp_path))
    docs = found.tile(12, 3329134).unionByName(found.tile(12, 3329120))
    document.write_tiles(docs, 12, str(tmp_path / "tiles"))
    back = spark.read.json(str(tmp_path / "tiles"))
    assert sorted((r.z, r.tile_h) for r in back.select("z", "tile_h").collect()) == [(12, 3329120), (12, 3329134)]
    path = document.write_report(docs, ("include_strings", "lookup_strings_and_values", "include_features"), str(tmp_path), datetime.datetime(2020, 1, 2, 3, 4, 5))
    assert path.endswith("report-2020-01-02_03-04-05")
    told = [json.loads(r.value) for r in spark.read.text(path).collect()]
    last = next(t for t in told if t["tile"] == 3329134)
    assert [x["name"] for x in last["layers"]] == ["no_rule", "Paths", "Areas"] and "geometries" not in last["layers"][0]["features"][0]
    assert last["layers"][1]["features"][0]["keys"] == ["rule", "path"] and set(last["strings"]) >= {"rule", "path", "yes", "Areas"}
    short = document.report(docs).first().report
    assert "features" not in short and "strings" not in short
