"""A finished build as Parquet: written once, opened again, and asked for single tiles.

    archive.build(spark, manifest)             # from the manifest's source to its planet folder
    found = archive.open_(spark, folder)
    found.find(z, tile_h)                      # the tile's index row, if it exists
    found.compose(z, tile_h)                   # what it shows

Tables are clustered along the curve: range partitions by the order of h, sorted within, so files and row groups hold
ranges of h and a lookup reads the few that can hold it. Tables of several zooms are partitioned by z.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geo, hilbert
from quadrille.operators import content, document, index, locate, rules
from quadrille.session import ensure_checkpoint_dir
from quadrille.sources import manifest as manifests
from quadrille.sources import osm_pbf, osm_xml
from quadrille.sources.manifest import Manifest
from quadrille.sources.star import Planet

FEATURE = "kind", "osm_id", "h", "rule", "props", "path"


def planet_of(spark: SparkSession, source: str) -> Planet:
    """The located tables of an OSM file (or files): XML if the name ends so, else PBF."""
    ensure_checkpoint_dir(spark)
    if source.endswith((".osm", ".xml")):
        nodes, ways = osm_xml.nodes(spark, source), osm_xml.ways(spark, source)
        relations, members = osm_xml.relations(spark, source)
    else:
        spark.dataSource.register(osm_pbf.OsmPbf)
        nodes, ways, whole = (spark.read.format("osm_pbf").option("kind", k).load(source) for k in ("nodes", "ways", "relations"))
        relations = whole.select("osm_id", "tags")
        members = whole.select(F.col("osm_id").alias("relation"), F.posexplode("members").alias("pos", "m"))
        members = members.select("relation", F.col("pos").cast("long").alias("pos"), "m.type", "m.ref", "m.role")
    located = geo.with_location(nodes, F.col("lon"), F.col("lat")).checkpoint()
    return Planet(located, ways.checkpoint(), relations, members.checkpoint())


def write(spark: SparkSession, planet: Planet, m: Manifest, folder: str, partitions: int | None = None) -> None:
    """All tables of a build, replacing those of an earlier one, with the manifest and its rules."""
    width = partitions or planet.width
    z = m.leaf_zoom
    located = planet.located

    def ruled(rows: DataFrame) -> DataFrame:
        return content.drop_untagged_nodes(rules.classify(rows, m)).join(F.broadcast(rules.evals(spark, m)), "rule")

    whole, related = ruled(content.whole(planet, z)), ruled(content.related(planet, z))
    order = ("z", "tile_h", "kind", "osm_id")
    at_leaf = whole.select(F.lit(z).alias("z"), F.explode("tiles").alias("tile_h"), "kind", "osm_id", F.col("h").alias("at"))
    at_leaf = at_leaf.unionByName(related.select(F.lit(z).alias("z"), "tile_h", "kind", "osm_id", F.col("h").alias("at")))
    above = content.tile_content(whole.withColumn("at", F.col("h")), related.withColumn("at", F.col("h")), z)
    placed = above.select(*order, "at").unionByName(at_leaf.select(*order, "at")).withColumnRenamed("at", "h")
    own = related.filter(F.col("tile_h") == hilbert.at_zoom(F.col("h"), z))  # a relation's row for its own leaf
    features = whole.drop("tiles").unionByName(own.drop("tile_h"))
    point = lambda q: F.struct(*[v.alias(c) for v, c in zip(locate.unpacked(q), "xy")])
    features = content.project_tags(features, m.all_tags).withColumn("path", F.transform("p", point))
    leaves = index.leaf_index(located, z)

    def save(rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")

    save(index.clustered(features.select(*FEATURE), width).drop("h_ord"), "features")
    save(leaves.repartitionByRange(width, "tile_h").sortWithinPartitions("tile_h"), "leaves")
    save(index.tile_tree(leaves, z).repartitionByRange(width, "z", "h").sortWithinPartitions("z", "h"), "tiles", "z")
    save(placed.repartitionByRange(width, *order).sortWithinPartitions(*order), "content", "z")
    if "://" not in folder and not folder.startswith("file:"):  # beside the tables, where the driver sees the folder
        manifests.save(m, folder)
        rules.save(m, folder)


def build(spark: SparkSession, m: Manifest) -> Archive:
    """From the manifest's source to its planet folder, and open."""
    write(spark, planet_of(spark, m.source), m, m.planet)
    return open_(spark, m.planet)


@dataclass
class Archive:
    manifest: Manifest
    leaves: DataFrame  # tile_h, n, w, r, first_n, first_w, first_r
    tiles: DataFrame  # z, h, mask, children, first_child
    content: DataFrame  # z, tile_h, kind, osm_id, h
    features: DataFrame  # kind, osm_id, h, rule, props, path

    def find(self, z: int, tile_h: int) -> DataFrame:
        """z, tile_h, mask, children of a tile of the pyramid, or of a leaf (without children); no row if there is none."""
        leaf = self.manifest.leaf_zoom
        columns = F.lit(z).alias("z"), F.col("tile_h"), F.col("mask"), F.col("children")
        if z == leaf:
            rows = self.leaves.filter(F.col("tile_h") == tile_h).withColumns({"mask": F.lit(0), "children": F.lit(0).cast("long")})
            return rows.select(*columns)
        rows = self.tiles.filter((F.col("z") == z) & (F.col("h") == tile_h)).withColumnRenamed("h", "tile_h")
        return rows.select(*columns) if z % 2 == 0 and z < leaf else rows.filter(F.lit(False)).select(*columns)

    def compose(self, z: int, tile_h: int) -> DataFrame:
        """kind, osm_id, h of what a tile shows; nothing for odd or too deep zooms."""
        return self.content.filter((F.col("z") == z) & (F.col("tile_h") == tile_h)).select("kind", "osm_id", "h")

    def tile(self, z: int, tile_h: int) -> DataFrame:
        """tile_h, layers: the tile's document. Of the features only files and row groups with the shown h are read."""
        shown = self.compose(z, tile_h).withColumn("tile_h", F.lit(tile_h).cast("long"))
        found = document.in_tile_units(shown.join(self.features, ["h", "kind", "osm_id"]).withColumn("id", F.col("h")), z)
        return document.documents(found, rules.layer_rules(shown.sparkSession, self.manifest))


def tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}") for name in ("leaves", "tiles", "content", "features")]


def open_(spark: SparkSession, folder: str) -> Archive:
    """An archive that was written before, with its manifest; without one, with the rules it was built with."""
    m = manifests.load(folder) if (Path(folder) / "manifest.yaml").exists() else rules.open_saved(folder)
    return Archive(m, *tables(spark, folder))
