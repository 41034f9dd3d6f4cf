"""Map entities derived from the star-schema tables by integer arithmetic.

nodes: supplier, customer, part; ways: orders (through their line items' suppliers); relations: nations
and regions. Suppliers whose key is a multiple of 17 are left out, so some references don't resolve.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geo
from quadrille.operators import locate
from quadrille.session import ensure_checkpoint_dir, stored, table
from quadrille.sources.manifest import STAR

#: Rows of a task in which points are joined and grouped: some hundred MB of its memory.
PER_TASK = 500_000
NODE_COLUMNS = ("osm_id", "lon", "lat", "tags")


def tag(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))


def place(cluster: Column, key: Column, group: int) -> tuple[Column, Column]:
    """Fixed-point degrees of the key-th node of a cluster."""

    def spread(factor: int, step: int, size: int) -> Column:
        # the key is reduced first: the product stays in range for any key
        return ((key % size) * factor + group * step) % size

    lon = F.lit(-1700000000) + (cluster % 5) * 700000000 + spread(2654435761, 17000001, 100000000)
    lat = F.lit(-600000000) + F.floor(cluster / 5) * 250000000 + spread(2654404609, 9000001, 50000000)
    return lon.cast("int"), lat.cast("int")


def _nodes(df: DataFrame, key: str, cluster: Column, group: int, tags: Column) -> DataFrame:
    key = F.col(key).cast("long")
    lon, lat = place(cluster.cast("long") % 25, key, group)
    return df.select((key + group * 1000000000).alias("osm_id"), lon.alias("lon"), lat.alias("lat"), tags.alias("tags"))


@dataclass
class Planet:
    """The tables of one build. ``members`` are rows, not arrays: a relation may have any number."""

    nodes: DataFrame  # osm_id, lon, lat, tags, x, y, h
    ways: DataFrame  # osm_id, refs, tags
    relations: DataFrame  # osm_id, tags
    members: DataFrame  # relation, pos, type, ref, role

    @cached_property
    def way_points(self) -> DataFrame:
        return locate.way_points(self.ways, self.nodes)

    @cached_property
    def rows(self) -> int:
        """How many nodes, ways and references there are."""
        refs = self.ways.agg(F.count(F.lit(1)), F.sum(F.size("refs"))).first()
        return self.nodes.count() + refs[0] + (refs[1] or 0)

    @cached_property
    def width(self) -> int:
        """Tasks for what moves all points: as many as the session's shuffles have, more where a task would get over PER_TASK rows."""
        return max(int(self.members.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.rows // PER_TASK))

    @cached_property
    def way_parts(self) -> DataFrame:
        """osm_id, tags, h, p, hs of ``locate.way_parts``."""
        return stored(locate.way_parts(self.ways, self.nodes, self.width))

    @cached_property
    def way_h(self) -> DataFrame:
        return self.way_parts.select("osm_id", "h")

    @cached_property
    def member_places(self) -> DataFrame:
        """relation, h of the members that are nodes or ways."""
        return stored(locate.member_places(self.members, self.nodes, self.way_h, self.width))

    @cached_property
    def relation_h(self) -> DataFrame:
        return locate.relation_locations(self.members, self.nodes, self.way_h, self.member_places).checkpoint()

    @cached_property
    def located(self) -> DataFrame:
        """kind, osm_id, h of every entity that has a place."""
        parts = (("node", self.nodes), ("way", self.way_h), ("relation", self.relation_h))
        rows = [df.select(F.lit(kind).alias("kind"), "osm_id", "h") for kind, df in parts]
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("h IS NOT NULL")

    @cached_property
    def tagged(self) -> DataFrame:
        """kind, osm_id, tags of every entity."""
        parts = (("node", self.nodes), ("way", self.ways), ("relation", self.relations))
        rows = [df.select(F.lit(kind).alias("kind"), "osm_id", "tags") for kind, df in parts]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with tags, without their grid location."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").filter("s_suppkey % 17 <> 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part")
    none = F.filter(F.array(tag("", F.lit(""))), lambda t: F.lit(False))
    parts = F.when(F.col("p_size") < 10, none).otherwise(F.array(tag("type", F.col("p_type")), tag("brand", F.col("p_brand"))))
    rows = _nodes(supplier, "s_suppkey", F.col("s_nationkey"), 1, F.array(tag("kind", F.lit("supplier")), tag("nation", F.col("n_name"))))
    customer = F.array(tag("kind", F.lit("customer")), tag("segment", F.col("c_mktsegment")))
    rows = rows.unionByName(_nodes(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey"), 2, customer))
    return rows.unionByName(_nodes(part, "p_partkey", F.col("p_size"), 3, parts))


def ways(spark: SparkSession, sf_dir: str, width: int | None = None) -> DataFrame:
    """``width``: the number of tasks that gather line items, if not the session's."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "l_partkey").alias("item"))
    if width:
        orders, items = orders.repartition(width, "o_orderkey"), items.repartition(width, "l_orderkey")
    lists = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    refs = F.transform(F.coalesce("items", F.filter(F.array(F.struct(F.lit(0).alias("l_linenumber"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(0).cast("long").alias("l_partkey"))), lambda i: F.lit(False))), lambda i: i["l_suppkey"].cast("long") + 1000000000)
    joined = orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("refs", refs)
    ring = (F.col("o_custkey") % 5 == 0) & (F.size("refs") > 0)
    return joined.select(
        F.col("o_orderkey").cast("long").alias("osm_id"),
        F.when(ring, F.concat("refs", F.slice("refs", 1, 1))).otherwise(F.col("refs")).alias("refs"),
        F.array(tag("priority", F.col("o_orderpriority")), tag("status", F.col("o_orderstatus"))).alias("tags"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")

    def rows(df: DataFrame, key: Column, kind: str, name: str) -> DataFrame:
        return df.select(key.cast("long").alias("osm_id"), F.array(tag("type", F.lit(kind)), tag("name", F.col(name))).alias("tags"))

    return rows(nation, F.col("n_nationkey") + 1, "multipolygon", "n_name").unionByName(
        rows(region, F.col("r_regionkey") + 1000, "boundary", "r_name")
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, pos, type, ref, role; pos orders a relation's members of one type."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nation = table(spark, sf_dir, "nation")

    def rows(df: DataFrame, relation: Column, kind: str, ref: Column, role: str) -> DataFrame:
        return df.select(
            relation.cast("long").alias("relation"), ref.cast("long").alias("pos"), F.lit(kind).alias("type"),
            ref.cast("long").alias("ref"), F.lit(role).alias("role"),
        )

    owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return (
        rows(customer, F.col("c_nationkey") + 1, "node", F.col("c_custkey") + 2000000000, "customer")
        .unionByName(rows(owned, F.col("c_nationkey") + 1, "way", F.col("o_orderkey"), "order"))
        .unionByName(rows(nation, F.col("n_regionkey") + 1000, "relation", F.col("n_nationkey") + 1, "nation"))
    )


def nested_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``members``, and relations above the regions: four levels, a member that is missing, a cycle and one that waits for it."""
    more = [(2000, 1, "relation", r, "region") for r in range(1000, 1005)] + [
        (2000, 2, "node", 2000000001, "customer"), (3000, 1, "relation", 2000, "world"), (3000, 2, "relation", 1, "nation"), (3000, 3, "relation", 9999, "lost"),
        (4000, 1, "relation", 3000, "universe"), (5001, 1, "relation", 5002, "ring"), (5001, 2, "node", 2000000002, "customer"), (5002, 1, "relation", 5001, "ring"),
        (6000, 1, "relation", 5001, "ring"), (6000, 2, "node", 2000000003, "customer"), (7000, 1, "relation", 9999, "lost"), (8000, 1, "relation", 7000, "empty"),
    ]
    return members(spark, sf_dir).unionByName(spark.createDataFrame(more, "relation long, pos long, type string, ref long, role string"))


class Built(Planet):
    """The star tables' planet; each located part is written to the checkpoint folder when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.relations, self.members = relations(spark, sf_dir), members(spark, sf_dir)

    @cached_property
    def nodes(self) -> DataFrame:
        return stored(geo.with_location(nodes(self.spark, self.sf_dir), F.col("lon"), F.col("lat")))

    @cached_property
    def ways(self) -> DataFrame:
        return ways(self.spark, self.sf_dir, self.width)

    @cached_property
    def rows(self) -> int:
        """Of the tables; their files say it."""
        return sum(table(self.spark, self.sf_dir, name).count() for name in ("supplier", "customer", "part", "orders", "lineitem"))


_built: dict[tuple[str, str], Built] = {}


def planet(spark: SparkSession, sf_dir: str) -> Planet:
    """The located entities, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        _built[key] = Built(spark, sf_dir)
    return _built[key]


def forget() -> None:
    """Lets go of all that this session has built."""
    _built.clear()
    _archives.clear()


_archives: dict[tuple[str, str], object] = {}


def archive(spark: SparkSession, sf_dir: str):
    """The build of ``planet`` as an opened archive, written once per session beside the checkpoints."""
    from quadrille.sources import archive as archives  # which builds on this module

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _archives:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/archive-{spark.sparkContext.applicationId}-{len(_archives)}"
        archives.write(spark, planet(spark, sf_dir), STAR, folder)
        _archives[key] = archives.Archive(STAR, *archives.tables(spark, folder))
    return _archives[key]
