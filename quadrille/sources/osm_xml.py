"""Map entities from OSM XML files, by Spark's own xml source with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"


def _rows(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).schema(schema).load(path)


def _tags():
    return F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"].alias("k"), t["_v"].alias("v")))


def _fixed(name: str):
    """Degrees as text to whole 1e-7 degrees, by decimal arithmetic."""
    return (F.col(name).cast("decimal(12,7)") * 10000000).cast("int")


def nodes(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path, "node", f"_id LONG, _lat STRING, _lon STRING, {TAGS}")
    return rows.select(F.col("_id").alias("osm_id"), _fixed("_lon").alias("lon"), _fixed("_lat").alias("lat"), _tags().alias("tags"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path, "way", f"_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, {TAGS}")
    return rows.select(F.col("_id").alias("osm_id"), F.coalesce("nd._ref", F.array().cast("array<long>")).alias("refs"), _tags().alias("tags"))


def relations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(relations, members)."""
    rows = _rows(spark, path, "relation", f"_id LONG, member ARRAY<STRUCT<_type: STRING, _ref: LONG, _role: STRING>>, {TAGS}")
    members = rows.select(F.col("_id").alias("relation"), F.posexplode("member").alias("pos", "m"))
    members = members.select("relation", F.col("pos").cast("long").alias("pos"), F.col("m._type").alias("type"), F.col("m._ref").alias("ref"), F.col("m._role").alias("role"))
    return rows.select(F.col("_id").alias("osm_id"), _tags().alias("tags")), members
