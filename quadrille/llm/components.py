"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import ensure_checkpoint_dir


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, component), component being the smallest node reached; only linked nodes.

    Large-star and small-star passes alternate until every edge points to its component's smallest node:
    O(log^2) passes, each an aggregation by node that is combined before the shuffle. Passes are
    checkpointed in the shared folder. The driver sees only counts.
    """
    ensure_checkpoint_dir(links.sparkSession)
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = links.filter("a <> b").select(a, b).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        edges = (
            small.filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
            .checkpoint()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
