"""Incremental builds: entities that arrive as files update the leaf counts.

The engine this repository re-expresses has no streams of its own; this module only lets the same expressions run
on a stream of new nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geo, hilbert


def leaf_counts(nodes: DataFrame, leaf_zoom: int) -> DataFrame:
    """tile_h, n of a stream (or table) of nodes with lon and lat in 1e-7 degrees; update or complete mode."""
    located = geo.with_location(nodes, F.col("lon"), F.col("lat"))
    return located.groupBy(hilbert.at_zoom(F.col("h"), leaf_zoom).alias("tile_h")).agg(F.count(F.lit(1)).alias("n"))
