"""Tiles as columns z, x, y, h: addresses, relatives, extents, projection and curve bearing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import hilbert

EXTENT = 8192.0
LOW, HIGH = -16384.0, 16383.0


def shl(v: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", v.cast("long"), bits.cast("int"))


def shr(v: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", v.cast("long"), bits.cast("int"))


def with_tile_h(df: DataFrame, z: Column, x: Column, y: Column, name: str = "h") -> DataFrame:
    """``df`` with the h at zoom z of a tile address."""
    df = hilbert.with_h(df.withColumn("_z", z), shl(x, 32 - z), shl(y, 32 - z), name)
    return df.withColumn(name, hilbert.prefix(F.col(name), F.col("_z"))).drop("_z")


def with_tile_xy(df: DataFrame, z: Column, h: Column, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with the address at zoom z of a tile's h."""
    df = hilbert.with_xy(df.withColumn("_z", z), hilbert.full(h, z), x, y)
    return df.withColumns({x: shr(F.col(x), 32 - F.col("_z")), y: shr(F.col(y), 32 - F.col("_z"))}).drop("_z")


def tile_id(z: Column, h: Column) -> Column:
    """A number below 2^52: z and h, or h alone once it passes 47 bits (h as an unsigned number)."""
    wide = hilbert.unsigned(h)
    return F.when(wide > 140737488355327, (wide % F.lit(4503599627370495).cast("decimal(20,0)")).cast("long")).otherwise(
        F.shiftleft(z.cast("long"), 47).bitwiseOR(h)
    )


def origin(z: Column, v: Column) -> Column:
    return shl(v, 32 - z)


def extent(z: Column) -> Column:
    return F.when(z == 32, F.lit(0).cast("long")).otherwise(shr(F.lit(4294967295), z))


def center(z: Column, v: Column) -> Column:
    return origin(z, v) + F.shiftright(extent(z), 1)


def label(z: Column, x: Column, y: Column, h: Column) -> Column:
    return F.concat(h.cast("string"), F.lit(" "), F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")))


def children(z: Column, x: Column, y: Column) -> Column:
    """NW, SW, SE, NE."""
    corners = ((0, 0), (0, 1), (1, 1), (1, 0))
    return F.array(*[F.struct((z + 1).alias("z"), (x * 2 + a).alias("x"), (y * 2 + b).alias("y")) for a, b in corners])


def grandchildren(z: Column, x: Column, y: Column) -> Column:
    """All sixteen, child by child."""
    corners = ((0, 0), (0, 1), (1, 1), (1, 0))
    return F.array(
        *[
            F.struct((z + 2).alias("z"), (x * 4 + 2 * a + c).alias("x"), (y * 4 + 2 * b + d).alias("y"))
            for a, b in corners
            for c, d in corners
        ]
    )


def project(z: Column, tile: Column, location: Column) -> Column:
    """A grid coordinate in the tile's 8192 units, cut to what a SMALLINT can hold, towards zero."""
    scaled = (location.cast("double") / 4294967296.0) * (F.pow(F.lit(2.0), z) * EXTENT) - tile.cast("double") * EXTENT
    return F.least(F.greatest(scaled, F.lit(LOW)), F.lit(HIGH)).cast("int").cast("smallint")


def with_bearing(df: DataFrame, name: str = "bearing") -> DataFrame:
    """``df`` (z, x, y, h) with the sides by which the curve enters and leaves the tile, as two letters or null.

    Missing neighbours and a missing predecessor are null and compare as equal.
    """
    z, x, y = F.col("z"), F.col("x").cast("long"), F.col("y").cast("long")
    side = shl(F.lit(1), z)
    places = {
        "_n": (y != 0, x, y - 1), "_w": (x != 0, x - 1, y), "_s_": (y + 1 < side, x, y + 1), "_e": (x + 1 < side, x + 1, y)
    }
    for column, (there, px, py) in places.items():
        df = with_tile_h(df, z, F.when(there, px), F.when(there, py), column)
    way = bearing_of(F.col("h"), *(F.col(c) for c in places))
    return df.withColumn(name, way).drop(*places)


def bearing_of(h: Column, n: Column, w: Column, s: Column, e: Column) -> Column:
    """``bearing`` from the neighbours' h."""
    before = F.when(h != 0, h - 1)
    after = h + 1
    sides = {"N": n, "W": w, "S": s, "E": e}
    plan = (("N", "WSE", None), ("W", "SEN", "WE"), ("S", "ENW", "SN"), ("E", "NWS", None))
    out = None
    for into, exits, otherwise in plan:
        way = None
        for k in exits:
            test = sides[k].eqNullSafe(after)
            way = F.when(test, into + k) if way is None else way.when(test, into + k)
        way = way.otherwise(otherwise) if otherwise else way
        test = sides[into].eqNullSafe(before)
        out = F.when(test, way) if out is None else out.when(test, way)
    return out


def child_mask(h: Column) -> Column:
    """The bit of a tile in its parent's mask of sixteen."""
    return F.call_function("shiftleft", F.lit(1), h.bitwiseAND(15).cast("int"))


def child_rank(mask: Column, place: Column) -> Column:
    """How many present children come before the one at ``place``."""
    return F.bit_count(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), place.cast("int")) - 1))
