"""Golden values of the curve, the projection and the tile algebra."""

import random

from pyspark.sql import functions as F

from quadrille.functions import geo, hilbert, tile


def textbook(x, y):
    d, s = 0, 1 << 31
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d = d * 4 + (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = (1 << 32) - 1 - x, (1 << 32) - 1 - y
            x, y = y, x
        s >>= 1
    return d - (1 << 64) if d >> 63 else d


def test_curve_goes_there_and_back(spark):
    rnd = random.Random(5)
    points = [(rnd.getrandbits(32), rnd.getrandbits(32)) for _ in range(300)] + [(0, 0), ((1 << 32) - 1, 0), ((1 << 32) - 1,) * 2]
    df = spark.createDataFrame(points, "x long, y long")
    out = hilbert.with_xy(hilbert.with_h(df, F.col("x"), F.col("y")), F.col("h"), "bx", "by").collect()
    for r in out:
        assert r.h == textbook(r.x, r.y)
        assert (r.bx, r.by) == (r.x, r.y)


def test_filters_on_h_plan_quickly(spark):
    df = hilbert.with_h(spark.range(10).select(F.col("id").alias("a")), F.col("a"), F.col("a"))
    assert df.filter("h IS NOT NULL AND h >= 0").count() == 10


def test_addresses(spark):
    cases = [(9, 82, 199, 52017), (12, 659, 1593, 3329134), (12, 660, 1594, 3329140), (0, 0, 0, 0), (1, 1, 0, 3), (32, (1 << 32) - 1, 0, -1)]
    df = spark.createDataFrame(cases, "z int, x long, y long, want long")
    out = tile.with_tile_xy(tile.with_tile_h(df, F.col("z"), F.col("x"), F.col("y")), F.col("z"), F.col("h"), "bx", "by").collect()
    for r in out:
        assert r.h == r.want and (r.bx, r.by) == (r.x, r.y)


def test_projection(spark):
    df = spark.createDataFrame([(0, 0), (-1800000000, 900000000), (1800000000, -900000000), (-1220279745, 370491457)], "lon int, lat int")
    located = geo.with_location(df, F.col("lon"), F.col("lat"))
    lon, lat = geo.xy_to_lonlat(F.col("x"), F.col("y"))
    rows = [tuple(r) for r in located.select("x", "y", "h", lon.alias("a"), lat.alias("b")).collect()]
    top = (1 << 32) - 1
    assert rows[0][:2] == (1 << 31, 1 << 31)
    assert rows[1] == (0, 0, 0, -1800000000, 850511287)
    assert rows[2][:2] == (top, top)
    assert rows[3][:3] == (691633204, 1670996018, 3660422102463285814)


def test_extent_center_mask(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (30, 0), (31, 0), (32, 0)], "z int, x long")
    rows = df.select("z", tile.extent(F.col("z")).alias("e"), tile.center(F.col("z"), F.lit(0)).alias("c")).collect()
    assert [(r.e, r.c) for r in rows] == [((1 << 32) - 1, (1 << 31) - 1), ((1 << 31) - 1, (1 << 30) - 1), (3, 1), (1, 0), (0, 0)]
    mask = spark.range(1).select((tile.child_mask(F.lit(5)).bitwiseOR(tile.child_mask(F.lit(15)))).alias("m"), tile.child_rank(F.lit(32800), F.lit(15)).alias("r")).first()
    assert (mask.m, mask.r) == (32800, 1)


def test_unsigned_order(spark):
    values = [0, (1 << 63) - 1, -(1 << 63), -1]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "h long")
    assert [r.h for r in df.orderBy(hilbert.ordered(F.col("h"))).collect()] == values
    wide = df.select(hilbert.from_unsigned(hilbert.unsigned(F.col("h"))).alias("b"), "h")
    assert all(r.b == r.h for r in wide.collect())
