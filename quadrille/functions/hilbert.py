"""The Hilbert curve of order 32 as bit operations on whole words.

The orientation at each level is a product of the levels above, so all levels are found together by a
parallel prefix product: five rounds of shifts and masks for 32 levels. Each round is a projection; the planner keeps
them apart because a round's values are used several times in the next, and all of it is generated code: no lambda, no
table, no Python.

h is an unsigned 64-bit number kept as the bits of a BIGINT; ``ordered`` gives a BIGINT that sorts like it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN = -(1 << 63)
ONES = "4294967295L"


def usr(value: Column, bits: int) -> Column:
    """Unsigned shift to the right; 64 bits and more give 0."""
    return F.shiftrightunsigned(value, bits) if bits < 64 else F.lit(0).cast("long")


def _steps(df: DataFrame, kept: list[str], *steps: dict[str, str]) -> DataFrame:
    for step in steps:
        df = df.selectExpr(*kept, *[f"{value} AS {name}" for name, value in step.items()])
    return df


def _sealed(df: DataFrame, kept: list[str], last: dict[str, str]) -> DataFrame:
    """The last step as a generator, which filters on its result stay above.

    Pushed below the projections, a filter would carry the whole expression with it, each round's
    operands written out in full.
    """
    values = ", ".join(f"'{name}', {value}" for name, value in last.items())
    return df.selectExpr(*kept, f"inline(array(named_struct({values})))")


def _spread(*names: str) -> list[dict[str, str]]:
    """Bits of 32-bit words moved to the even places."""
    masks = (0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555)
    return [{v: f"({v} | shiftleft({v}, {16 >> k})) & {m}L" for v in names} for k, m in enumerate(masks)]


def _gather(*names: str) -> list[dict[str, str]]:
    """The even bits moved together."""
    masks = (0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF)
    return [{v: f"({v} | shiftright({v}, {1 << k})) & {m}L" for v in names} for k, m in enumerate(masks)]


def with_h(df: DataFrame, x: Column, y: Column, name: str = "h") -> DataFrame:
    """``df`` with the h of the point (x, y) at order 32; null where a coordinate is null."""
    kept = [f"`{c}`" for c in df.columns if c != name]
    df = df.select(*[df[c] for c in df.columns if c != name], x.cast("long").alias("_x"), y.cast("long").alias("_y"))
    both = {"_x": "_x", "_y": "_y"}
    steps = [
        both | {"_a": "_x ^ _y", "_b": f"{ONES} ^ _x ^ _y", "_c": f"{ONES} ^ (_x | _y)", "_d": f"_x & (_y ^ {ONES})"},
        both
        | {
            "_a": "_a | shiftright(_b, 1)",
            "_b": "shiftright(_a, 1) ^ _a",
            "_c": "shiftright(_c, 1) ^ (_b & shiftright(_d, 1)) ^ _c",
            "_d": "(_a & shiftright(_c, 1)) ^ shiftright(_d, 1) ^ _d",
        },
    ]
    for s in (2, 4, 8, 16):
        product = {
            "_a": f"(_a & shiftright(_a, {s})) ^ (_b & shiftright(_b, {s}))",
            "_b": f"(_a & shiftright(_b, {s})) ^ (_b & shiftright(_a ^ _b, {s}))",
        }
        moved = {
            "_c": f"_c ^ (_a & shiftright(_c, {s})) ^ (_b & shiftright(_d, {s}))",
            "_d": f"_d ^ (_b & shiftright(_c, {s})) ^ ((_a ^ _b) & shiftright(_d, {s}))",
        }
        steps.append(both | (product if s < 16 else {}) | moved)
    steps.append({"_x": "_x ^ _y", "_y": f"_d ^ shiftright(_d, 1) | ({ONES} ^ ((_x ^ _y) | (_c ^ shiftright(_c, 1))))"})
    df = _steps(df, kept, *steps, *_spread("_x", "_y"))
    return _sealed(df, kept, {name: "shiftleft(_y, 1) | _x"})


def with_xy(df: DataFrame, h: Column, x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with the point of h at order 32."""
    kept = [f"`{c}`" for c in df.columns if c not in (x, y)]
    df = df.select(*[df[c] for c in df.columns if c not in (x, y)], h.cast("long").alias("_h"))
    even = "6148914691236517205L"
    df = _steps(df, kept, {"_i": f"_h & {even}", "_j": f"shiftrightunsigned(_h, 1) & {even}"}, *_gather("_i", "_j"))
    both = {"_i": "_i", "_j": "_j"}
    steps = [both | {"_s": f"(_i | _j) ^ {ONES}", "_t": "_i & _j"}]
    steps += [both | {v: f"shiftright({v}, {k}) ^ {v}" for v in ("_s", "_t")} for k in (16, 8, 4, 2, 1)]
    steps.append(both | {"_a": f"((_i ^ {ONES}) & _t) | (_i & _s)"})
    return _sealed(_steps(df, kept, *steps), kept, {x: "_a ^ _j", y: "_a ^ _i ^ _j"})


def ordered(h: Column) -> Column:
    """Sorts as the unsigned h does; its own inverse."""
    return h.bitwiseXOR(F.lit(MIN))


def unsigned(h: Column) -> Column:
    """h as DECIMAL(20,0)."""
    return F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)")).cast("decimal(20,0)")


def from_unsigned(d: Column) -> Column:
    """The bits of an unsigned DECIMAL."""
    top = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(d >= top, (d - F.lit("18446744073709551616").cast("decimal(20,0)")).cast("long")).otherwise(d.cast("long"))


def at_zoom(h: Column, z: int) -> Column:
    """h of the tile at zoom z that holds h (order 32)."""
    return usr(h, 2 * (32 - z))


def prefix(h: Column, z: Column) -> Column:
    """``at_zoom`` for a zoom that is a column."""
    return F.when(z == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, ((32 - z) * 2).cast("int")))


def full(h: Column, z: Column) -> Column:
    """The first h at order 32 of a tile at zoom z."""
    return F.when(z == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", h, ((32 - z) * 2).cast("int")))
