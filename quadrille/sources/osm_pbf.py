"""A Spark data source for OSM PBF files: one partition per block.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osm_pbf").option("kind", "nodes").load(path)

Planning walks the chain of block headers only. A task reads its block, inflates it and sends Arrow batches. Kinds: header,
nodes, ways, relations, and blocks (an index with what each block holds). A block without the kind gives nothing after
a look at its group tags: its strings are not decoded. A header that can't be read ends the chain, with a warning.
"""

from __future__ import annotations

import os
import struct
import warnings
import zlib
from dataclasses import dataclass
from glob import glob

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TAGS = "tags ARRAY<STRUCT<k: STRING, v: STRING>>"
SCHEMAS = {
    "header": "bbox_left LONG, bbox_right LONG, bbox_top LONG, bbox_bottom LONG, writingprogram STRING, source STRING, "
    "replication_timestamp LONG, replication_sequence_number LONG, replication_base_url STRING",
    "nodes": f"osm_id LONG, lon INT, lat INT, {TAGS}",
    "ways": f"osm_id LONG, refs ARRAY<LONG>, {TAGS}",
    "blocks": "path STRING, start LONG, size LONG, type STRING, granularity INT",
    "relations": f"osm_id LONG, members ARRAY<STRUCT<type: STRING, ref: LONG, role: STRING>>, {TAGS}",
}
GROUPS = {"nodes": 2, "ways": 3, "relations": 4}
MEMBER_TYPES = ("node", "way", "relation")


def varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def zigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def fields(buf: bytes):
    """(number, value) of a message: integers, or bytes where length-delimited."""
    at, n = 0, len(buf)
    while at < n:
        key, at = varint(buf, at)
        wire = key & 7
        if wire == 0:
            value, at = varint(buf, at)
        elif wire == 2:
            size, at = varint(buf, at)
            value, at = buf[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


def packed(buf: bytes) -> list[int]:
    out, at = [], 0
    while at < len(buf):
        value, at = varint(buf, at)
        out.append(value)
    return out


def signed64(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def deltas(buf: bytes) -> list[int]:
    total, out = 0, []
    for n in packed(buf):
        total += zigzag(n)
        out.append(total)
    return out


@dataclass
class Block(InputPartition):
    path: str
    kind: str  # OSMHeader or OSMData
    start: int
    size: int


def block_index(path: str) -> list[Block]:
    """The blocks of a file, by its chain of block headers; a header that can't be read ends the chain."""
    out, at, total = [], 0, os.path.getsize(path)
    with open(path, "rb") as file:
        while at + 4 <= total:
            file.seek(at)
            try:
                (size,) = struct.unpack(">I", file.read(4))
                header = dict(fields(file.read(size)))
                data, kind = header[3], header[1].decode()
                if at + 4 + size + data > total:
                    raise ValueError("the file ends within the block")
            except (ValueError, KeyError, IndexError, AttributeError, UnicodeDecodeError) as problem:
                warnings.warn(f"{path}: no block at {at}: {problem}", stacklevel=2)
                break
            out.append(Block(path, kind, at + 4 + size, data))
            at += 4 + size + data
    return out


def block_type(buf: bytes) -> tuple[str, int]:
    """What a data block holds, by the tags of its first group, and its granularity; nothing is decoded."""
    kind, granularity = "", 100
    for number, value in fields(buf):
        if number == 2 and not kind:
            tags = {n for n, _ in fields(value)}
            kind = next((k for k, n in GROUPS.items() if n in tags), "other" if tags else "")
        elif number == 17:
            granularity = value
    return kind or "empty", granularity


def inflate(block: Block) -> bytes:
    with open(block.path, "rb") as file:
        file.seek(block.start)
        blob = dict(fields(file.read(block.size)))
    if 1 in blob:
        return blob[1]
    if 3 in blob:
        return zlib.decompress(blob[3])
    raise ValueError("unknown compression")


def header_row(buf: bytes) -> dict:
    found = dict(fields(buf))
    box = {k: zigzag(v) for k, v in fields(found.get(1, b""))}
    degrees = {k: int(v / 100) for k, v in box.items()}  # nanodegrees to 1e-7 degrees

    def text(k: int):
        return found[k].decode() if k in found else None

    return {
        "bbox_left": degrees.get(1), "bbox_right": degrees.get(2), "bbox_top": degrees.get(3), "bbox_bottom": degrees.get(4),
        "writingprogram": text(16), "source": text(17), "replication_timestamp": found.get(32),
        "replication_sequence_number": found.get(33), "replication_base_url": text(34),
    }


def data_rows(buf: bytes, kind: str):
    """Rows of one kind in a data block."""
    table = b""
    groups, granularity, lat_offset, lon_offset = [], 100, 0, 0
    for number, value in fields(buf):
        if number == 1:
            table = value
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number == 19:
            lat_offset = signed64(value)
        elif number == 20:
            lon_offset = signed64(value)
    tags = [[number for number, _ in fields(group)] for group in groups]
    if any(number in (1, 5) for numbers in tags for number in numbers):
        raise ValueError("plain nodes and changesets are not supported")
    if not any(GROUPS[kind] in numbers for numbers in tags):
        return
    strings = [s.decode() for k, s in fields(table) if k == 1]
    for group in groups:
        for number, value in fields(group):
            if number != GROUPS[kind]:
                continue
            found = dict(fields(value))
            if kind == "nodes":
                flat, at = packed(found.get(10, b"")), 0
                for osm_id, lat, lon in zip(*(deltas(found.get(k, b"")) for k in (1, 8, 9))):
                    tags = []
                    while at < len(flat) and flat[at]:
                        tags.append({"k": strings[flat[at]], "v": strings[flat[at + 1]]})
                        at += 2
                    at += 1
                    place = ((lon_offset + granularity * lon) // 100, (lat_offset + granularity * lat) // 100)
                    yield {"osm_id": osm_id, "lon": place[0], "lat": place[1], "tags": tags}
                continue
            pairs = zip(packed(found.get(2, b"")), packed(found.get(3, b"")))
            row = {"osm_id": signed64(found[1]), "tags": [{"k": strings[k], "v": strings[v]} for k, v in pairs]}
            if kind == "ways":
                row["refs"] = deltas(found.get(8, b""))
            else:
                parts = zip(packed(found.get(10, b"")), deltas(found.get(9, b"")), packed(found.get(8, b"")))
                row["members"] = [{"type": MEMBER_TYPES[t], "ref": ref, "role": strings[role]} for t, ref, role in parts]
            yield row


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options, schema)


class PbfReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.kind, self.path, self.schema = options.get("kind", "nodes"), options["path"], schema

    def partitions(self) -> list[Block]:
        files = sorted(glob(os.path.join(self.path, "*.pbf"))) if os.path.isdir(self.path) else sorted(glob(self.path))
        wanted = {"header": ("OSMHeader",), "blocks": ("OSMHeader", "OSMData")}.get(self.kind, ("OSMData",))
        return [b for f in files for b in block_index(f) if b.kind in wanted]

    def read(self, block: Block):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(self.schema)
        if self.kind == "header":
            rows = [header_row(inflate(block))]
        elif self.kind == "blocks":
            kind, granularity = ("header", None) if block.kind == "OSMHeader" else block_type(inflate(block))
            rows = [{"path": block.path, "start": block.start, "size": block.size, "type": kind, "granularity": granularity}]
        else:
            rows = data_rows(inflate(block), self.kind)
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)


def blocks(spark, path: str):
    """The index of all blocks, in order of type, granularity and place. Blocks are looked into by the tasks."""
    spark.dataSource.register(OsmPbf)
    rows = spark.read.format("osm_pbf").option("kind", "blocks").load(path)
    return rows.orderBy("type", "granularity", "path", "start")


def granularities(spark, path: str) -> int:
    """Greatest common divisor of the granularities of all data blocks; 100 in practice."""
    import math

    found = blocks(spark, path).filter("granularity IS NOT NULL").select("granularity").distinct().collect()
    return math.gcd(*[r.granularity for r in found]) or 100
