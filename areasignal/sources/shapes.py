"""Polygons from shapefiles: the geometry and attribute files are read as binary and parsed in batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def shapes_in(content: bytes) -> Iterator[tuple[int, list]]:
    """Place and rings of each polygon (type 5; 15 and 25 too); null shapes take a place, other types are an error."""
    at, place = 100, 0
    while at + 12 <= len(content):
        length = struct.unpack_from(">i", content, at + 4)[0] * 2
        body, at = content[at + 8 : at + 8 + length], at + 8 + length
        kind = struct.unpack_from("<i", body)[0]
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<2i", body, 36)
            starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            yield place, [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]
        elif kind:
            raise ValueError(f"shape type {kind} isn't a polygon")
        place += 1


def attributes_in(content: bytes) -> Iterator[tuple[int, dict[str, str]]]:
    """Place and fields (text, trimmed) of each record; deleted ones take a place but don't show."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at = [], 32
    while at < head - 1 and content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(errors="ignore"), content[at + 16]))
        at += 32
    for place in range(n):
        row = content[head + place * size : head + (place + 1) * size]
        if len(row) < size or row[:1] == b"*":
            continue
        out, at = {}, 1
        for name, width in fields:
            out[name] = row[at : at + width].decode(errors="ignore").strip()
            at += width
        yield place, out


def _parsed(files: DataFrame, parse, schema: str, kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for row in parse(content.as_py()):
                    held.append((base, *row))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return files.mapInArrow(run, schema)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """file, ord (the place in it), fields (map of text) and rings of the polygons of all shapefiles under a path."""
    base = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "")
    of = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path).select(base.alias("file"), "content")
    geometry = _parsed(of("shp"), shapes_in, f"file string, ord long, rings {RINGS}", [pa.string(), pa.int64(), pa.list_(pa.list_(_POINT))], ["file", "ord", "rings"])
    attributes = _parsed(of("dbf"), attributes_in, "file string, ord long, fields map<string,string>", [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())], ["file", "ord", "fields"])
    return geometry.join(attributes, ["file", "ord"]).select("file", "ord", "fields", "rings")

