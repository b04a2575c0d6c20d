"""A data source of polygons from shapefiles, split by ranges of records.

The index file has each record's place, and attribute records have one size, so a task reads its own range of all three files.
Conditions on the box columns go to the source: records whose own box fails them are passed over before their points are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

BOX = ("min_x", "min_y", "max_x", "max_y")
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SCHEMA = "file string, ord bigint, fields map<string,string>, rings array<array<struct<x:double,y:double>>>, min_x double, min_y double, max_x double, max_y double"
_ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("rings", pa.list_(pa.list_(_POINT))), *((c, pa.float64()) for c in BOX)])
#: Records of a task, and of a batch.
RECORDS, BATCH = 1 << 16, 1024
_HOLDS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Range(InputPartition):
    """Records from first to last (exclusive) of a file's geometry and attributes; last below 0: all, without an index."""

    base: str
    first: int
    last: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def polygon(body: bytes) -> list | None:
    """Rings of a polygon record (types 5, 15 and 25); None of a null shape. Other types are an error."""
    kind = struct.unpack_from("<i", body)[0]
    if kind == 0:
        return None
    if kind not in (5, 15, 25):
        raise ValueError(f"shape type {kind} isn't a polygon")
    parts, points = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), points]
    xy = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
    return [[{"x": xy[2 * i], "y": xy[2 * i + 1]} for i in range(a, b)] for a, b in zip(starts, starts[1:])]


class Shapefiles(DataSource):
    """Format `shapefiles`; options path (a file, or a folder of files) and records (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "shapefiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShapefileReader(self.options)


class ShapefileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.records = options["path"], int(options.get("records", RECORDS))
        self.conditions: list[tuple[str, type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of box columns with numbers; Spark does the others."""
        for f in filters:
            if type(f) in _HOLDS and len(f.attribute) == 1 and f.attribute[0] in BOX and isinstance(f.value, (int, float)):
                self.conditions.append((f.attribute[0], type(f), float(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, path = opened(self.path)
        there = system.get_file_info(path)
        found = [there] if there.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        sizes = {f.path.lower(): f.size for f in found} if there.type != fs.FileType.File else {f.path.lower(): f.size for f in system.get_file_info(fs.FileSelector(path.rsplit("/", 1)[0]))}
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.path.lower().endswith(".shp"):
                base = f.path[:-4]
                size = sizes.get(f"{base.lower()}.shx")
                n = -1 if size is None else (size - 100) // 8
                out += [Range(base, 0, -1)] if n < 0 else [Range(base, a, min(n, a + self.records)) for a in range(0, n, self.records)]
        return out or [Range("", 0, 0)]

    def _file(self, system: fs.FileSystem, base: str, ending: str):
        for name in (f"{base}.{ending}", f"{base}.{ending.upper()}"):
            if system.get_file_info(name).type == fs.FileType.File:
                return system.open_input_file(name)
        return None

    def _attributes(self, system: fs.FileSystem, at: Range) -> dict[int, dict[str, str] | None]:
        """Fields of the range's records by place; None of a deleted one."""
        file = self._file(system, at.base, "dbf")
        if file is None:
            return {}
        with file:
            n, head, size = struct.unpack_from("<IHH", file.read_at(32, 0), 4)
            names, fields = file.read_at(head, 0), []
            for o in range(32, head - 1, 32):
                if names[o] == 0x0D:
                    break
                fields.append((names[o : o + 11].split(b"\0")[0].decode(errors="ignore"), names[o + 16]))
            last = n if at.last < 0 else min(n, at.last)
            content, out = file.read_at(max(0, last - at.first) * size, head + at.first * size), {}
        for place in range(at.first, last):
            row = content[(place - at.first) * size : (place + 1 - at.first) * size]
            if len(row) == size:
                values, o = {}, 1
                for name, width in fields:
                    values[name] = row[o : o + width].decode(errors="ignore").strip()
                    o += width
                out[place] = None if row[:1] == b"*" else values
        return out

    def _bodies(self, system: fs.FileSystem, at: Range) -> Iterator[tuple[int, bytes]]:
        """Place and content of each record, read one after the other."""
        with self._file(system, at.base, "shp") as file:
            if at.last < 0:
                place, offset, end = 0, 100, file.size()
                while offset + 12 <= end:
                    length = struct.unpack_from(">i", file.read_at(8, offset), 4)[0] * 2
                    yield place, file.read_at(length, offset + 8)
                    place, offset = place + 1, offset + 8 + length
                return
            with self._file(system, at.base, "shx") as index:
                places = struct.unpack(f">{2 * (at.last - at.first)}i", index.read_at(8 * (at.last - at.first), 100 + 8 * at.first))
            for i in range(at.last - at.first):
                yield at.first + i, file.read_at(2 * places[2 * i + 1], 2 * places[2 * i] + 8)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.base:
            return
        system = opened(self.path)[0]
        fields, held = self._attributes(system, partition), []
        for place, body in self._bodies(system, partition):
            values = fields.get(place, {})
            null = struct.unpack_from("<i", body)[0] == 0
            box = dict(zip(BOX, struct.unpack_from("<4d", body, 4))) if not null else dict.fromkeys(BOX)
            if values is None or any(box[c] is None or not _HOLDS[kind](box[c], v) for c, kind, v in self.conditions):
                continue
            held.append({"file": partition.base, "ord": place, "fields": list(values.items()), "rings": polygon(body), **box})
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, _ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


def read(spark, path: str, records: int = RECORDS):
    """The polygons of all shapefiles under a path (local, or an address that pyarrow reads), a task for each range of records; null
    shapes have null rings, deleted records don't show. Box conditions are pushed down where
    spark.sql.python.filterPushdown.enabled is set."""
    from areasignal.session import ship

    ship(spark)
    spark.dataSource.register(Shapefiles)
    return spark.read.format("shapefiles").option("path", path).option("records", records).load()
