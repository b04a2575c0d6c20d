"""Shapefiles written here, read in several tasks."""

import struct

import pytest
from pyspark.sql import functions as F

from areasignal.session import ship
from areasignal.sources import shapefiles


def write(base, boxes, deleted=(), index=True):
    """Rectangles (None: a null shape) with a name each, as .shp, .shx and .dbf."""
    bodies = []
    for b in boxes:
        if b is None:
            bodies.append(struct.pack("<i", 0))
            continue
        x1, y1, x2, y2 = b
        points = [(x1, y1), (x1, y2), (x2, y2), (x2, y1), (x1, y1)]
        bodies.append(struct.pack("<i4d2ii", 5, *b, 1, len(points), 0) + b"".join(struct.pack("<2d", *p) for p in points))
    shp, shx, at = bytearray(100), bytearray(100), 50
    for i, body in enumerate(bodies):
        shx += struct.pack(">2i", at, len(body) // 2)
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        at += 4 + len(body) // 2
    base.with_suffix(".shp").write_bytes(shp)
    if index:
        base.with_suffix(".shx").write_bytes(shx)
    head = 32 + 32 + 1
    dbf = bytearray(struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(boxes), head, 11)) + struct.pack("<11sc4xB15x", b"NAME", b"C", 10) + b"\r"
    for i in range(len(boxes)):
        dbf += (b"*" if i in deleted else b" ") + f"n{i}".ljust(10).encode()
    base.with_suffix(".dbf").write_bytes(dbf)


@pytest.fixture(scope="module")
def source(spark):
    ship(spark)
    spark.dataSource.register(shapefiles.Shapefiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("shapefiles")


def test_ranges_of_records_in_tasks(source, tmp_path):
    boxes = [None if i % 13 == 5 else (float(i), 0.0, i + 1.0, 2.0) for i in range(100)]
    write(tmp_path / "a", boxes, deleted={7, 8})
    write(tmp_path / "b", boxes[:3], index=False)
    df = source.option("path", str(tmp_path)).option("records", 16).load()
    assert df.rdd.getNumPartitions() == 7 + 1
    rows = {(r.file[-1], r.ord): r for r in df.collect()}
    assert set(rows) == {("a", i) for i in range(100) if i not in (7, 8)} | {("b", i) for i in range(3)}
    for (_, i), r in rows.items():
        assert r.fields == {"NAME": f"n{i}"} and (r.rings is None) == (boxes[i] is None)
        assert boxes[i] is None or ([len(x) for x in r.rings] == [5] and (r.min_x, r.min_y, r.max_x, r.max_y) == boxes[i])
    assert df.where(F.col("rings").isNull()).count() == sum(b is None for b in boxes)
    assert source.option("path", str(tmp_path / "a.shp")).option("records", 1000).load().count() == 98


def test_boxes_are_pushed_down(source, tmp_path):
    write(tmp_path / "a", [(float(i), 0.0, i + 1.0, 2.0) for i in range(50)])
    df = source.option("path", str(tmp_path)).load().where("max_x >= 10 AND min_x <= 12 AND fields['NAME'] <> 'n11'")
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "max_x" in plan.split("PushedFilters")[1].split("\n")[0]
    assert sorted(r.ord for r in df.collect()) == [9, 10, 12]


def test_other_shapes_and_no_files(source, tmp_path):
    assert source.option("path", str(tmp_path)).load().count() == 0
    with pytest.raises(ValueError):
        shapefiles.polygon(struct.pack("<i", 1))
