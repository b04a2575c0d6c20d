"""Contacts and covers against brute force over all segments."""

import math
import random

import pytest

from areasignal.operators import outlines, spatial

SHAPE = "id long, ord long, rings array<array<struct<x double, y double>>>, a string, level string"


def frame(spark, polygons):
    return spark.createDataFrame([(i, i, rings, "a", "l") for i, rings in polygons], SHAPE)


def box(x1, y1, x2, y2):
    return [(float(x1), float(y1)), (float(x2), float(y1)), (float(x2), float(y2)), (float(x1), float(y2))]


def star(rng, x, y, r, n):
    at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in at]


def edges(rings):
    return [(r[i - 1], r[i]) for r in rings for i in range(len(r))]


def point_edge(p, e):
    (x1, y1), (x2, y2) = e
    dx, dy = x2 - x1, y2 - y1
    t = max(0, min(1, ((p[0] - x1) * dx + (p[1] - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
    return math.hypot(p[0] - x1 - t * dx, p[1] - y1 - t * dy)


def cross(e, f):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return turn(*e, f[0]) * turn(*e, f[1]) < 0 and turn(*f, e[0]) * turn(*f, e[1]) < 0


def holds(rings, p):
    odd = 0
    for r in rings:
        if any(point_edge(p, e) < 1e-12 for e in edges([r])):
            odd += 1
        else:
            odd += sum((a[1] > p[1]) != (b[1] > p[1]) and a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > p[0] for a, b in edges([r])) % 2
    return odd % 2 == 1


def meet(a, b, tolerance):
    near = any(cross(e, f) or min(point_edge(e[0], f), point_edge(e[1], f), point_edge(f[0], e), point_edge(f[1], e)) <= tolerance + 1e-9 for e in edges(a) for f in edges(b))
    return near or any(holds(b, r[0]) for r in a if r) or any(holds(a, r[0]) for r in b if r)


def brute(polygons, tolerance):
    return {(i, j) for i, a in polygons for j, b in polygons if i != j and meet(a, b, tolerance)}


@pytest.mark.parametrize("tolerance", [0.0, 0.3])
def test_contacts_against_all_segments(spark, tolerance):
    rng = random.Random(4)
    polygons = [(i, [star(rng, rng.uniform(0, 40), rng.uniform(0, 40), rng.choice((0.4, 1, 3, 12)), rng.randint(3, 9))]) for i in range(70)]
    polygons += [(100, [box(0, 0, 40, 40), box(10, 10, 30, 30)]), (101, [box(14, 14, 16, 16)]), (102, [box(-500, -500, 900, -100)]), (103, [box(1, 1, 2, 2), box(35, 35, 36, 36)])]
    got = {(r.src, r.dst) for r in outlines.contacts(frame(spark, polygons), "id", 1.0, tolerance).collect()}
    assert got == brute(polygons, tolerance)


def test_outlines_that_cross_without_a_corner_inside(spark):
    polygons = [(1, [box(0, 1, 4, 2)]), (2, [box(1, 0, 2, 4)]), (3, [box(20, 0, 24, 4)]), (4, [box(21, 1, 22, 2)]), (5, [box(24.005, 0, 25, 1)]), (6, [box(30, 0, 34, 4), box(31, 1, 33, 3)]), (7, [box(31.5, 1.5, 32, 2)])]
    pairs = lambda t: {(r.src, r.dst) for r in spatial.neighbours(frame(spark, polygons), "id", 0.5, t).collect()}
    assert pairs(0.0) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert pairs(0.01) == {(1, 2), (2, 1), (3, 4), (4, 3), (3, 5), (5, 3)}


def test_edge_rows(spark):
    polygons = [(1, None), (2, []), (3, [[]]), (4, [[(1.0, 1.0)]]), (5, [box(0, 0, 2, 2)]), (5, [box(0, 0, 2, 2)]), (6, [[(None, 1.0), (2.0, 2.0), (1.0, 1.0)]])]
    got = {(r.src, r.dst) for r in outlines.contacts(frame(spark, polygons), "id", 1.0).collect()}
    assert got == {(4, 5), (5, 4), (5, 6), (6, 5), (4, 6), (6, 4)}  # an edge without length is a point; null corners have no edges
    assert outlines.contacts(frame(spark, []), "id", 1.0).count() == 0
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 5.0, 5.0)], "p long, x double, y double")
    assert {(r.p, r.id) for r in outlines.holding(points, frame(spark, polygons), "p", "id", 1.0).collect()} == {(1, 5)}
    assert outlines.holding(points, frame(spark, []), "p", "id", 1.0).count() == 0


def test_points_in_large_and_small_polygons(spark):
    rng = random.Random(5)
    polygons = [(i, [star(rng, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice((0.5, 2, 5)), rng.randint(3, 12))]) for i in range(120)]
    polygons += [(500, [star(rng, 50, 50, 5000, 400)]), (501, [box(0, 0, 100, 100), box(20, 20, 80, 80), box(40, 40, 60, 60)])]
    at = [(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(1500)] + [(9000 + i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (20, 20), (20, 50), (100, 100), (40, 40), (50, 60), (100, 3)])]
    points = spark.createDataFrame(at, "p long, x double, y double")
    got = {(r.p, r.id) for r in outlines.holding(points, frame(spark, polygons), "p", "id", 0.5).collect()}
    assert got == {(p, i) for p, x, y in at for i, rings in polygons if holds(rings, (x, y))}


def test_cells_of_a_cover_are_bounded():
    rng = random.Random(6)
    for r in (0.01, 1, 1000, 1e7):
        ring = [{"x": x, "y": y} for x, y in star(rng, 3 * r, -r, r, 200)]
        cells = list(outlines._Rings([ring]).cover(1e-3))
        assert 0 < len(cells) <= 9 * 4**outlines.DEPTH / 2 and any(c[3] for c in cells)
        area = sum((1e-3 * 2.0 ** c[0]) ** 2 for c in cells)
        shoelace = abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
        assert area >= shoelace


def test_many_outlines_are_covered_together_and_by_many_tasks(spark):
    rng = random.Random(7)
    polygons = [(i, [star(rng, rng.uniform(0, 50), rng.uniform(0, 50), rng.choice((0.1, 1, 30)), rng.randint(3, 20)) for _ in range(rng.randint(1, 2))]) for i in range(200)] + [(900, None), (901, [[]]), (902, [[(None, 1.0), (2.0, 2.0), (1.0, 1.0)]])]
    rows = outlines.covers(frame(spark, polygons).coalesce(1), "id", 0.25)
    assert rows.rdd.getNumPartitions() >= 4
    alone = {(i, *map(int, c)) for i, rings in polygons for c in outlines._Rings([[{"x": x, "y": y} for x, y in r] for r in rings or ()]).cover(0.25)}
    assert {tuple(map(int, r)) for r in rows.collect()} == alone


def test_outlines_of_few_edges_meet_once(spark):
    """Boxes that share many cells, and outlines of few edges with ones of many."""
    rng = random.Random(8)
    polygons = [(i, [box(x, y, x + rng.uniform(0.2, 9), y + rng.uniform(0.2, 9))]) for i in range(60) for x, y in [(rng.uniform(-9, 9), rng.uniform(-9, 9))]]
    shape = frame(spark, polygons)
    once = [tuple(sorted(r)) for r in outlines._near_outlines(outlines._boxes(shape, "id", 0.0, 1.0), "id", 0.0, 1.0).collect()]
    assert len(once) == len(set(once)) and set(once) <= {tuple(sorted(p)) for p in brute(polygons, 0.0)}
    polygons += [(200 + i, [star(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), 4, 30)]) for i in range(6)]
    assert {(r.src, r.dst) for r in outlines.contacts(frame(spark, polygons), "id", 1.0).collect()} == brute(polygons, 0.0)


def test_plain_outlines_meet_without_covers(spark, monkeypatch):
    """Outlines of few whole edges, some in others and some in holes, need no segments and no covers; odd ones still do."""
    rng = random.Random(9)
    polygons = [(i, [star(rng, rng.uniform(0, 40), rng.uniform(0, 40), rng.choice((0.4, 2, 9)), rng.randint(3, 9))]) for i in range(60)]
    polygons += [(100, [box(0, 0, 40, 40), box(10, 10, 30, 30)]), (101, [box(14, 14, 16, 16)]), (102, [box(1, 1, 2, 2), box(35, 35, 36, 36)])]
    with monkeypatch.context() as m:
        m.setattr(outlines, "holding", None)
        m.setattr(outlines, "segments", None)
        rows = outlines.contacts(frame(spark, polygons).coalesce(1), "id", 1.0)
        assert {(r.src, r.dst) for r in rows.collect()} == brute(polygons, 0.0)
    odd = [(200, [[(5.0, 5.0)]]), (201, [[(20.0, 20.0), (None, 1.0)]]), (202, [star(rng, 20, 20, 15, 40)])]
    got = {(r.src, r.dst) for r in outlines.contacts(frame(spark, polygons + odd), "id", 1.0).collect()}
    assert got >= brute(polygons, 0.0) and (200, 100) in got and ((201, 100) in got) is False
    whole = [p for p in polygons + odd if p[0] != 201]
    assert {p for p in got if 201 not in p} == brute(whole, 0.0)


def test_cells_and_points_are_never_sent_to_the_driver(spark):
    """Files of cells are small for the rows that they hold, so the planner took them for small tables."""
    rng = random.Random(10)
    polygons = [(i, [star(rng, rng.uniform(0, 20), rng.uniform(0, 20), rng.choice((0.5, 4)), rng.randint(3, 9))]) for i in range(40)]
    polygons += [(500, [star(rng, 10, 10, 9, 2000)]), (501, [box(2, 2, 18, 18), box(5, 5, 9, 9)]), (502, [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], [(None, 1.0), (2.0, 2.0), (1.0, 1.0)]])]
    at = [(i, rng.uniform(-1, 21), rng.uniform(-1, 21), f"n{i}") for i in range(800)] + [(9000 + i, float(x), float(y), "edge") for i, (x, y) in enumerate([(2, 2), (5, 5), (5, 7), (9, 9), (18, 3), (4.5, 0)])]
    points = spark.createDataFrame(at, "p long, x double, y double, level string")
    found = spatial.points_in_polygons(points, frame(spark, polygons), "p", "id", 0.5, first=False)
    assert found.columns == ["p", "x", "y", "level", "id"]
    want = {(p, x, y, n, i) for p, x, y, n in at for i, rings in polygons if i != 502 and holds(rings, (x, y))}
    assert {tuple(r) for r in found.where("id <> 502").collect()} == want
    for made in (found, spatial.points_in_polygons(points, frame(spark, polygons), "p", "id", 0.5), spatial.points_in_polygons(points, frame(spark, polygons), "p", "id", 0.5, first=False, left=True)):
        assert "Broadcast" not in made._jdf.queryExecution().sparkPlan().toString()


def cut(x, y, w, h, turn):
    """A rectangle without one of its corners."""
    at = [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]
    for _ in range(turn):
        at = [(1 - q, p) for p, q in at]
    return [(x + w * p, y + h * q) for p, q in at[turn:] + at[:turn]]


@pytest.mark.parametrize(("held", "few", "pairs"), [(1 << 13, 1 << 10, 1 << 17), (8, 4, 64), (1 << 13, 0, 50)])
def test_crowded_cells_are_parted_and_pairs_made_once(spark, monkeypatch, held, few, pairs):
    """Rectangles, such without a corner, and others, some alike, in few cells; pairs aren't moved or written where they are read once."""
    for name, value in (("HELD", held), ("FEW_PAIRS", few), ("PAIRS", pairs)):
        monkeypatch.setattr(outlines, name, value)
    rng = random.Random(11)
    place = lambda n: rng.randint(0, n) * 0.25
    polygons = [(i, [box(x, y, x + 0.5 + place(20), y + 0.5 + place(8))]) for i in range(60) for x, y in [(place(60), place(60))]]
    polygons += [(100 + i, [cut(place(60), place(60), 0.5 + place(20), 0.5 + place(8), i % 4)]) for i in range(60)]
    polygons += [(200 + i, [star(rng, place(60), place(60), rng.choice((0.5, 4)), rng.randint(3, 9))]) for i in range(12)]
    polygons += [(300, [box(0, 0, 15, 15), box(5, 5, 12, 12)]), (301, polygons[0][1]), (302, [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, -1.0), (0.0, -1.0)]]), (303, [[(3.0, 3.0), (5.0, 3.0), (3.0, 3.0), (3.0, 4.0)]])]
    for tolerance in (0.0, 0.25, 0.3):
        rows = [tuple(r) for r in outlines.contacts(frame(spark, polygons), "id", 1.0, tolerance, once=True).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(polygons, tolerance)
    made = []
    monkeypatch.setattr(outlines, "written", lambda df, real=outlines.written: made.append(df) or real(df))
    pairs = outlines.contacts(frame(spark, polygons), "id", 1.0, once=True)
    assert len(made) == 1 and "Aggregate" not in pairs._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
    twice = [tuple(r) for r in outlines.contacts(frame(spark, polygons + polygons[:80]), "id", 1.0, once=True).collect()]
    assert len(twice) == len(set(twice)) and set(twice) == brute(polygons, 0.0)


def test_points_in_rectangles_need_no_edges(spark, monkeypatch):
    """Points in outlines of one or two rectangles, on their edges and corners too, are told in the join."""
    rng = random.Random(12)
    place = lambda n: rng.randint(0, n) * 0.25
    polygons = [(i, [cut(place(60), place(60), 0.5 + place(20), 0.5 + place(8), i % 4)]) for i in range(60)]
    polygons += [(100 + i, [box(x, y, x + 0.5 + place(20), y + 0.5 + place(8))]) for i in range(40) for x, y in [(place(60), place(60))]]
    polygons += [(302, [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, -1.0), (0.0, -1.0)]])]
    at = [(i, place(90) - 2, place(80) - 2) for i in range(1500)] + [(5000 + i, rng.uniform(-2, 20), rng.uniform(-2, 18)) for i in range(500)]
    points = spark.createDataFrame(at, "p long, x double, y double")
    monkeypatch.setattr(outlines._Rings, "beside", lambda self, polygon, *a: (outlines.np.zeros((0, 5)), outlines.np.zeros(0, int)) if not len(polygon) else 1 / 0)
    got = [(r.p, r.id) for r in outlines.holding(points, frame(spark, polygons), "p", "id", 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == {(p, i) for p, x, y in at for i, rings in polygons if holds(rings, (x, y))}
