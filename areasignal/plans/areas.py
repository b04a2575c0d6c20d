"""Queries on geometry, neighbours and tables of keys."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from areasignal.functions import geo, text, vectors
from areasignal.operators import outlines, spatial, tables
from areasignal.plans.base import ctes, frame, query, table


def polygons(spark, sf_dir):
    """A unit square for each unit on the grid; every eleventh has a hole in its middle."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ring = lambda a, b: F.array(*(F.struct((x + p).alias("x"), (y + q).alias("y")) for p, q in ((a, a), (b, a), (b, b), (a, b))))
    rings = F.when(F.col("unit_id") % 11 == 0, F.array(ring(0.0, 1.0), ring(0.25, 0.75))).otherwise(F.array(ring(0.0, 1.0)))
    return frame(spark, sf_dir, "units").select("unit_id", "group_id", "fold", F.col("unit_id").alias("ord"), rings.alias("rings"), "x", "y", "balance")


def edges(spark, sf_dir):
    return spatial.neighbours(polygons(spark, sf_dir), "unit_id", 1.0)


EDGES = ", edges AS (SELECT a.unit_id AS src, b.unit_id AS dst FROM units AS a JOIN units AS b ON a.unit_id <> b.unit_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1)"
UNIT_VALUES = ", vals AS (SELECT l_suppkey AS unit_id, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY l_suppkey)"


def unit_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))


@query(ctes("units") + EDGES + " SELECT u.unit_id, coalesce(list_sort(list(dst) FILTER (dst IS NOT NULL)), []) AS neighbours FROM units AS u LEFT JOIN edges ON src = u.unit_id GROUP BY u.unit_id")
def grid_neighbours(spark, sf_dir):
    return spatial.neighbour_lists(frame(spark, sf_dir, "units"), "unit_id", edges(spark, sf_dir))


#: Customers' outlines: rectangles, every third without its upper right quarter; as parts for SQL, which are rectangles.
OUTLINES = """WITH o AS (SELECT c_custkey AS id, (c_custkey * 37) % 997 * 0.125::DOUBLE AS x, (c_custkey * 53) % 991 * 0.125::DOUBLE AS y, 0.5 + c_custkey % 7 AS w, 0.5 + c_custkey % 5 AS h FROM customer),
parts AS (SELECT id, x AS x1, y AS y1, x + w AS x2, y + CASE WHEN id % 3 = 0 THEN h / 2 ELSE h END AS y2 FROM o UNION ALL SELECT id, x, y, x + w / 2, y + h FROM o WHERE id % 3 = 0)"""


def customer_outlines(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37) % 997 * 0.125).alias("x"), ((k * 53) % 991 * 0.125).alias("y"), (0.5 + k % 7).alias("w"), (0.5 + k % 5).alias("h"))
    corner = lambda p, q: F.struct((F.col("x") + F.col("w") * p).alias("x"), (F.col("y") + F.col("h") * q).alias("y"))
    whole = F.array(*(corner(p, q) for p, q in ((0, 0), (1, 0), (1, 1), (0, 1))))
    cut = F.array(*(corner(p, q) for p, q in ((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1))))
    return rows.select("id", F.col("id").alias("ord"), F.array(F.when(F.col("id") % 3 == 0, cut).otherwise(whole)).alias("rings"))


@query(OUTLINES + " SELECT DISTINCT a.id AS src, b.id AS dst FROM parts AS a JOIN parts AS b ON a.id <> b.id AND pow(greatest(0, a.x1 - b.x2, b.x1 - a.x2), 2) + pow(greatest(0, a.y1 - b.y2, b.y1 - a.y2), 2) <= 0.01")
def outline_contacts(spark, sf_dir):
    """Outlines that cross, touch, hold or come within 0.1 of one another."""
    return spatial.neighbours(customer_outlines(spark, sf_dir), "id", 1.0, 0.1, once=True)


@query(
    OUTLINES + """, p AS (SELECT o_orderkey AS point, (o_orderkey * 71) % 9973 / 80.0::DOUBLE AS x, (o_orderkey * 29) % 9967 / 80.0::DOUBLE AS y FROM orders),
hit AS (SELECT DISTINCT point, id FROM p JOIN parts ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2 UNION ALL SELECT point, -1 FROM p WHERE x BETWEEN 10 AND 110 AND y BETWEEN 10 AND 110 AND NOT (x BETWEEN 40 AND 80 AND y BETWEEN 40 AND 80))
SELECT id, count(*) AS n, sum(point)::BIGINT AS points FROM hit GROUP BY id"""
)
def points_by_outline(spark, sf_dir):
    """Orders as points in the outlines, and in one large polygon with a hole, whose cells are larger."""
    square = lambda a, b: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))))
    large = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("ord"), F.array(square(10, 110), square(40, 80)).alias("rings"))
    k = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(k.alias("point"), ((k * 71) % 9973 / 80.0).alias("x"), ((k * 29) % 9967 / 80.0).alias("y"))
    found = outlines.holding(points, customer_outlines(spark, sf_dir).union(large), "point", "id", 0.25)
    return found.groupBy("id").agg(F.count("*").alias("n"), F.sum("point").alias("points"))


def _grid_sql() -> str:
    """Places to the national grid in SQL: one step of the projection in each common table."""
    a, b, s, g = 6378137.0, geo.GRID["b"], geo.SHIFT, geo.GRID
    e2, e, n, p0 = 0.00669437999014, 1 - (b / g["a"]) ** 2, (g["a"] - b) / (g["a"] + b), math.radians(g["lat0"])
    c = lambda x: f"({x!r})::DOUBLE"
    turn = {k: c(math.radians(s[k] / 3600)) for k in ("rx", "ry", "rz")}
    k = c(1 + s["s"])
    back = lambda i: f", f{i} AS (SELECT id, x, y, z, r, atan2(z + {c(e * g['a'])} / sqrt(1 - {c(e)} * sin(phi) * sin(phi)) * sin(phi), r) AS phi FROM f{i - 1})"
    arc = f"{c(b * g['f0'])} * ({c(1 + n + 1.25 * n**2 + 1.25 * n**3)} * d - {c(3 * n + 3 * n**2 + 2.625 * n**3)} * sin(d) * cos(s) + {c(1.875 * (n**2 + n**3))} * sin(2 * d) * cos(2 * s) - {c(35 / 24 * n**3)} * sin(3 * d) * cos(3 * s))"
    return f"""WITH p AS (SELECT c_custkey AS id, radians(50 + c_custkey * 37 % 1000 / 125.0::DOUBLE) AS la, radians(c_custkey * 53 % 997 / 150.0::DOUBLE - 5) AS lo FROM customer),
q AS (SELECT *, {c(a)} / sqrt(1 - {c(e2)} * sin(la) * sin(la)) AS nu FROM p), o AS (SELECT id, nu * cos(la) * cos(lo) AS x, nu * cos(la) * sin(lo) AS y, nu * {c(1 - e2)} * sin(la) AS z FROM q),
h AS (SELECT id, {c(s['tx'])} + x * {k} - y * {turn['rz']} + z * {turn['ry']} AS x, {c(s['ty'])} + x * {turn['rz']} + y * {k} - z * {turn['rx']} AS y, {c(s['tz'])} - x * {turn['ry']} + y * {turn['rx']} + z * {k} AS z FROM o),
f0 AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z, sqrt(x * x + y * y) * {c(1 - e)}) AS phi FROM h){back(1)}{back(2)}{back(3)},
t AS (SELECT id, sin(phi) AS si, cos(phi) AS co, tan(phi) ** 2 AS t2, phi - {c(p0)} AS d, phi + {c(p0)} AS s, atan2(y, x) - {c(math.radians(g['lon0']))} AS w, {c(g['a'] * g['f0'])} / sqrt(1 - {c(e)} * sin(phi) * sin(phi)) AS v, {c(1 - e)} / (1 - {c(e)} * sin(phi) * sin(phi)) AS ratio FROM f3)
SELECT id, round({c(g['e0'])} + v * co * w + v / 6 * co ** 3 * (1 / ratio - t2) * w ** 3 + v / 120 * co ** 5 * (5 - 18 * t2 + t2 * t2 + 14 * (1 / ratio - 1) - 58 * t2 * (1 / ratio - 1)) * w ** 5, 3) AS easting,
round({arc} + {c(g['n0'])} + v / 2 * si * co * w ** 2 + v / 24 * si * co ** 3 * (5 - t2 + 9 * (1 / ratio - 1)) * w ** 4 + v / 720 * si * co ** 5 * (61 - 58 * t2 + t2 * t2) * w ** 6, 3) AS northing FROM t"""


@query(_grid_sql())
def places_on_grid(spark, sf_dir):
    """Customers' places (degrees) as easting and northing in metres."""
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(k.alias("id"), geo.national_grid(50 + k * 37 % 1000 / 125.0, k * 53 % 997 / 150.0 - 5).alias("at"))
    return at.select("id", F.round("at.x", 3).alias("easting"), F.round("at.y", 3).alias("northing"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey * 37 % 1800 / 10.0::DOUBLE - 90 AS lat, c_custkey * 53 % 3600 / 10.0::DOUBLE - 180 AS lon FROM customer),
m AS (SELECT id, 6378137 * radians(lon) AS x, 6378137 * ln(tan(pi() / 4 + radians(greatest(-85.0511287798066::DOUBLE, least(85.0511287798066::DOUBLE, lat))) / 2)) AS y, greatest(-85.0511287798066::DOUBLE, least(85.0511287798066::DOUBLE, lat)) AS lat, lon FROM p)
SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(lat, 6) AS lat, round(lon, 6) AS lon FROM m""")
def places_in_plane(spark, sf_dir):
    """Customers' places in the plane that points are drawn in where coordinates are degrees, and back in degrees."""
    k = F.col("c_custkey")
    at = table(spark, sf_dir, "customer").select(k.alias("id"), geo.web_mercator(k * 37 % 1800 / 10.0 - 90, k * 53 % 3600 / 10.0 - 180).alias("at"))
    back = at.withColumn("back", geo.from_web_mercator(F.col("at.x"), F.col("at.y")))
    return back.select("id", *(F.round(f"at.{c}", 3).alias(c) for c in "xy"), *(F.round(f"back.{c}", 6).alias(c) for c in ("lat", "lon")))


MEANS = EDGES + UNIT_VALUES + ", lag AS (SELECT src AS unit_id, avg(quantity) AS q, avg(discount) AS d FROM edges JOIN vals ON vals.unit_id = dst GROUP BY src)"


@query(ctes("units") + MEANS + " SELECT v.unit_id, round(coalesce(q, quantity), 6) AS quantity_lag, round(coalesce(d, discount), 6) AS discount_lag FROM vals AS v LEFT JOIN lag USING (unit_id)")
def neighbour_mean_features(spark, sf_dir):
    found = spatial.neighbour_means(unit_values(spark, sf_dir), "unit_id", ["quantity", "discount"], edges(spark, sf_dir))
    return found.select("unit_id", F.round("quantity_lag", 6).alias("quantity_lag"), F.round("discount_lag", 6).alias("discount_lag"))


@query(ctes("units") + MEANS + " SELECT v.unit_id, round(quantity - coalesce(q, quantity), 6) AS quantity_gap FROM vals AS v LEFT JOIN lag USING (unit_id)")
def ego_gap(spark, sf_dir):
    return spatial.ego_gap(unit_values(spark, sf_dir), "unit_id", ["quantity"], edges(spark, sf_dir)).select("unit_id", F.round("quantity_gap", 6).alias("quantity_gap"))


@query(
    ctes("units") + EDGES + UNIT_VALUES + """, t AS (SELECT unit_id, fold, quantity FROM vals JOIN units USING (unit_id)), h AS (SELECT unnest(range(5))::INTEGER AS held_out)
SELECT held_out, unit_id, fold, round(coalesce((SELECT avg(n.quantity) FROM edges JOIN t AS n ON n.unit_id = dst WHERE src = t.unit_id AND n.fold <> held_out), (SELECT avg(g.quantity) FROM t AS g WHERE g.fold <> held_out)), 6) AS quantity_lag FROM t CROSS JOIN h"""
)
def target_lag_train_only(spark, sf_dir):
    rows = unit_values(spark, sf_dir).join(frame(spark, sf_dir, "units").select("unit_id", "fold"), "unit_id")
    found = spatial.target_lag(rows, "unit_id", "fold", ["quantity"], edges(spark, sf_dir), list(range(5)))
    return found.select("held_out", "unit_id", "fold", F.round("quantity_lag", 6).alias("quantity_lag"))


@query(
    ctes("points", "units") + """, hit AS (
    SELECT p.point_id, u.unit_id FROM points AS p JOIN units AS u ON p.x BETWEEN u.x AND u.x + 1 AND p.y BETWEEN u.y AND u.y + 1
    WHERE u.unit_id % 11 <> 0 OR NOT (p.x BETWEEN u.x + 0.25 AND u.x + 0.75 AND p.y BETWEEN u.y + 0.25 AND u.y + 0.75)
) SELECT point_id, min(unit_id) AS unit_id FROM hit GROUP BY point_id"""
)
def point_in_polygon(spark, sf_dir):
    points = frame(spark, sf_dir, "points").select("point_id", "x", "y")
    return spatial.points_in_polygons(points, polygons(spark, sf_dir), "point_id", "unit_id", 1.0).select("point_id", "unit_id")


@query(ctes("points", "units") + " SELECT p.point_id, u.unit_id FROM points AS p LEFT JOIN units AS u ON p.x BETWEEN u.x AND u.x + 1 AND p.y BETWEEN u.y AND u.y + 1 AND (u.unit_id % 11 <> 0 OR NOT (p.x BETWEEN u.x + 0.25 AND u.x + 0.75 AND p.y BETWEEN u.y + 0.25 AND u.y + 0.75))")
def points_join_all_polygons(spark, sf_dir):
    points = frame(spark, sf_dir, "points").select("point_id", "x", "y")
    return spatial.points_in_polygons(points, polygons(spark, sf_dir), "point_id", "unit_id", 1.0, first=False, left=True).select("point_id", "unit_id")


@query(ctes("points") + ", boxes AS (SELECT s_nationkey AS nation, min(s_suppkey % 6) AS a, max(3 + s_suppkey % 8) AS b FROM supplier GROUP BY s_nationkey) SELECT nation, count(*) AS n, sum(point_id)::BIGINT AS ids FROM points JOIN boxes USING (nation) WHERE x BETWEEN a AND b AND y BETWEEN a AND b GROUP BY nation")
def bbox_range_join(spark, sf_dir):
    boxes = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min(F.col("s_suppkey") % 6).alias("min_x"), F.max(3 + F.col("s_suppkey") % 8).alias("max_x")).withColumns({"min_y": F.col("min_x"), "max_y": F.col("max_x")})
    return spatial.in_boxes(frame(spark, sf_dir, "points"), boxes, "nation").groupBy("nation").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"))


_LAT, _LON = "55.8 + c_custkey % 100 / 1000.0", "-4.3 + c_custkey % 77 / 500.0"


@query(
    f"""WITH p AS (SELECT c_custkey AS id, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon FROM customer), m AS (SELECT *, radians(lat) AS r FROM p),
d AS (SELECT *, 500 / (111132.92 - 559.82 * cos(2 * r) + 1.175 * cos(4 * r) - 0.0023 * cos(6 * r)) AS dlat, 500 / (111412.84 * cos(r) - 93.5 * cos(3 * r) + 0.118 * cos(5 * r)) AS dlon FROM m)
SELECT id, round(lon - dlon, 7) AS min_lon, round(lat - dlat, 7) AS min_lat, round(lon + dlon, 7) AS max_lon, round(lat + dlat, 7) AS max_lat FROM d"""
)
def square_bbox_m(spark, sf_dir):
    box = geo.square_box(F.expr(_LAT).cast("double"), F.expr(_LON).cast("double"), 1000.0)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), box.alias("b"))
    return rows.select("id", *(F.round(f"b.{c}", 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


@query(
    f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS n, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon FROM customer),
h AS (SELECT a.id AS a, b.id AS b, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM p AS a JOIN p AS b ON a.n = b.n AND abs(a.lat - b.lat) <= 0.0055 AND abs(a.lon - b.lon) <= 0.009 AND a.id < b.id)
SELECT a, b, round(2 * 6371000 * asin(sqrt(least(1, h))), 3) AS metres FROM h WHERE round(2 * 6371000 * asin(sqrt(least(1, h))), 3) <= 500"""
)
def haversine_pairs(spark, sf_dir):
    """All pairs of a nation within 500 m."""
    p = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    dlat, dlon = 0.0055, 0.009  # degrees: more than 500 m here, so pairs lie in one cell or the next
    a, b = (p.select("c_nationkey", F.col("c_custkey").alias(n), F.col("lat").alias(f"lat_{n}"), F.col("lon").alias(f"lon_{n}"), F.floor(F.col("lat") / dlat).alias("i"), F.floor(F.col("lon") / dlon).alias("j")) for n in "ab")
    around = F.array(*map(F.lit, (-1, 0, 1)))
    a = a.withColumn("i", F.explode(F.transform(around, lambda d: F.col("i") + d))).withColumn("j", F.explode(F.transform(around, lambda d: F.col("j") + d)))
    pairs = a.join(b, ["c_nationkey", "i", "j"]).where("a < b")
    found = pairs.select("a", "b", F.round(geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 3).alias("metres"))
    return found.where("metres <= 500")


@query(
    f"""WITH b AS (SELECT c_nationkey AS id, min({_LAT})::DOUBLE AS a, max({_LAT})::DOUBLE AS b, min({_LON})::DOUBLE AS c, max({_LON})::DOUBLE AS d FROM customer GROUP BY 1),
m AS (SELECT id, (a + b) / 2 AS lat, (c + d) / 2 AS lon, (b - a) * 111320 AS up, (d - c) * 111320 AS side FROM b)
SELECT id, round(lat, 6) AS lat, round(lon, 6) AS lon, floor(greatest(200, least(50000, sqrt(up * up + (side * cos(radians(lat))) * (side * cos(radians(lat)))) / 2)))::INTEGER AS radius FROM m"""
)
def bbox_centre_radius(spark, sf_dir):
    b = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.min(F.expr(_LAT).cast("double")).alias("a"), F.max(F.expr(_LAT).cast("double")).alias("b"), F.min(F.expr(_LON).cast("double")).alias("c"), F.max(F.expr(_LON).cast("double")).alias("d"))
    return b.select("id", geo.centre_radius(F.col("c"), F.col("a"), F.col("d"), F.col("b")).alias("r")).select("id", F.round("r.lat", 6).alias("lat"), F.round("r.lon", 6).alias("lon"), "r.radius")


@query(
    f"""WITH RECURSIVE p AS (SELECT c_nationkey AS unit_id, c_custkey AS at, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 9 <> 2),
f AS (SELECT DISTINCT unit_id, 0::BIGINT AS i, []::STRUCT("at" BIGINT, lat DOUBLE, lon DOUBLE)[] AS taken FROM p
UNION ALL SELECT f.unit_id, p.i, CASE WHEN len(taken) < 15 AND coalesce(list_min(list_transform(taken, lambda a: 2 * 6371000.0 * asin(sqrt(least(1, pow(sin(radians(p.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - a.lon) / 2), 2)))))), 1e9) >= 2000
    THEN list_append(taken, {{'at': p.at, 'lat': p.lat, 'lon': p.lon}}) ELSE taken END FROM f JOIN p ON p.unit_id = f.unit_id AND p.i = f.i + 1),
e AS (SELECT unit_id, max_by(taken, i) AS taken FROM f GROUP BY unit_id)
SELECT unit_id, (g - 1)::INTEGER AS place, taken[g].at AS at, round(taken[g].lat, 9) AS lat, round(taken[g].lon, 9) AS lon FROM e, range(1, 16) AS r(g) WHERE g <= len(taken)"""
)
def min_spacing_greedy(spark, sf_dir):
    """Points at least 2 km apart, taken in order, 15 a unit at most; those seen before or outside the unit's box don't count."""
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit_id"), F.col("c_custkey").alias("at"), F.expr(_LAT).cast("double").alias("lat"), F.expr(_LON).cast("double").alias("lon"))
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-9.0, 50.0), (9.0, 50.0), (9.0, 60.0), (-9.0, 60.0))))
    p = p.withColumn("lat", F.when(F.col("at") % 10 == 3, F.lit(70.0)).otherwise(F.col("lat")))  # outside the areas
    areas = p.select("unit_id").distinct().withColumn("rings", F.array(ring))
    seen = p.where("at % 9 = 2").select("at")
    found = spatial.spaced(p, "unit_id", "at", 2000.0, 15, areas, seen)
    return found.select("unit_id", F.posexplode("accepted").alias("place", "p")).select("unit_id", "place", "p.at", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query(ctes("units") + " SELECT unit_id, round(a, 6) AS area, CASE WHEN a >= 6 THEN -1 WHEN a >= 3.5 THEN 8 ELSE 0 END AS extra FROM (SELECT unit_id, (1 + unit_id % 3) * (1 + unit_id % 4)::DOUBLE AS a FROM units)")
def area_tiers(spark, sf_dir):
    corner = lambda p, q: F.struct((F.col("x") + p).cast("double").alias("x"), (F.col("y") + q).cast("double").alias("y"))
    w, h = 1 + F.col("unit_id") % 3, 1 + F.col("unit_id") % 4
    area = geo.ring_area(F.array(corner(F.lit(0), F.lit(0)), corner(w, F.lit(0)), corner(w, h), corner(F.lit(0), h)))
    return frame(spark, sf_dir, "units").select("unit_id", F.round(area, 6).alias("area")).withColumn("extra", geo.tier(F.col("area")))


@query(ctes("units") + " SELECT u.unit_id, count(o_orderkey) > 0 AS covered, count(o_orderkey) AS n, coalesce(round(avg(o_totalprice), 4), 0) AS centre FROM units AS u LEFT JOIN orders ON o_custkey % 1000 = u.unit_id GROUP BY u.unit_id")
def coverage_flags(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("unit_id"), "o_totalprice")
    n = orders.groupBy("unit_id").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("centre"))
    return frame(spark, sf_dir, "units").select("unit_id").join(n, "unit_id", "left").select("unit_id", F.col("n").isNotNull().alias("covered"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centre", F.lit(0.0)).alias("centre"))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM customer) SELECT c_custkey AS id, CASE WHEN c_acctbal <= b[2] THEN 1 WHEN c_acctbal <= b[3] THEN 2 WHEN c_acctbal <= b[4] THEN 3 WHEN c_acctbal <= b[5] THEN 4 ELSE 5 END AS bin FROM customer CROSS JOIN q")
def quantile_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    bounds = tables.quantile_bounds(rows, "c_acctbal")
    return rows.select(F.col("c_custkey").alias("id"), tables.binned(F.col("c_acctbal"), bounds).alias("bin"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 0")
def resume_anti_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", "source", "n_chars")
    return tables.remaining(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'dropped' ELSE 'matched' END AS outcome, count(*) AS n, sum(n_chars)::BIGINT AS chars, sum(coalesce(quality, 0))::BIGINT AS good FROM documents AS d LEFT JOIN labels AS l USING (doc_id) GROUP BY 1")
def inner_join_with_drops(spark, sf_dir):
    kept, dropped = tables.matched(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])
    sums = lambda df, name, good: df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.coalesce(F.sum(good), F.lit(0)).cast("bigint").alias("good"))
    return sums(kept, "matched", F.col("quality")).union(sums(dropped, "dropped", F.lit(0))).where("n > 0")


@query("SELECT o_custkey AS id, max(struct_pack(d := o_orderdate, k := o_orderkey)).k AS last_order FROM orders GROUP BY o_custkey")
def keep_last_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", F.col("o_orderkey").alias("last_order"))
    return tables.keep_last(rows, ["id"], ["o_orderdate", "last_order"]).select("id", "last_order")


@query("WITH u AS (SELECT 0 AS source, c_custkey % 500 AS id, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier UNION ALL SELECT 2, p_partkey % 700, p_name FROM part) SELECT id, min(struct_pack(s := source, n := name)).s AS source, min(struct_pack(s := source, n := name)).n AS name FROM u GROUP BY id")
def dedupe_first_across_sources(spark, sf_dir):
    of = lambda t, i, key, name: table(spark, sf_dir, t).select(F.lit(i).alias("source"), F.expr(key).alias("id"), F.col(name).alias("name"))
    rows = of("customer", 0, "c_custkey % 500", "c_name").unionByName(of("supplier", 1, "s_suppkey", "s_name")).unionByName(of("part", 2, "p_partkey % 700", "p_name"))
    return tables.keep_first(rows, ["id"], ["source", "name"]).select("id", "source", "name")


@query(ctes("obs") + ", e AS (SELECT unit_id, pred_income - target_income AS e FROM obs), q AS (SELECT quantile_cont(e, 0.02) AS lo, quantile_cont(e, 0.98) AS hi FROM e) SELECT unit_id, sum(CASE WHEN e > 1 THEN 1.0 ELSE 0 END)::DOUBLE AS over, sum(CASE WHEN e < -1 THEN 1.0 ELSE 0 END)::DOUBLE AS under, round(avg(greatest(lo, least(hi, e))), 6) AS clipped FROM e CROSS JOIN q GROUP BY unit_id")
def residual_flags_clip(spark, sf_dir):
    rows = frame(spark, sf_dir, "obs").select("unit_id", (F.col("pred_income") - F.col("target_income")).alias("e"))
    lo, hi = tables.quantiles(rows, "e", {"lo": 0.02, "hi": 0.98}).first()
    e = F.col("e")
    return rows.groupBy("unit_id").agg(F.sum((e > 1).cast("double")).alias("over"), F.sum((e < -1).cast("double")).alias("under"), F.round(F.avg(vectors.clipped(e, lo, hi)), 6).alias("clipped"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_size % 6 END AS quintile, CASE WHEN p_size % 6 = 0 THEN 'unknown' WHEN p_size % 6 <= 2 THEN 'high' ELSE 'low' END AS level FROM part")
def bucket_level(spark, sf_dir):
    raw = F.when(F.col("p_size") % 6 == 0, "nan").otherwise((F.col("p_size") % 6).cast("string"))
    q = text.whole(text.code(raw)).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), q.alias("quintile"), text.level(q).alias("level"))


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    from areasignal.streaming.resume import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_resume_counts(spark, sf_dir):
    """The events read as a stream, appended by key, and counted; a second run adds nothing."""
    import uuid

    from areasignal.session import shared_folder
    from areasignal.streaming.resume import resume

    at = f"{shared_folder(spark)}/areasignal/streams/{uuid.uuid4().hex}"
    schema = "event_id long, event_type string"
    for _ in range(2):
        resume(spark, f"{sf_dir}/event[s].parquet", schema, f"{at}/table", f"{at}/checkpoint", ["event_id"])
    return spark.read.parquet(f"{at}/table").groupBy("event_type").agg(F.count("*").alias("n"))
