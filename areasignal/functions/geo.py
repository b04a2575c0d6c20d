"""Distances, boxes and polygons in plane or geographic coordinates; rings are arrays of structs x, y."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.session import written

#: Metres of the earth's radius, and of a degree where that is taken as constant.
RADIUS, DEGREE = 6_371_000.0, 111_320.0
#: What a cross product may be off for a point on an edge.
ON_EDGE = 1e-12


def metres_per_degree_lat(lat: Column) -> Column:
    r = F.radians(lat)
    return 111132.92 - 559.82 * F.cos(2 * r) + 1.175 * F.cos(4 * r) - 0.0023 * F.cos(6 * r)


def metres_per_degree_lon(lat: Column) -> Column:
    r = F.radians(lat)
    return 111412.84 * F.cos(r) - 93.5 * F.cos(3 * r) + 0.118 * F.cos(5 * r)


def square_box(lat: Column, lon: Column, side: Column | float) -> Column:
    """The box of a side in metres around a point: min_lon, min_lat, max_lon, max_lat."""
    half = (F.lit(side) if isinstance(side, (int, float)) else side) / 2
    dlat, dlon = half / metres_per_degree_lat(lat), half / metres_per_degree_lon(lat)
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"), (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def centre_radius(min_lon: Column, min_lat: Column, max_lon: Column, max_lat: Column) -> Column:
    """A box's lat, lon and half diagonal in whole metres, between 200 and 50000."""
    lat = (min_lat + max_lat) / 2
    up, across = (max_lat - min_lat) * DEGREE, (max_lon - min_lon) * DEGREE * F.cos(F.radians(lat))
    half = F.greatest(F.lit(200.0), F.least(F.lit(50_000.0), F.sqrt(up * up + across * across) / 2))
    return F.struct(lat.alias("lat"), ((min_lon + max_lon) / 2).alias("lon"), F.floor(half).cast("int").alias("radius"))


def ring_edges(ring: Column) -> Column:
    """Structs x1, y1, x2, y2, each point with the one before it."""
    return F.transform(ring, lambda p, i: F.struct(F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))["x"].alias("x1"), F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")))


def on_segment(px: Column, py: Column, e: Column) -> Column:
    cross = (px - e["x1"]) * (e["y2"] - e["y1"]) - (py - e["y1"]) * (e["x2"] - e["x1"])
    dot = (px - e["x1"]) * (px - e["x2"]) + (py - e["y1"]) * (py - e["y2"])
    return (F.abs(cross) <= ON_EDGE) & (dot <= ON_EDGE)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether the point is inside or on the ring: on an edge, or an odd number of edges to its right."""
    edges = ring_edges(ring)
    at = lambda e: (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"]) + e["x1"]
    crossed = F.size(F.filter(edges, lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (at(e) > px)))
    return (F.size(ring) >= 3) & (F.exists(edges, lambda e: on_segment(px, py, e)) | (crossed % 2 == 1))


def in_polygon(px: Column, py: Column, rings: Column) -> Column:
    """Whether the point is in an odd number of rings; so a hole's edge is outside."""
    return F.size(F.filter(rings, lambda r: in_ring(px, py, r))) % 2 == 1


def ring_area(ring: Column) -> Column:
    """By the shoelace formula, without sign."""
    return F.abs(F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def ring_centroid(ring: Column) -> Column:
    """x and y of the centroid; the mean of the points if the area is 0."""
    z = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, e: Column) -> Column:
        c = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((s["a"] + c).alias("a"), (s["x"] + (e["x1"] + e["x2"]) * c).alias("x"), (s["y"] + (e["y1"] + e["y2"]) * c).alias("y"))

    s = F.aggregate(ring_edges(ring), z, add)
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[f]) / F.size(ring)
    return F.struct(F.when(s["a"] != 0, F.try_divide(s["x"], 3 * s["a"])).otherwise(mean("x")).alias("x"), F.when(s["a"] != 0, F.try_divide(s["y"], 3 * s["a"])).otherwise(mean("y")).alias("y"))


def segment_distance(px: Column, py: Column, e: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - e["x1"]) * dx + (py - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(px - (e["x1"] + t * dx), 2) + F.pow(py - (e["y1"] + t * dy), 2))


def boundary_distance(px: Column, py: Column, rings: Column) -> Column:
    """From the point to the nearest edge of any ring."""
    return F.array_min(F.transform(rings, lambda r: F.array_min(F.transform(ring_edges(r), lambda e: segment_distance(px, py, e)))))


def box_of(ring: Column) -> Column:
    side = lambda f, pick: pick(F.transform(ring, lambda p: p[f]))
    return F.struct(side("x", F.array_min).alias("min_x"), side("y", F.array_min).alias("min_y"), side("x", F.array_max).alias("max_x"), side("y", F.array_max).alias("max_y"))


def tier(ratio: Column, free: float = 6.0, some: float = 3.5, most: int = 8) -> Column:
    """How many more tiles an area of so many tiles' size gets: -1 without limit, `most`, or 0."""
    return F.when(ratio >= free, -1).when(ratio >= some, most).otherwise(0)


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def half_step_grid(box: Column, dx: Column, dy: Column) -> Column:
    """Centres (x, y) of tiles of dx by dy that fit into a box, half a tile apart."""
    steps = lambda low, high, d: F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0.0), (high - low) / d) * 2).cast("int")), lambda i: low + d / 2 + i * d / 2 <= high - d / 2), lambda i: low + d / 2 + i * d / 2)
    xs, ys = steps(box["min_x"], box["max_x"], dx), steps(box["min_y"], box["max_y"], dy)
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def random_points(df: DataFrame, key: str, rings: str, n: int, most: int = 1 << 20) -> DataFrame:
    """key, place (from 0), x and y: the first n of a polygon's hashed points in its box that lie in it, the same for the same
    key. Points are drawn in rounds of growing number, each for the polygons that want some yet, until none does; a polygon
    without area has none, and one that fills less than about a millionth of its box is an error after `most` draws."""
    box = box_of(F.col(rings)[0])
    left = df.select(key, F.col(rings).alias("rings"), box.alias("box")).where(F.coalesce(ring_area(F.col(f"{rings}")[0]), F.lit(0.0)) > 0)
    left = left.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)  # a file of few bytes is one task, but its points are many
    at = lambda low, high, i, axis: low + (high - low) * hashed_unit(F.col(key), i, F.lit(axis))
    first, width, found = 1, 4 * n, None
    while True:
        drawn = left.select(key, "rings", "box", F.explode(F.sequence(F.lit(first), F.lit(first + width - 1))).alias("i"))
        drawn = drawn.select(key, "rings", "i", at(F.col("box.min_x"), F.col("box.max_x"), F.col("i"), "x").alias("x"), at(F.col("box.min_y"), F.col("box.max_y"), F.col("i"), "y").alias("y"))
        inside = drawn.where(in_polygon(F.col("x"), F.col("y"), F.col("rings"))).select(key, "i", "x", "y")
        found = written(inside if found is None else found.union(inside))
        full = found.groupBy(key).count().where(F.col("count") >= n)
        left, first, width = written(left.join(full, key, "left_anti")), first + width, 4 * width
        if not left.take(1):
            break
        if first > most:
            raise ValueError("polygons too thin for their boxes")
    place = F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1
    return found.withColumn("place", place).where(F.col("place") < n).select(key, "place", "x", "y")


def bounds(boxes: DataFrame, names: Sequence[str] = ("min_x", "min_y", "max_x", "max_y")) -> DataFrame:
    """One row: the box of all boxes."""
    return boxes.agg(*((F.min if c.startswith("min") else F.max)(c).alias(c) for c in names))


def byte_scaled(band: Column) -> Column:
    """A band's values as bytes: shares of its largest times 255, cut to whole numbers; where none is above 0, zeros."""
    top = F.array_max(band)
    return F.transform(band, lambda x: F.when(top > 0, F.greatest(F.lit(0), F.least(F.lit(255), (x / top * 255).cast("int")))).otherwise(0))


# The national grid's ellipsoid, scale, origin, and the shift from WGS84 (metres, parts per million, seconds).
GRID = {"a": 6377563.396, "b": 6356256.909, "f0": 0.9996012717, "lat0": 49.0, "lon0": -2.0, "n0": -100000.0, "e0": 400000.0}
SHIFT = {"tx": -446.448, "ty": 125.157, "tz": -542.060, "s": 20.4894e-6, "rx": -0.1502, "ry": -0.2470, "rz": -0.8421}


def national_grid(lat: Column, lon: Column) -> Column:
    """Easting x and northing y in metres (EPSG:27700, within some metres) of WGS84 degrees; null if either is.

    Each step's values are named, so the expression stays small however often the next step uses them.
    """
    sin, cos, lit = F.sin, F.cos, F.lit
    pair = lambda **parts: F.struct(*(c.alias(k) for k, c in parts.items()))
    e = 1 - GRID["b"] ** 2 / GRID["a"] ** 2
    n, p0 = (GRID["a"] - GRID["b"]) / (GRID["a"] + GRID["b"]), GRID["lat0"] * 3.141592653589793 / 180

    def earth_centred(g: Column) -> Column:
        a, e2 = 6378137.0, 0.00669437999014
        nu = lit(a) / F.sqrt(1 - e2 * sin(g["la"]) * sin(g["la"]))
        return pair(x=nu * cos(g["la"]) * cos(g["lo"]), y=nu * cos(g["la"]) * sin(g["lo"]), z=nu * (1 - e2) * sin(g["la"]))

    def shifted(c: Column) -> Column:
        turn = lambda s: SHIFT[s] / 3600 * 3.141592653589793 / 180
        k, x, y, z = 1 + SHIFT["s"], c["x"], c["y"], c["z"]
        return pair(x=SHIFT["tx"] + x * k - y * turn("rz") + z * turn("ry"), y=SHIFT["ty"] + x * turn("rz") + y * k - z * turn("rx"), z=SHIFT["tz"] - x * turn("ry") + y * turn("rx") + z * k)

    def latitude(c: Column) -> Column:
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        nearer = lambda f: F.atan2(c["z"] + e * GRID["a"] / F.sqrt(1 - e * sin(f) * sin(f)) * sin(f), p)
        start = F.atan2(c["z"], p * (1 - e))
        return pair(phi=F.aggregate(F.sequence(lit(1), lit(3)), start, lambda f, _: nearer(f)), w=F.atan2(c["y"], c["x"]) - GRID["lon0"] * 3.141592653589793 / 180)

    def projected(g: Column) -> Column:
        phi, w = g["phi"], g["w"]
        d, s = phi - p0, phi + p0
        arc = GRID["b"] * GRID["f0"] * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * sin(d) * cos(s) + (15 / 8 * n**2 + 15 / 8 * n**3) * sin(2 * d) * cos(2 * s) - 35 / 24 * n**3 * sin(3 * d) * cos(3 * s))
        v = GRID["a"] * GRID["f0"] / F.sqrt(1 - e * sin(phi) * sin(phi))
        ratio = (1 - e * sin(phi) * sin(phi)) / (1 - e)
        eta, t, c = ratio - 1, F.tan(phi), cos(phi)
        north = arc + GRID["n0"] + v / 2 * sin(phi) * c * F.pow(w, 2) + v / 24 * sin(phi) * F.pow(c, 3) * (5 - t * t + 9 * eta) * F.pow(w, 4) + v / 720 * sin(phi) * F.pow(c, 5) * (61 - 58 * t * t + F.pow(t, 4)) * F.pow(w, 6)
        east = GRID["e0"] + v * c * w + v / 6 * F.pow(c, 3) * (ratio - t * t) * F.pow(w, 3) + v / 120 * F.pow(c, 5) * (5 - 18 * t * t + F.pow(t, 4) + 14 * eta - 58 * t * t * eta) * F.pow(w, 5)
        return pair(x=east, y=north)

    at = pair(la=F.radians(lat), lo=F.radians(lon))
    for step in (earth_centred, shifted, latitude, projected):
        at = named(at, step)
    return F.when(lat.isNotNull() & lon.isNotNull(), at)


#: Half of the width of the web Mercator plane (EPSG:3857) over 180 degrees, in metres a degree; the latitude where it ends.
MERCATOR, MERCATOR_END = 20037508.342789244 / 180, 85.0511287798066


def web_mercator(lat: Column, lon: Column) -> Column:
    """x and y in metres (EPSG:3857) of degrees; latitudes beyond the plane's ends are put on them, a null stays null."""
    within = F.when(lat.isNotNull(), F.greatest(F.least(lat, F.lit(MERCATOR_END)), F.lit(-MERCATOR_END)))
    return F.struct((lon * MERCATOR).alias("x"), (F.degrees(F.log(F.tan(F.radians(45 + within / 2)))) * MERCATOR).alias("y"))


def from_web_mercator(x: Column, y: Column) -> Column:
    """lat and lon in degrees of metres (EPSG:3857)."""
    return F.struct((F.degrees(F.atan(F.exp(F.radians(y / MERCATOR)))) * 2 - 90).alias("lat"), (x / MERCATOR).alias("lon"))


def in_plane(rings: Column, projected: bool) -> Column:
    """Rings to draw places from: as they are if their coordinates are projected ones, else (degrees, x the longitude) in web
    Mercator. Places drawn there go back by `from_web_mercator`."""
    return rings if projected else F.transform(rings, lambda ring: F.transform(ring, lambda p: web_mercator(p["y"], p["x"])))


def pixel(x: Column, y: Column, left: float, top: float, size_x: float, size_y: float, width: int, height: int) -> Column:
    """col, row and whether they are inside a raster."""
    col, row = F.floor((x - left) / size_x).cast("int"), F.floor((top - y) / size_y).cast("int")
    return F.struct(col.alias("col"), row.alias("row"), (col.between(0, width - 1) & row.between(0, height - 1)).alias("inside"))
