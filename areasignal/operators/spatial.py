"""Joins of points, boxes and polygons, and features of neighbours."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.functions import geo
from areasignal.operators import metrics, outlines, replicates
from areasignal.session import written


#: Candidates of a unit that the first round of spacing looks at; later rounds look at four times as many each.
HEAD = 256


def points_in_polygons(points: DataFrame, polygons: DataFrame, point: str, polygon: str, size: float, first: bool = True, left: bool = False) -> DataFrame:
    """Joins points (x, y) with polygons (rings, and ord for the order) that hold them: all, or the first by ord.

    Points meet polygons at cells of the polygons' covers, of `size` at least; only those in a border's cell are tested with
    rings. left: points that no polygon holds stay, with a null polygon. Points with null coordinates lie nowhere.
    """
    if not first and not left:
        return outlines.holding(points, polygons, point, polygon, size, keep=points.columns)
    found = outlines.holding(points, polygons, point, polygon, size)
    if first:
        found = found.join(polygons.select(polygon, "ord").hint("merge"), polygon).groupBy(point).agg(F.min_by(polygon, "ord").alias(polygon))
    return points.join(found.select(point, polygon).hint("merge"), point, "left" if left else "inner")


def neighbours(polygons: DataFrame, polygon: str, size: float, tolerance: float = 0.0, once: bool = False) -> DataFrame:
    """src and dst, both ways: polygons that meet, or come within the tolerance of one another (`outlines.contacts`)."""
    return outlines.contacts(polygons, polygon, size, tolerance, once)


def meeting(rows: DataFrame, boxes: DataFrame, key: str, size: float) -> DataFrame:
    """key and met: whether a row's box meets any of the boxes (both of min_x, min_y, max_x, max_y; the union of boxes, kept as it
    is). They meet at grid cells of the size, edges included; repeated boxes are one."""
    cells = lambda df: df.withColumn("cx", F.explode(F.sequence(F.floor(F.col("box.min_x") / size), F.floor(F.col("box.max_x") / size)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("box.min_y") / size), F.floor(F.col("box.max_y") / size))))
    a, b = F.col("box"), F.col("other")
    meet = (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])
    others = cells(boxes.select("box").distinct()).withColumnRenamed("box", "other")
    hit = cells(rows.select(key, "box")).join(others.hint("merge"), ["cx", "cy"]).where(meet).select(key).distinct().withColumn("_met", F.lit(True))
    return rows.select(key).join(hit, key, "left").select(key, F.coalesce("_met", F.lit(False)).alias("met"))


def neighbour_lists(units: DataFrame, unit: str, edges: DataFrame) -> DataFrame:
    """unit and its sorted neighbours; an empty list for a unit alone."""
    lists = edges.groupBy(F.col("src").alias(unit)).agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return units.select(unit).join(lists, unit, "left").withColumn("neighbours", F.coalesce("neighbours", F.array()))


def in_boxes(points: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Points within the boxes (min_x, min_y, max_x, max_y; both ends in) of their own key."""
    return points.join(boxes, key).where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))


def neighbour_means(features: DataFrame, unit: str, columns: list[str], edges: DataFrame) -> DataFrame:
    """unit and for each column its mean over the neighbours that have features; its own value without any."""
    of = features.select(F.col(unit).alias("dst"), *columns)
    means = edges.join(of, "dst").groupBy(F.col("src").alias(unit)).agg(*(F.avg(c).alias(f"_{c}") for c in columns))
    return features.join(means, unit, "left").select(unit, *(F.coalesce(f"_{c}", c).alias(f"{c}_lag") for c in columns))


def ego_gap(features: DataFrame, unit: str, columns: list[str], edges: DataFrame) -> DataFrame:
    """unit and for each column its own value less its neighbours' mean."""
    return features.join(neighbour_means(features, unit, columns, edges), unit).select(unit, *((F.col(c) - F.col(f"{c}_lag")).alias(f"{c}_gap") for c in columns))


def target_lag(targets: DataFrame, unit: str, fold: str, columns: list[str], edges: DataFrame, folds: list[int]) -> DataFrame:
    """held_out, unit and for each column the mean over its neighbours outside the held-out fold, else over all such units.

    No value of a held-out unit is read, so predictions for it can't see its label or its fold's.
    """
    rows = targets.select(F.col(unit).alias("dst"), F.col(fold).alias("_f"), *columns)
    by_fold = edges.join(rows, "dst").groupBy("src", "_f").agg(*(f(c).alias(f"_{i}_{c}") for c in columns for i, f in enumerate((F.sum, F.count))))
    held = targets.sparkSession.createDataFrame([(k,) for k in folds], "held_out int")
    near = by_fold.join(F.broadcast(held), F.col("_f") != F.col("held_out")).groupBy("held_out", F.col("src").alias(unit)).agg(*(F.try_divide(F.sum(f"_0_{c}"), F.sum(f"_1_{c}")).alias(f"_n_{c}") for c in columns))
    all_ = rows.groupBy("_f").agg(*(f(c).alias(f"_{i}_{c}") for c in columns for i, f in enumerate((F.sum, F.count)))).join(F.broadcast(held), F.col("_f") != F.col("held_out"))
    all_ = all_.groupBy("held_out").agg(*(F.try_divide(F.sum(f"_0_{c}"), F.sum(f"_1_{c}")).alias(f"_g_{c}") for c in columns))
    out = targets.select(unit, fold).withColumn("held_out", F.explode(F.array(*map(F.lit, folds))))
    return out.join(near, ["held_out", unit], "left").join(F.broadcast(all_), "held_out").select("held_out", unit, fold, *(F.coalesce(f"_n_{c}", f"_g_{c}").alias(f"{c}_lag") for c in columns))


def spaced(points: DataFrame, unit: str, order: str, metres: float, most: int, areas: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """unit and accepted: an array of the points (lat, lon) taken in order that are at least so far from those before.

    areas (unit and rings, x the longitude): points outside their unit's box or polygon don't count; seen (the column order):
    nor do those seen before. Points without a place are left out.

    Units go on in rounds: the first HEAD candidates of each in order (the limit holds before the shuffle, so no task gets a
    whole unit) are taken one after the other; then what comes near an accepted one, and units that are full, drop out.
    """
    rows = points.where("lat IS NOT NULL AND lon IS NOT NULL").select(unit, order, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    if seen is not None:
        rows = rows.join(seen.select(order), order, "left_anti").select(unit, order, "lat", "lon")
    if areas is not None:
        near = rows.join(areas.select(unit, "rings", geo.box_of(F.col("rings")[0]).alias("_b")), unit)
        near = near.where(F.col("lon").between(F.col("_b.min_x"), F.col("_b.max_x")) & F.col("lat").between(F.col("_b.min_y"), F.col("_b.max_y")))
        rows = near.where(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))).select(unit, order, "lat", "lon")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (unit, order)}
    names, radius = [unit, order, "lat", "lon", "_id"], geo.RADIUS

    def far(a: tuple, p: tuple) -> bool:
        h = math.sin(math.radians(p[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(p[1])) * math.sin(math.radians(p[2] - a[2]) / 2) ** 2
        return not 2 * radius * math.asin(math.sqrt(min(1.0, h))) < metres

    def run(batches):
        now, taken, none = None, [], True
        for batch in batches:
            us, orders, lats, lons, _, before = (c.to_pylist() for c in batch.columns)
            keep = []
            for i, u in enumerate(us):
                if none or u != now:
                    now, taken, none = u, [], False
                p = (orders[i], lats[i], lons[i])
                if before[i]:
                    taken.append(p)
                elif len(taken) < most and all(far(a, p) for a in taken):
                    taken.append(p)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(list(range(5)))

    open_ = written(rows.withColumn("_id", F.monotonically_increasing_id()).select(*names))
    taken, first, place = None, max(HEAD, 4 * most), F.struct(order, "lat", "lon", "_id")
    while open_.take(1):
        ranked = open_.withColumn("_n", F.row_number().over(Window.partitionBy(unit).orderBy(order, "lat", "lon", "_id")))
        head = written(ranked.where(F.col("_n") <= first).select(*names))
        seeds = head.select(*names, F.lit(False).alias("_before"))
        seeds = seeds if taken is None else seeds.union(taken.join(head.select(unit).distinct(), unit, "left_semi").select(*names, F.lit(True)))
        sorted_ = seeds.repartition(unit).sortWithinPartitions(unit, F.col("_before").desc(), order, "lat", "lon", "_id")
        new = sorted_.mapInArrow(run, f"`{unit}` {kinds[unit]}, `{order}` {kinds[order]}, lat double, lon double, _id bigint")
        taken = written(new if taken is None else taken.union(new))
        upto = head.groupBy(F.col(unit).alias("_u")).agg(F.max(place).alias("_upto"))
        full = taken.groupBy(F.col(unit).alias("_u")).count().where(F.col("count") >= most).select("_u")
        left = open_.join(upto, F.col(unit) == F.col("_u"), "left").where(F.col("_upto").isNull() | (place > F.col("_upto"))).select(*names).join(full, F.col(unit) == F.col("_u"), "left_anti")
        near = taken.select(F.col(unit).alias("_u"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
        meets = (F.col(unit) == F.col("_u")) & (geo.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) < metres)
        open_, first = written(left.join(near, meets, "left_anti")), 4 * first
    found = (open_ if taken is None else taken).select(unit, order, "lat", "lon")
    return found.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct(order, "lat", "lon"))).alias("accepted"))


def _centred(values: DataFrame, unit: str, value: str, by: Sequence[str]) -> DataFrame:
    """by, unit, z (the value less its mean), sd and n (of all units of a `by`), written once. Nulls are left out."""
    v = written(values.where(F.col(value).isNotNull()).select(*by, unit, F.col(value).cast("double").alias("z")))
    m = v.groupBy(*by).agg(F.avg("z").alias("mean"), F.when(metrics.varies(F.col("z")), F.stddev_pop("z")).otherwise(0.0).alias("sd"), F.count("*").alias("n"))
    joined = v.join(m, list(by)) if by else v.crossJoin(F.broadcast(m))  # without keys one row
    return written(joined.select(*by, unit, (F.col("z") - F.col("mean")).alias("z"), "sd", "n"))


def _lagged(z: DataFrame, unit: str, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, unit, z, sd, n, lag (the mean of the neighbours' z) and k (their number); units without neighbours are left out."""
    lag = edges.join(z.select(*by, F.col(unit).alias("dst"), "z"), "dst").groupBy(*by, F.col("src").alias(unit)).agg(F.avg("z").alias("lag"), F.count("*").alias("k"))
    return z.join(lag, [*by, unit])


def moran(values: DataFrame, unit: str, value: str, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, n, moran_i and expected of a value on the neighbour graph, weights of each unit adding up to 1; null for a constant."""
    return _moran(_centred(values, unit, value, by), unit, edges, by)


def _moran(z: DataFrame, unit: str, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    r = _lagged(z, unit, edges, by).groupBy(*by).agg(F.first("n").alias("n"), F.first("sd").alias("sd"), F.sum(F.col("z") * F.col("lag")).alias("up"), F.count("*").alias("s0"))
    i = F.when(F.col("sd") > 0, F.try_divide(F.col("up"), F.col("s0") * F.col("sd") * F.col("sd")))
    return r.select(*by, "n", i.alias("moran_i"), F.try_divide(F.lit(-1.0), F.col("n") - 1.0).alias("expected"))


def _quadrant(z: Column, lag: Column) -> Column:
    return F.when((z > 0) & (lag > 0), 1).when((z <= 0) & (lag > 0), 2).when(z <= 0, 3).otherwise(4)


def lisa(values: DataFrame, unit: str, value: str, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, unit, z (of the value), lag (of z) and quadrant: 1 high among high, 2 low among high, 3 low among low, 4 high among low."""
    found = _lagged(_centred(values, unit, value, by), unit, edges, by)
    out = found.select(*by, unit, F.try_divide("z", "sd").alias("z"), F.try_divide("lag", "sd").alias("lag"))
    return out.withColumn("quadrant", _quadrant(F.col("z"), F.col("lag")))


def _order(seed: int):
    """The hash that units are put in order b by."""
    return lambda b, unit: geo.hashed_unit(F.lit(seed), b, unit)


def lisa_significance(values: DataFrame, unit: str, value: str, edges: DataFrame, by: Sequence[str] = (), times: int = 999, seed: int = 42, level: float = 0.05) -> DataFrame:
    """by, unit, local_i, quadrant, p_sim and cluster: the quadrant where p_sim is below the level, else 0.

    Conditional permutations: a unit of k neighbours gets in each of `times` orders by hash the k units that follow it, round
    the end: others than itself, each at most once. p_sim is the share of orders whose local I is at least (or at most, if
    those are fewer) the unit's own. Values are compared to nine digits, so equal neighbourhoods count as equal.
    """
    z = _centred(values, unit, value, by)
    z = z.withColumn("w", F.greatest(F.col("sd") * F.col("sd"), F.lit(1e-300)))  # the same within the keys
    found = written(_lagged(z, unit, edges, by))
    centred = found.select(*by, unit, "k", "w", F.round(F.col("z") * F.col("lag") / F.col("w"), 9).alias("local_i"), _quadrant(F.col("z"), F.col("lag")).alias("quadrant"))
    most = found.agg(F.max("k")).first()[0] or 0
    asked = z.join(centred.select(*by, unit, "k", "local_i"), [*by, unit], "left")
    above = replicates.share_above(asked, unit, "z", by, times, _order(seed), int(most))
    p = (F.least("above", F.lit(times) - F.col("above")) + 1) / (times + 1)
    out = centred.join(above, [*by, unit]).select(*by, unit, "local_i", "quadrant", p.alias("p_sim"))
    return out.withColumn("cluster", F.when(F.col("p_sim") < level, F.col("quadrant")).otherwise(0))


def moran_p(values: DataFrame, unit: str, value: str, edges: DataFrame, times: int = 999, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """by, moran_i, p and z_sim: values are dealt anew by hashed order `times` times, as one array a unit. p is the share of
    deals whose I is at least (or at most) the real one, to nine digits."""
    z = _centred(values, unit, value, by)
    real = _moran(z, unit, edges, by).select(*by, "moran_i")
    dealt = written(replicates.permuted(z, unit, "z", by, times, _order(seed)))
    sds = z.groupBy(*by).agg(F.first("sd").alias("sd"))
    sums = replicates.lag_products(dealt, unit, edges, by, times)
    sums = sums.join(sds, list(by)) if by else sums.crossJoin(F.broadcast(sds))  # without keys one row
    i = sums.select(*by, "b", F.try_divide(F.col("up"), F.col("s0") * F.col("sd") * F.col("sd")).alias("i"))
    both = i.join(real, list(by)) if by else i.crossJoin(F.broadcast(real))  # without keys one row
    above = F.count_if(F.round("i", 9) >= F.round("moran_i", 9))
    return both.groupBy(*by).agg(F.first("moran_i").alias("moran_i"), ((F.least(above, F.count("*") - above) + 1) / (F.count("*") + 1)).alias("p"), F.try_divide(F.first("moran_i") - F.avg("i"), F.stddev_pop("i")).alias("z_sim"))


def placed_boxes(areas: DataFrame, unit: str, existing: DataFrame, size: float, most: str = "most", margin: float = 0.0) -> DataFrame:
    """unit, place, x, y of further boxes in areas (rings, cx, cy, ord and the column `most`; below 0: no limit).

    Candidates on a half-step grid lie in the area and farther than the margin from its edge. They are made and tested in
    parallel, and those that meet an existing box (x, y) drop out at grid cells. What is left goes in by areas in their order,
    nearest to the centre first, in rounds: a candidate that meets no open one before it goes in (of an area with a limit,
    only if none before it waits), and those that it meets go out; boxes meet at grid cells alone. Files of candidates are far
    smaller than their rows in all cells around, so joins are by merging and nothing is sent to the driver.
    """
    box = geo.box_of(F.col("rings")[0])
    grid = outlines.dealt(areas, unit).select(unit, "ord", "cx", "cy", "rings", F.col(most).alias("_most"), F.explode(geo.half_step_grid(box, F.lit(size), F.lit(size))).alias("p"))
    inside = geo.in_polygon(F.col("p.x"), F.col("p.y"), F.col("rings")) & (geo.boundary_distance(F.col("p.x"), F.col("p.y"), F.col("rings")) > margin)
    fine = grid.where(inside).select(unit, "ord", "_most", "p.x", "p.y", F.hypot(F.col("p.x") - F.col("cx"), F.col("p.y") - F.col("cy")).alias("far"))
    steps = lambda c: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(c) / size) + d)
    around = lambda df: df.withColumn("ocx", F.explode(steps("ox"))).withColumn("ocy", F.explode(steps("oy")))
    own = lambda df: df.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    near = (F.col("cx") == F.col("ocx")) & (F.col("cy") == F.col("ocy")) & (F.abs(F.col("x") - F.col("ox")) <= size) & (F.abs(F.col("y") - F.col("oy")) <= size)
    clear = lambda df, boxes: own(df).join(around(boxes).hint("merge"), near, "left_anti").drop("cx", "cy")
    place, order = F.struct("far", "y", "x"), Window.partitionBy(unit).orderBy("far", "y", "x")
    rank = F.struct("ord", "far", "y", "x")
    open_ = written(clear(fine, existing.select(F.col("x").alias("ox"), F.col("y").alias("oy"))).select(unit, "ord", "_most", "far", "y", "x").withColumn("_id", F.monotonically_increasing_id()))
    taken = []
    while open_.take(1):
        others = around(open_.select(rank.alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")))
        free = written(own(open_).join(others.hint("merge"), near & (F.col("other") < rank), "left_anti").drop("cx", "cy"))
        # of a unit with a limit, one that comes after one that waits may not be among the first: it waits too
        waits = open_.where("_most >= 0").join(free.select("_id").hint("merge"), "_id", "left_anti").groupBy(unit).agg(F.min(place).alias("_from"))
        first = free.join(waits.hint("merge"), unit, "left").where(F.col("_from").isNull() | (place < F.col("_from")))
        numbered = first.withColumn("place", F.row_number().over(order))
        taken.append(written(numbered.where((F.col("_most") < 0) | (F.col("place") <= F.col("_most"))).select(unit, "_most", "far", "y", "x")))
        # open ones that meet none just taken (which meet themselves), of units that are not full
        n = taken[-1].where("_most >= 0").groupBy(unit).agg(F.count("*").alias("_n"))
        left = clear(open_, taken[-1].select(F.col("x").alias("ox"), F.col("y").alias("oy"))).join(n.hint("merge"), unit, "left")
        left = left.withColumn("_most", F.when(F.col("_most") < 0, F.col("_most")).otherwise(F.col("_most") - F.coalesce("_n", F.lit(0))).cast(open_.schema["_most"].dataType))
        open_ = written(left.where("_most <> 0").select(*open_.columns))
    found = functools.reduce(DataFrame.union, [t.select(unit, "far", "y", "x") for t in taken] or [open_.select(unit, "far", "y", "x")])
    return found.select(unit, F.row_number().over(order).alias("place"), "x", "y")
