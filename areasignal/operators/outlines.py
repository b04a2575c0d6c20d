"""Outlines at scale: contact of polygons by their segments, and covers of polygons by cells of fitting size.

Cells lie on nested square grids: those of level l have sides of size * 2^l. What is large goes to large cells, so that nothing
has more than a bounded number of them, and what is small looks at the cells of all levels in use that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areasignal.functions import geo
from areasignal.session import ship, written

#: How often a cover's border cells are split, and how far apart a point and an edge that count as touching may be.
DEPTH, NEAR = 4, 1e-9
#: Edges of the polygons that a task splits together; edges that an outline may have to be compared as a whole; edges that a
#: border cell may carry.
EDGES, FEW, CARRIED = 1 << 12, 16, 64
#: Boxes of a cell that are compared with as many at once; pairs that a small cell has; pairs in one step; tasks of comparing.
HELD, FEW_PAIRS, PAIRS, TASKS = 1 << 13, 1 << 10, 1 << 17, 1 << 11


def segments(polygons: DataFrame, polygon: str) -> DataFrame:
    """A row for each edge of all rings: polygon, x1, y1, x2, y2; edges with null ends are left out."""
    edges = F.flatten(F.transform("rings", geo.ring_edges))
    return polygons.select(polygon, F.explode(edges).alias("e")).select(polygon, "e.x1", "e.y1", "e.x2", "e.y2").dropna()


def _level(extent: Column, size: float) -> Column:
    """The first level whose cells are as wide as the extent, from 0."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent / size, F.lit(1.0)))).cast("int"))


def _span(low: Column, high: Column, side: Column) -> Column:
    return F.sequence(F.floor(low / side).cast("long"), F.floor(high / side).cast("long"))


def _with_cells(df: DataFrame, level: Column, low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> DataFrame:
    side = F.lit(size) * F.pow(F.lit(2.0), level)
    return df.withColumn("cx", F.explode(_span(low_x, high_x, side))).withColumn("cy", F.explode(_span(low_y, high_y, side)))


def segments_near(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two segments (structs x1, y1, x2, y2) cross or come within the tolerance."""
    side = lambda px, py, e: (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])
    apart = lambda p, q: p * q < 0
    cross = apart(side(a["x1"], a["y1"], b), side(a["x2"], a["y2"], b)) & apart(side(b["x1"], b["y1"], a), side(b["x2"], b["y2"], a))
    ends = [geo.segment_distance(p[f"x{i}"], p[f"y{i}"], q) for p, q in ((a, b), (b, a)) for i in (1, 2)]
    return cross | (F.least(*ends) <= tolerance + NEAR)


def _boxes(polygons: DataFrame, polygon: str, tolerance: float, size: float) -> DataFrame:
    """A row for each polygon: polygon, e (the ends of all edges of its rings, x1, y1, x2, y2 one after the other),
    its box and level, and whether it is plain: few edges, of rings of three finite corners and more. Edges with null or undefined
    ends are left out."""
    ends = lambda e: [e[c] for c in ("x1", "y1", "x2", "y2")]
    whole = lambda e: F.forall(F.array(*ends(e)), lambda v: v.isNotNull() & ~F.isnan(v))
    edges = F.filter(F.flatten(F.transform("rings", geo.ring_edges)), whole)
    finite = lambda p: F.coalesce(F.abs(p["x"]) < float("inf"), F.lit(False)) & F.coalesce(F.abs(p["y"]) < float("inf"), F.lit(False))
    whole_rings = F.forall("rings", lambda r: F.coalesce((F.size(r) >= 3) & F.forall(r, finite), F.lit(False)))
    rows = polygons.select(polygon, F.flatten(F.transform(edges, lambda e: F.array(*ends(e)))).alias("e"), whole_rings.alias("plain"))
    rows = rows.withColumn("plain", F.col("plain") & (F.size("e") <= 4 * FEW))
    side = lambda i, pick: pick(F.filter("e", lambda v, k: k % 2 == i))
    rows = rows.withColumns({"low_x": side(0, F.array_min), "high_x": side(0, F.array_max), "low_y": side(1, F.array_min), "high_y": side(1, F.array_max)})
    return rows.withColumn("level", _level(F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) + 2 * (tolerance + NEAR), size))


def _near_edges(batch: pa.RecordBatch, wide: float) -> np.ndarray:
    """Which rows have, of their third and fourth columns (ends of edges), two edges that cross or come within a distance; where
    the fifth says so, also those of which one outline lies in the other."""
    out = np.zeros(batch.num_rows, bool)
    plain = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
    count = [pc.list_value_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) // 4 for c in (2, 3)]
    ends = [batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4) for c in (2, 3)]
    first = [np.cumsum(n) - n for n in count]

    def distance(px, py, e):
        dx, dy = e[2] - e[0], e[3] - e[1]
        long = dx * dx + dy * dy
        t = np.clip(((px - e[0]) * dx + (py - e[1]) * dy) / np.where(long == 0, 1.0, long), 0.0, 1.0) * (long != 0)
        return np.hypot(px - (e[0] + t * dx), py - (e[1] + t * dy))

    turn = lambda px, py, e: (e[2] - e[0]) * (py - e[1]) - (e[3] - e[1]) * (px - e[0])
    for rows in _parts(count[0] * count[1], 1 << 17):
        n = (count[0] * count[1])[rows]
        at = np.repeat(np.arange(rows.start, rows.stop), n)
        i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        a, b = ends[0][first[0][at] + i // count[1][at]].T, ends[1][first[1][at] + i % count[1][at]].T
        meet = np.ones(len(at), bool)
        for p, q in ((a, b), (b, a)):
            for c in (0, 1):
                meet &= np.minimum(p[c], p[c + 2]) <= np.maximum(q[c], q[c + 2]) + wide
        at, a, b = at[meet], a[:, meet], b[:, meet]
        cross = (turn(a[0], a[1], b) * turn(a[2], a[3], b) < 0) & (turn(b[0], b[1], a) * turn(b[2], b[3], a) < 0)
        far = np.minimum.reduce([distance(p[k], p[k + 1], q) for p, q in ((a, b), (b, a)) for k in (0, 2)]) if len(at) else np.zeros(0)
        out[at[cross | (far <= wide)]] = True
    for p, q in ((0, 1), (1, 0)):  # outlines that don't come near hold all corners of a ring or none
        apart = np.flatnonzero(plain & ~out)
        for part in _parts((count[0] * count[1])[apart], 1 << 17):
            rows = apart[part]
            corner = np.repeat(rows, count[p][rows])
            k = np.arange(len(corner)) - np.repeat(np.cumsum(count[p][rows]) - count[p][rows], count[p][rows])
            x, y = ends[p][first[p][corner] + k, :2].T
            n = count[q][corner]
            own = np.repeat(np.arange(len(corner)), n)
            x1, y1, x2, y2 = ends[q][first[q][corner][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)].T
            up = (y1 > y[own]) != (y2 > y[own])
            own, x1, y1, x2, y2 = (v[up] for v in (own, x1, y1, x2, y2))
            right = x1 + (y[own] - y1) / (y2 - y1) * (x2 - x1) > x[own]
            out[corner[np.bincount(own[right], minlength=len(corner)) % 2 == 1]] = True
    return out


def _near_outlines(boxes: DataFrame, polygon: str, tolerance: float, size: float, both: bool = False) -> DataFrame:
    """a and b, each pair once (or both ways): polygons of `_boxes` of which two edges come near, or, if both are plain, one lies in
    the other. Boxes meet at cells of the larger one's size, a pair in the one cell that has the lower left corner of what they share.

    Cells are sorted and compared by many tasks, which hold one of them at a time. One of more than HELD boxes is parted by hash into
    blocks, and each two blocks are a cell of their own. Cells so parted are fewer than their rows by HELD, so those are broadcast.
    """
    ship(boxes.sparkSession)
    boxes = boxes.where(F.col(polygon).isNotNull())
    wide, kind = tolerance + NEAR, boxes.schema[polygon].dataType.simpleString()
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())
    box, cell = ("low_x", "low_y", "high_x", "high_y"), ["level", "cx", "cy"]
    boxes = boxes.withColumns({c: F.col(c) + (wide / 2 if c.startswith("high") else -wide / 2) for c in box})  # alike on both sides: so a pair's cell doesn't depend on which is a
    own = _with_cells(boxes, F.col("level"), *map(F.col, box), size).select(*cell, F.lit(0).alias("kind"), F.lit(True).alias("same"), polygon, "e", "plain")
    probe = boxes.withColumn("at", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda l: l >= F.col("level")))) if levels else boxes.withColumn("at", F.col("level"))
    probe = _with_cells(probe, F.col("at"), *map(F.col, box), size).select(F.col("at").alias("level"), "cx", "cy", F.lit(1).alias("kind"), (F.col("level") == F.col("at")).alias("same"), polygon, "e", "plain")
    rows = own.union(probe)
    counts = rows.groupBy(*cell).agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("m"))
    counts = counts.select(*cell, "n", "m", F.ceil(F.greatest("n", "m") / HELD).cast("int").alias("k"))
    most, moved = counts.where("n > 0 AND m > 0").agg(F.max("k"), F.sum((F.col("n") + F.col("m")) * F.col("k"))).first()
    if (most or 0) > 1:
        rows = rows.join(F.broadcast(counts.where("k > 1").select(*cell, "k")), cell, "left").withColumn("k", F.coalesce("k", F.lit(1)))
        block, every = F.pmod(F.xxhash64(polygon), F.col("k")).cast("int"), F.sequence(F.lit(0), F.col("k") - 1)
        pairs = F.when(F.col("kind") == 0, F.transform(every, lambda j: F.struct(block.alias("i"), j.alias("j"))))
        pairs = pairs.otherwise(F.transform(F.when(F.col("same"), F.sequence(F.lit(0), block)).otherwise(every), lambda i: F.struct(i.alias("i"), block.alias("j"))))
        rows = rows.withColumn("p", F.explode(pairs)).withColumns({"i": F.col("p.i"), "j": F.col("p.j")})
    else:
        rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    tasks = max(4 * boxes.sparkSession.sparkContext.defaultParallelism, min(TASKS, (moved or 0) // HELD))
    order = [*cell, "i", "j"]
    rows = rows.select(*order, "kind", "same", polygon, "e", "plain").repartition(tasks, *order).sortWithinPartitions(*order, "kind")

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            last = _starts(table)[-1] if table.num_rows else 0
            held = table.slice(last)
            yield from pairs_of(table.slice(0, last))
        if held is not None:
            yield from pairs_of(held)

    def pairs_of(table):
        if table.num_rows:
            ids = table.column(7).combine_chunks()
            for a, n, b in _meeting(table, wide, size):
                offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.ListArray.from_arrays(offsets, ids.take(pa.array(b)))], ["a", "b"])

    met = rows.mapInArrow(run, f"a {kind}, b array<{kind}>").select("a", F.explode("b").alias("b"))  # lists, as a row a pair takes far longer
    if not both:
        return met
    back = F.col("back")
    return met.withColumn("back", F.explode(F.array(F.lit(False), F.lit(True)))).select(F.when(back, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(back, F.col("a")).otherwise(F.col("b")).alias("b"))


def _starts(table: pa.Table) -> np.ndarray:
    """Where a cell's rows begin in rows sorted by cell (the first five columns)."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in range(5):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _rectangles(ends: np.ndarray, count: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of outlines (edges one after the other) the one or two rectangles (low x, low y, high x, high y) that they are made of, and how
    many: 0 if an outline isn't one ring of four or six edges, in turn along either axis. No two of those edges overlap."""
    out, number = np.zeros((len(count), 2, 4)), np.zeros(len(count), np.int64)
    first = np.cumsum(count) - count
    for n in (4, 6):
        at = np.flatnonzero(plain & (count == n))
        e = ends[first[at][:, None] + np.arange(n)]
        flat, up = (e[..., 1] == e[..., 3]) & (e[..., 0] != e[..., 2]), (e[..., 0] == e[..., 2]) & (e[..., 1] != e[..., 3])
        after = np.roll(e, -1, 1)
        fits = ((flat & np.roll(up, -1, 1)) | (up & np.roll(flat, -1, 1))).all(1) & (e[..., 2:] == after[..., :2]).all((1, 2))
        at, e, flat = at[fits], e[fits], flat[fits]
        number[at] = n // 2 - 1
        across, along = e[flat].reshape(-1, n // 2, 4), e[~flat].reshape(-1, n // 2, 4)
        xs = np.sort(along[..., 0], 1)
        if n == 4:
            out[at, 0] = np.stack([xs[:, 0], across[..., 1].min(1), xs[:, 1], across[..., 1].max(1)], 1)
            continue
        low, high = np.minimum(across[..., 0], across[..., 2]), np.maximum(across[..., 0], across[..., 2])
        for k in (0, 1):
            there = (low <= xs[:, k, None]) & (high >= xs[:, k + 1, None])
            out[at, k] = np.stack([xs[:, k], np.where(there, across[..., 1], np.inf).min(1), xs[:, k + 1], np.where(there, across[..., 1], -np.inf).max(1)], 1)
    out[number == 1, 1] = out[number == 1, 0]
    return out, number


def _gap(a: np.ndarray, b: np.ndarray, wide: float) -> np.ndarray:
    """Whether rectangles (low x, low y, high x, high y in the first axis) come within a distance."""
    x, y = (np.maximum(np.maximum(a[c] - b[c + 2], b[c] - a[c + 2]), 0.0) for c in (0, 1))
    x *= x
    y *= y
    x += y
    return x <= wide * wide


def _meeting(table: pa.Table, wide: float, size: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of kind 0, with how many of kind 1 in the same cell their outline comes near, and those, one's after the other's. An outline
    in another one comes near it."""
    level, cx, cy, i, j, kind, same = (table.column(c).to_numpy() for c in range(7))
    code = table.column(7).combine_chunks().dictionary_encode().indices.to_numpy()
    edges, plain = table.column(8).combine_chunks(), table.column(9).to_numpy()
    count = pc.list_value_length(edges).to_numpy().astype(np.int64) // 4
    ends = edges.flatten().to_numpy().reshape(-1, 4)
    first = np.cumsum(count) - count
    low = np.minimum.reduceat(np.minimum(ends[:, :2], ends[:, 2:]), first) - wide / 2
    high = np.maximum.reduceat(np.maximum(ends[:, :2], ends[:, 2:]), first) + wide / 2
    box = np.concatenate([low, high], 1)
    here = np.floor(low / (size * 2.0**level)[:, None]).astype(np.int64) == np.stack([cx, cy], 1)
    parts, number = _rectangles(ends, count, plain)
    start = _starts(table)
    mine = np.add.reduceat(kind == 0, start)
    theirs = np.diff(np.append(start, len(kind))) - mine

    def told(a, b):  # pairs with an outline that isn't made of rectangles
        for at in _parts(count[a] * count[b], 1 << 20):
            rows = pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), edges.take(pa.array(a[at])), edges.take(pa.array(b[at])), pa.array(plain[a[at]] & plain[b[at]])], list("abcde"))
            near = _near_edges(rows, wide)
            yield a[at][near], np.ones(near.sum(), np.int64), b[at][near]

    few = np.flatnonzero((mine * theirs > 0) & (mine * theirs <= FEW_PAIRS))
    for part in _parts((mine * theirs)[few], 1 << 17):
        cell = few[part]
        n = (mine * theirs)[cell]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of, begin = np.repeat(theirs[cell], n), np.repeat(start[cell], n)
        a, b = begin + k // of, begin + np.repeat(mine[cell], n) + k % of
        keep = np.where(same[b] & (i[b] == j[b]), code[a] < code[b], code[a] != code[b]) & (here[a] | here[b]).all(1) & (low[a] <= high[b]).all(1) & (low[b] <= high[a]).all(1)
        a, b = a[keep], b[keep]
        plainly = (number[a] > 0) & (number[b] > 0)
        yield from told(a[~plainly], b[~plainly])
        a, b = a[plainly], b[plainly]
        near = np.logical_or.reduce([_gap(parts[a, p].T, parts[b, q].T, wide) for p in (0, 1) for q in (0, 1)])
        yield a[near], np.ones(near.sum(), np.int64), b[near]

    for cell in np.flatnonzero(mine * theirs > FEW_PAIRS):
        rows = np.arange(start[cell], start[cell] + mine[cell] + theirs[cell])
        rows = rows[np.lexsort((code[rows], number[rows], kind[rows]))]  # those of two rectangles last
        a, b = rows[: mine[cell]], rows[mine[cell] :]
        within = same[b] & (i[b] == j[b])  # the same outlines as a, in the same order
        for b, later in ((b[within], True), (b[~within], False)):
            odd = (number[a] == 0).any() or (number[b] == 0).any()
            repeated = len(np.unique(code[a])) < len(a) if later else np.isin(code[b], code[a]).any()
            for p, n, q in _near_pairs(box, here, parts, number, a, b, wide, later) if len(b) else ():
                if odd or repeated:
                    p = np.repeat(p, n)
                    p, q = p[code[p] != code[q]], q[code[p] != code[q]]
                    plainly = (number[p] > 0) & (number[q] > 0)
                    yield from told(p[~plainly], q[~plainly])
                    p, n, q = p[plainly], np.ones(plainly.sum(), np.int64), q[plainly]
                yield p, n, q


class _Ranks:
    """Comparisons of bounds of rectangles, as whole numbers: where a's would lie among the sorted ones of b."""

    def __init__(self, a: np.ndarray, b: np.ndarray, wide: float):
        kind = np.uint16 if len(b) < 1 << 16 else np.uint32
        self.a, self.b, self.wide, self.ranks = a, b, wide, []
        for c in (0, 1):
            low, high = (np.argsort(b[:, k], kind="stable") for k in (c, c + 2))
            rank = [np.empty(len(b), kind), np.empty(len(b), kind)]
            for r, order in zip(rank, (low, high)):
                r[order] = np.arange(len(b))
            first = [np.searchsorted(b[high, c + 2], a[:, c] - w, "left").astype(np.int64) for w in (0.0, wide)]
            past = [np.searchsorted(b[low, c], a[:, c + 2] + w, "right").astype(np.int64) for w in (0.0, wide)]
            self.ranks.append((*rank, first, past))
        self.kind = kind

    def near(self, p: slice, q: slice) -> np.ndarray:
        """Which of the rectangles come within the distance."""
        over, beside = [], []
        for low, high, first, past in self.ranks:
            for out, k in ((over, 0), (beside, 1)):
                # none lies so high, or all lie lower: bounds that the ranks' kind may not hold
                least, most = np.minimum(first[k][p], len(self.b) - 1).astype(self.kind), np.maximum(past[k][p] - 1, 0).astype(self.kind)
                m = high[q] >= least[:, None]
                m &= low[q] <= most[:, None]
                if not (some := (first[k][p] < len(self.b)) & (past[k][p] > 0)).all():
                    m &= some[:, None]
                out.append(m)
        both = beside[0] & beside[1]
        sure = over[0]
        sure |= over[1]
        sure &= both
        both ^= sure
        if both.any():  # apart along both axes
            i, j = np.nonzero(both)
            sure[i, j] = _gap(self.a[p][i].T, self.b[q][j].T, self.wide)
        return sure


def _near_pairs(box: np.ndarray, here: np.ndarray, parts: np.ndarray, number: np.ndarray, a: np.ndarray, b: np.ndarray, wide: float, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As `_meeting` rows a and b (both by number of rectangles) that meet in this cell and come near, or whose boxes do where one isn't
    made of rectangles. later: a and b are the same outlines, and each pair is made once."""
    (odd_a, two_a), (odd_b, two_b) = (np.searchsorted(number[r], [1, 2]) for r in (a, b))
    items = lambda r, two: np.concatenate([parts[r, 0], parts[r[two:], 1]])
    ranks = _Ranks(items(a, two_a), items(b, two_b), wide)
    step = max(1, PAIRS // len(b))
    for at in range(0, len(a), step):
        to, low = min(at + step, len(a)), at if later else 0
        near = np.zeros((to - at, len(b) - low), bool)
        o, t, ob, tb = max(odd_a, at), max(two_a, at), max(odd_b, low), max(two_b, low)  # where those of one and two begin
        second_a, second_b = slice(len(a) + t - two_a, len(a) + max(to, t) - two_a), slice(len(b) + tb - two_b, None)
        if o < to:
            near[o - at :, ob - low :] = ranks.near(slice(o, to), slice(ob, len(b)))
            near[o - at :, tb - low :] |= ranks.near(slice(o, to), second_b)
        if t < to:
            near[t - at :, ob - low :] |= ranks.near(second_a, slice(ob, len(b)))
            near[t - at :, tb - low :] |= ranks.near(second_a, second_b)
        if o > at:
            near[: o - at] = _gap(box[a[at : min(o, to)]].T[:, :, None], box[b[low:]].T[:, None], 0.0)
        if ob > low:
            near[:, : ob - low] = _gap(box[a[at:to]].T[:, :, None], box[b[low:ob]].T[:, None], 0.0)
        for c in (0, 1):
            near &= here[a[at:to], c][:, None] | here[b[low:], c]
        if later:
            near[:, : to - at] &= np.triu(np.ones((to - at, to - at), bool), 1)
        found = np.flatnonzero(near)
        rows = np.arange(to - at)
        n = np.diff(np.append(np.searchsorted(found, rows * near.shape[1]), len(found)))
        yield a[at:to], n, b[low:][found - np.repeat(rows * near.shape[1], n)]


def contacts(polygons: DataFrame, polygon: str, size: float, tolerance: float = 0.0, once: bool = False) -> DataFrame:
    """src and dst, both ways: polygons (rings) that meet, or come within the tolerance of one another.

    Two polygons do if a segment of one comes near a segment of the other, or if none does and one lies in the other (not in
    its holes): then a point of each of its rings is in it. Outlines of at most FEW edges meet by their boxes, each pair once, and
    are told from one another there, unless corners lack. Where one has more, segments meet at cells of their own size, each having four cells a level at most; so the work grows with
    segments near each other, not with rings. size: of the smallest cells, about a short segment's length. Polygons without
    rings meet nothing; repeated ids are one polygon. once: the pairs are read once, so they aren't written, moved or sorted
    unless ids repeat or corners lack; their number may grow with the square of the polygons.
    """
    polygons = dealt(polygons.select(polygon, "rings"), polygon)
    boxes = written(_boxes(polygons, polygon, tolerance, size))
    plain, n, different = boxes.agg(F.min("plain"), F.count(polygon), F.count_distinct(polygon)).first()
    few = boxes.where(F.size("e").between(1, 4 * FEW))
    if plain is not False and n == different:
        pairs = _near_outlines(few, polygon, tolerance, size, both=once).toDF("src", "dst")
        if once:
            return pairs
        pairs = written(pairs)
    else:
        near = _near_outlines(few, polygon, tolerance, size)
        if plain is False:
            polygons = written(polygons)
            near = near.union(_near_segments(polygons, boxes, polygon, size, tolerance)).union(_holding_odd(polygons, boxes, polygon, size))
        pairs = written(near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    return pairs.union(pairs.select("dst", "src"))


def _near_segments(polygons: DataFrame, boxes: DataFrame, polygon: str, size: float, tolerance: float) -> DataFrame:
    """a and b: polygons of which a segment comes near one of the other, one of them with more than FEW edges."""
    edges = segments(polygons.select(polygon, "rings"), polygon)
    many = boxes.where(F.size("e") > 4 * FEW).select(polygon).distinct().withColumn("many", F.lit(True))
    edges = edges.join(many.hint("merge"), polygon, "left").withColumns({
        "many": F.coalesce("many", F.lit(False)), "low_x": F.least("x1", "x2"), "high_x": F.greatest("x1", "x2"), "low_y": F.least("y1", "y2"), "high_y": F.greatest("y1", "y2"),
    })
    edges = written(edges.withColumn("level", _level(F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")) + 2 * (tolerance + NEAR), size)))
    levels = sorted(r[0] for r in edges.select("level").distinct().collect())
    side = ("x1", "y1", "x2", "y2")
    wide = tolerance + NEAR
    at = _with_cells(edges, F.col("level"), F.col("low_x") - wide, F.col("low_y") - wide, F.col("high_x") + wide, F.col("high_y") + wide, size)
    at = at.select("level", "cx", "cy", F.col(polygon).alias("a"), F.struct(*side).alias("ea"), "many")
    probe = edges.withColumn("at_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda l: l >= F.col("level")))) if levels else edges.withColumn("at_level", F.col("level"))
    probe = _with_cells(probe, F.col("at_level"), F.col("low_x"), F.col("low_y"), F.col("high_x"), F.col("high_y"), size)
    probe = probe.select(F.col("at_level").alias("level"), "cx", "cy", F.col(polygon).alias("b"), F.struct(*side).alias("eb"), "many")
    box = lambda e, i, pick: pick(e[f"{i}1"], e[f"{i}2"])
    close = [box(F.col(p), i, F.least) <= box(F.col(q), i, F.greatest) + wide for p, q in (("ea", "eb"), ("eb", "ea")) for i in "xy"]
    met = lambda a, b: a.drop("many").join(b.drop("many").hint("merge"), ["level", "cx", "cy"])
    near = met(at.where("many"), probe).union(met(at.where("not many"), probe.where("many")))
    return near.where((F.col("a") != F.col("b")) & close[0] & close[1] & close[2] & close[3] & segments_near(F.col("ea"), F.col("eb"), tolerance)).select("a", "b")


def _holding_odd(polygons: DataFrame, boxes: DataFrame, polygon: str, size: float) -> DataFrame:
    """a and b: a point of a ring of a lies in b, one of them at least not plain."""
    odd = boxes.where("not plain").select(polygon).distinct()
    some = polygons.join(odd.hint("merge"), polygon, "left_semi")
    inner = lambda of: written(of.select(F.col(polygon).alias("a"), F.explode("rings").alias("r")).select("a", F.get("r", F.lit(0)).alias("p")).where("p.x IS NOT NULL AND p.y IS NOT NULL").select("a", F.col("p.x").alias("x"), F.col("p.y").alias("y")).withColumn("point", F.monotonically_increasing_id()))
    out = None
    for points, holders in ((inner(some), polygons), (inner(polygons), some)):
        held = holding(points, holders, "point", polygon, size).join(points.select("point", "a").hint("merge"), "point").select("a", F.col(polygon).alias("b")).where("a <> b")
        out = held if out is None else out.union(held)
    return out


def _corners(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rings the corners (a row each) that have both coordinates, and the number of their polygon and their ring."""
    size = lambda a: pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    rings = column.flatten()
    points = rings.flatten()
    x, y = (pc.struct_field(points, c) for c in "xy")
    there = pc.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
    ring = np.repeat(np.arange(len(rings)), size(rings))[there]
    polygon = np.repeat(np.arange(len(column)), size(column))
    return np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False)[there] for c in (x, y)], 1), polygon[ring], ring


class _Rings:
    """Edges of the rings of many polygons, by polygon, for their covers. Rings of fewer than three corners have none."""

    def __init__(self, column: pa.Array | list):
        if not isinstance(column, pa.Array):  # the rings of one polygon
            column = pa.array([column], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        at, polygon, ring = _corners(column)
        _, first, back, n = np.unique(ring, return_index=True, return_inverse=True, return_counts=True)
        before = np.arange(len(ring)) - 1
        before[first] = first + n - 1  # the first corner's edge starts at the last one
        kept = n[back] >= 3 if len(ring) else np.zeros(0, bool)
        self.ends, self.of, self.ring = np.concatenate([at[before], at], 1)[kept], polygon[kept], ring[kept]
        self.count = np.bincount(self.of, minlength=len(column))
        self.first = np.cumsum(self.count) - self.count

    def crossing(self, edges: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Which of the edges may come into their cell: their box meets it, and its corners aren't all on one side of them."""
        x1, y1, x2, y2 = self.ends[edges].T
        slack = 1e-9 * (side + np.abs(x) + np.abs(y))
        left, low, right, high = x - slack, y - slack, x + side + slack, y + side + slack
        meets = (np.minimum(x1, x2) <= right) & (np.maximum(x1, x2) >= left) & (np.minimum(y1, y2) <= high) & (np.maximum(y1, y2) >= low)
        cross = np.stack([(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (left, right) for cy in (low, high)])
        return meets & ~((cross > 0).all(0) | (cross < 0).all(0))

    def pairs(self, polygon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of the polygons with each edge of it."""
        n = self.count[polygon]
        place = np.repeat(np.arange(len(polygon)), n)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + self.first[polygon][place]

    def holds(self, polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which points that are on no edge are in an odd number of their polygon's rings: an odd number of edges lies to the right."""
        out = np.zeros(len(polygon), bool)
        for at in _parts(self.count[polygon]):
            place, edge = self.pairs(polygon[at])
            x1, y1, x2, y2 = self.ends[edge].T
            px, py = x[at][place], y[at][place]
            up = (y1 > py) != (y2 > py)
            place, x1, y1, x2, y2, px, py = (v[up] for v in (place, x1, y1, x2, y2, px, py))
            right = x1 + (py - y1) / (y2 - y1) * (x2 - x1) > px
            out[at] = np.bincount(place[right], minlength=at.stop - at.start) % 2 == 1
        return out

    def covers(self, size: float, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, ...]]:
        """polygon, level, cx, cy and whether the cell lies inside, as arrays; other cells are borders. At most 9 * 4^depth cells a
        polygon, mostly far fewer: cells that no edge comes into aren't split, and those outside are left out. All polygons of a
        part are split together, level by level."""
        some = np.flatnonzero(self.count)
        if not len(some):
            return
        ends, first = self.ends, self.first[some]
        low = np.minimum.reduceat(np.minimum(ends[:, :2], ends[:, 2:]), first)
        high = np.maximum.reduceat(np.maximum(ends[:, :2], ends[:, 2:]), first)
        finite = np.isfinite(low).all(1) & np.isfinite(high).all(1)
        some, low, high = some[finite], low[finite], high[finite]
        for part in _parts(self.count[some], EDGES):
            yield from self._split(some[part], low[part], high[part], size, depth)

    def _split(self, polygon: np.ndarray, low: np.ndarray, high: np.ndarray, size: float, depth: int) -> Iterator[tuple[np.ndarray, ...]]:
        top = np.maximum(0, np.ceil(np.log2(np.maximum((high - low).max(1) / size, 1.0)))).astype(np.int64)
        side = size * 2.0**top
        a, b = (np.floor(v / side[:, None]).astype(np.int64) for v in (low, high))
        wide = b - a + 1  # cells to either side
        n = wide[:, 0] * wide[:, 1]
        own = np.repeat(np.arange(len(polygon)), n)
        i = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        of, level, last = polygon[own], top[own], np.maximum(0, top - depth)[own]
        cx, cy = a[own, 0] + i // wide[own, 1], a[own, 1] + i % wide[own, 1]
        cell, edge = self.pairs(of)
        while len(of):
            side = size * 2.0**level
            near = self.crossing(edge, (cx * side)[cell], (cy * side)[cell], side[cell])
            cell, edge = cell[near], edge[near]
            met = np.bincount(cell, minlength=len(of)) > 0
            free = np.flatnonzero(~met)
            free = free[self.holds(of[free], (cx[free] + 0.5) * side[free], (cy[free] + 0.5) * side[free])]
            border = np.flatnonzero(met & (level <= last))
            for at, inside in ((free, True), (border, False)):
                yield of[at], level[at], cx[at], cy[at], np.full(len(at), inside)
            split = met & (level > last)
            place = np.cumsum(split) - 1
            on = split[cell]
            cell, edge = place[cell[on]], edge[on]
            of, level, last, cx, cy = (v[split] for v in (of, level, last, cx, cy))
            cell, edge = (cell[:, None] * 4 + np.arange(4)).ravel(), np.repeat(edge, 4)
            of, level, last = (np.repeat(v, 4) for v in (of, level - 1, last))
            quarter = np.tile(np.arange(4), len(cx))
            cx, cy = 2 * np.repeat(cx, 4) + quarter // 2, 2 * np.repeat(cy, 4) + quarter % 2

    def beside(self, polygon: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each cell the edges that decide whether a point in it lies in its polygon (x1, y1, x2, y2 and the ring), one cell's
        after the other's, and how many those are; more than `most` are left out and count as -1."""
        found, count = [], np.zeros(len(polygon), np.int64)
        for at in _parts(self.count[polygon]):
            place, edge = self.pairs(polygon[at])
            x1, y1, x2, y2 = self.ends[edge].T
            slack = (1e-6 + 1e-9 * (side[at] + np.abs(x[at]) + np.abs(y[at])))[place]
            left, low, high = x[at][place] - slack, y[at][place] - slack, (y + side)[at][place] + slack
            near = (np.maximum(x1, x2) >= left) & (np.maximum(y1, y2) >= low) & (np.minimum(y1, y2) <= high)
            n = np.bincount(place[near], minlength=at.stop - at.start)
            count[at] = np.where(n <= most, n, -1)
            near &= (n <= most)[place]
            found.append(np.concatenate([self.ends[edge[near]], self.ring[edge[near], None]], 1))
        return np.concatenate([np.zeros((0, 5)), *found]), count

    def cover(self, size: float, depth: int = DEPTH) -> Iterator[tuple[int, int, int, bool]]:
        """level, cx, cy and inside of each cell of the first polygon."""
        for _, *cells in self.covers(size, depth):
            yield from zip(*(c.tolist() for c in cells))


def _parts(sizes: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to about as much at most; what is larger stands alone."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def dealt(polygons: DataFrame, polygon: str) -> DataFrame:
    """polygons dealt by id over the cores: a file of small outlines is few tasks, but what is worked out of each is much."""
    return polygons.repartition(4 * polygons.sparkSession.sparkContext.defaultParallelism, polygon)


def covers(polygons: DataFrame, polygon: str, size: float, edges: bool = False) -> DataFrame:
    """A row for each cell of each polygon's cover: polygon, level, cx, cy, inside. Inside cells hold no point of an edge.

    edges: also, for border cells, r0 to r7, the one or two rectangles (low x, low y, high x, high y) that the polygon is made of, or
    else e, the edges that decide about points in the cell (`_Rings.beside`), one after the other; both are null where those
    are more than CARRIED, or where a corner of the polygon lacks a coordinate.
    """
    ship(polygons.sparkSession)
    kind = polygons.schema[polygon].dataType.simpleString()
    types, names = (pa.int32(), pa.int64(), pa.int64(), pa.bool_()), ["e", *(f"r{k}" for k in range(8))] if edges else []

    def carried(rings, whole, square, of, level, cx, cy, inside):
        side, border = size * 2.0**level, ~inside & whole[of] & ~square[of]
        ends, n = rings.beside(of[border], (cx * side)[border], (cy * side)[border], side[border], CARRIED)
        count = np.full(len(of), -1)
        count[border] = n
        first = np.cumsum(np.maximum(count, 0)) - np.maximum(count, 0)
        offsets = pa.array(np.append(first, len(ends)) * 5, pa.int32(), mask=np.append(count < 0, False))
        return pa.ListArray.from_arrays(offsets, pa.array(ends.ravel()))

    def run(batches):
        for batch in batches:
            rings = _Rings(batch.column(1))
            whole = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) if edges else None
            parts, number = _rectangles(rings.ends, rings.count, whole) if edges else (None, None)
            for of, *cells in rings.covers(size):
                more = []
                if edges:
                    lacks = cells[-1] | (number[of] == 0)
                    more = [carried(rings, whole, number > 0, of, *cells), *(pa.array(v, mask=lacks) for v in parts[of].reshape(-1, 8).T)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cells, types)), *more], [polygon, "level", "cx", "cy", "inside", *names])

    lacks = lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()
    whole = [F.coalesce(~F.exists(F.flatten("rings"), lacks), F.lit(False)).alias("whole")] if edges else []
    rows = dealt(polygons.select(polygon, "rings", *whole), polygon)
    return rows.mapInArrow(run, f"`{polygon}` {kind}, level int, cx bigint, cy bigint, inside boolean" + (", e array<double>, " + ", ".join(f"r{k} double" for k in range(8)) if edges else ""))


def _within(x: np.ndarray, y: np.ndarray, e: pa.Array) -> np.ndarray:
    """`geo.in_polygon` of many points, each with its edges as `covers` has them."""
    n = pc.list_value_length(e).to_numpy(zero_copy_only=False).astype(np.int64) // 5
    x1, y1, x2, y2, ring = e.flatten().to_numpy(zero_copy_only=False).reshape(-1, 5).T
    out = np.zeros(len(x), np.int64)
    row = np.repeat(np.arange(len(x)), n)
    if len(row):
        px, py = x[row], y[row]
        cross, dot = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1), (px - x1) * (px - x2) + (py - y1) * (py - y2)
        on = (np.abs(cross) <= geo.ON_EDGE) & (dot <= geo.ON_EDGE)
        at = (x2 - x1) * (py - y1) / np.where(y2 == y1, 1.0, y2 - y1) + x1
        crossed = ((y1 > py) != (y2 > py)) & (at > px)
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (ring[1:] != ring[:-1])))
        held = np.logical_or.reduceat(on, first) | np.logical_xor.reduceat(crossed, first)
        np.add.at(out, row[first], held)
    return out % 2 == 1


def holding(points: DataFrame, polygons: DataFrame, point: str, polygon: str, size: float, keep: Sequence[str] = ()) -> DataFrame:
    """point, polygon and `keep` for each point (x, y) in each polygon (rings) that holds it, by the even-odd rule over rings.

    Points meet polygons at the cells of their covers, on every level in use. In inside cells that is all; points in border
    cells are tested exactly with the rectangles or the few edges that their cell carries, or with the rings of their polygon where
    those are many or odd. Points with null coordinates lie nowhere. Files of cells are far smaller than their rows, so joins are by merging:
    the planner would take them for small and send them all to the driver.
    """
    cells = written(covers(polygons, polygon, size, edges=True)).toDF(polygon, "_level", "_cx", "_cy", "_inside", "_e", *(f"_r{k}" for k in range(8)))
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())
    side = lambda l: F.lit(size) * F.pow(F.lit(2.0), l)
    names = [point, *(c for c in keep if c != point)]
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").select(*names, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    at = placed.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    at = at.withColumns({"_cx": F.floor(F.col("_x") / side(F.col("_level"))).cast("long"), "_cy": F.floor(F.col("_y") / side(F.col("_level"))).cast("long")})
    met = lambda kind: at.join(cells.where(kind).hint("merge"), ["_level", "_cx", "_cy"])
    held = lambda k: F.col("_x").between(F.col(f"_r{k}"), F.col(f"_r{k + 2}")) & F.col("_y").between(F.col(f"_r{k + 1}"), F.col(f"_r{k + 3}"))
    sure = met("_inside OR _r0 IS NOT NULL").where(F.col("_inside") | held(0) | held(4)).select(*names, polygon)
    near = met("not _inside AND _e IS NOT NULL").select(*names, polygon, "_x", "_y", "_e")
    width = len(names) + 1

    def run(batches):
        for batch in batches:
            x, y = (batch.column(width + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield batch.select(list(range(width))).filter(pa.array(_within(x, y, batch.column(width + 2))))

    found = sure.union(near.mapInArrow(run, StructType(sure.schema.fields)))
    if not cells.where("not _inside AND _e IS NULL AND _r0 IS NULL").take(1):
        return found
    tested = met("not _inside AND _e IS NULL AND _r0 IS NULL").select(*names, polygon, "_x", "_y").join(polygons.select(polygon, "rings").hint("merge"), polygon)
    return found.union(tested.where(geo.in_polygon(F.col("_x"), F.col("_y"), F.col("rings"))).select(*names, polygon))
