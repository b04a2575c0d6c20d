"""Mixing sources to target weights by pivotal dependent rounding, combined through a reduction tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, kind_of, ship, written

#: Documents of a group at the leaves of the tree, and groups that meet at each node above.
LEAF, FAN = 1024, 64
CYCLE = (1.0, 2.0, 3.0)


def sizes(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, size (words between ASCII white space; of a null text 0) and body (a hash of the text) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.fromiter((len((x.as_py() or "").encode().split()) for x in batch.column(2)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), batch.column(3)], ["id", "source", "size", "body"])

    rows = df.select(id_col, F.col(source_col).cast("string"), text_col, body_of(text_col))
    return arrow_map(rows, run, f"id {kind_of(df, id_col)}, source string, size long, body long")


def body_of(text_col: str) -> Column:
    """A hash of the text, null as the empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def targets(rows: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = 3.0) -> DataFrame:
    """A row for each source: source, source_size, n_docs, weight, target.

    Sources in code point order, null last, take the weights of the cycle in turn. A target is weight times one level
    for all, but at most `most` times the source's size; the level is where the targets add up to all sizes. It is found
    from two sums over the sources a round, so only sums reach the driver.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    by = written(by.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), place + 1)))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * F.lit(most)
        r = by.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("size"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        up = (total - most * r["size"]) / r["weight"] if r["weight"] else level
        if up <= level * (1 + 1e-15):
            break
        level = up
    return by.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(most)))


def uniform(*parts: object) -> float:
    """A number in [0, 1) from a hash of the parts."""
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode()) / 2.0**64


def pivot(mass: list[float], size: list[float], draw: list[float]) -> int:
    """Rounds fractional copies in place; returns the index of the one that may stay fractional, or -1.

    The pending one and the next exchange mass so that the sum of size times copies stays; they go in either direction
    with the probability that keeps each one's expectation, until one of them is 0 or 1.
    """
    i = -1
    for j, p in enumerate(mass):
        if p <= 0.0 or p >= 1.0:
            continue
        if i < 0:
            i = j
            continue
        a, b, q = size[i], size[j], mass[i]
        up, down = min(a * (1 - q), b * p), min(a * q, b * (1 - p))  # words that can go from j to i, and from i to j
        if draw[j] * (up + down) < down:
            full, mass[i], mass[j] = a * (1 - q) <= b * p, q + up / a, p - up / b
            if full:
                mass[i] = 1.0
            else:
                mass[j] = 0.0
        else:
            full, mass[i], mass[j] = b * (1 - p) <= a * q, q - down / a, p + down / b
            if full:
                mass[j] = 1.0
            else:
                mass[i] = 0.0
        near = [k for k in (i, j) if 1e-12 < mass[k] < 1 - 1e-12]
        for k in (i, j):
            if k not in near:
                mass[k] = round(mass[k])
        i = near[0] if near else -1
    return i


def settled(mass: list[float], size: list[float], draw: list[float]) -> int:
    """Rounds fractional copies in place, larger documents first; returns the index of the one that may stay fractional, or -1.

    A document is rounded by its own probability, and the words that takes or gives are spread over the next smaller open ones:
    over as many as are needed, in the same shares either way, so each one's expectation and the sum of size times copies
    stay, and as far as each can take them, so all masses stay from 0 to 1. Where all smaller ones can't take so many words, it
    exchanges mass with the next one (`pivot`). So what is left at the end is one of the smallest.
    """
    m, b = np.array(mass, float), np.array(size, float)
    order = np.argsort(-b, kind="stable")
    left = order[(m[order] > 0) & (m[order] < 1)]
    while len(left) > 1:
        k, rest = int(left[0]), left[1:]
        q, a, p = m[k], b[k], m[rest]
        room = np.minimum(p / (1 - q), (1 - p) / q)
        reach = np.cumsum(b[rest] * room)
        if reach[-1] >= a:
            few = int(np.searchsorted(reach, a)) + 1
            rest, p, room, words, up = rest[:few], p[:few], room[:few], reach[few - 1], draw[k] < q
            m[k] = float(up)
            m[rest] = np.clip(p + (-(1 - q) if up else q) * a / words * room, 0.0, 1.0)
        else:
            two = [float(m[k]), float(m[rest[0]])]
            pivot(two, [a, float(b[rest[0]])], [draw[k], draw[rest[0]]])
            m[k], m[rest[0]] = two
        near = (m[left] > 1e-12) & (m[left] < 1 - 1e-12)
        m[left[~near]] = np.rint(m[left[~near]])
        left = left[near]
    mass[:] = m.tolist()
    return int(left[0]) if len(left) else -1


def ended(mass: list[float], size: list[float], left: int, draw: float) -> None:
    """Rounds the last fractional copy of a source in place, and makes up for it among those rounded before.

    The words that it takes too many or too few go back by turning other roundings, the largest that fit first. It is rounded
    by its own draw, unless the words that then can't be made up for are more than the other way: a document may be larger
    than all that the others could take, and then its expectation gives way to the target.
    """
    m, b = np.array(mass), np.array(size, float)
    order = np.argsort(-b, kind="stable")
    order = order[order != left]
    made = []
    for up in (False, True):
        missing, turned = (1 - m[left] if up else m[left]) * b[left], []
        for k in order[(m[order] > 0.5) == up].tolist():
            if b[k] <= missing * (1 + 1e-12):
                turned.append(k)
                missing -= b[k]
        made.append((missing, turned))
    drawn = bool(draw < m[left])
    up = drawn if made[drawn][0] <= max(b.min(), made[not drawn][0]) else not drawn
    for k in made[up][1]:
        mass[k] = 0.0 if up else 1.0
    mass[left] = float(up)


def _rounded(seed: int, depth: int, last: bool):
    """One node of the tree: rounds a group's masses; all rows but a residual are closed, and at the root that one too."""

    def run(table: pa.Table) -> pa.Table:
        ids, bodies, size, mass = (table[c].to_pylist() for c in ("id", "body", "size", "mass"))
        key = list(zip(ids, bodies, size))
        order = sorted(range(len(key)), key=lambda k: (uniform(seed, depth, *key[k]), str(key[k])))
        mass, draw = [mass[k] for k in order], [uniform(seed, "draw", depth, *key[k]) for k in order]
        left = settled(mass, [size[k] for k in order], draw)
        if last and left >= 0:
            ended(mass, [size[k] for k in order], left, uniform(seed, "last", *key[order[left]]))
        open_ = (np.arange(len(key)) == left) & (not last)
        mass, out = np.array(mass), table.take(pa.array(order))
        for name, values in (("n", out["n"].to_numpy() + np.where(open_, 0, mass.round()).astype(np.int64)), ("mass", np.where(open_, mass, 0.0))):
            out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
        return out.append_column("open", pa.array(open_))

    return run


def copies(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11, cycle: tuple[float, ...] = CYCLE, most: float = 3.0) -> DataFrame:
    """A row for each input row: id, body, source, size, source_size, target, n (copies: 0 to `most`), taken (n * size).

    Each document has target / source_size expected copies; the whole ones are given, the fraction is rounded. Documents
    of a source are dealt by hash into groups of about LEAF, each of which leaves at most one residual; residuals of FAN
    groups meet on each level above, and the last one of a source is rounded by its own draw, what that misses made up for
    among those that meet there (`ended`). Larger documents are settled
    first, against smaller ones at once, so that one is a small one: a source's words miss the target by less than it. Draws and groups are hashes of id, text and seed, so reruns agree. Repeated rows (of
    one id, text and source) are one item of all their copies, dealt to them as evenly as whole copies go; so is what has no
    fraction to round, empty texts among it: it meets in no group. Null sources are one source. An empty table gives no rows.
    """
    ship(df.sparkSession)
    rows = written(sizes(df, id_col, source_col, text_col), narrow=True)
    goal = written(targets(rows, cycle, most))
    items = rows.groupBy("id", "body", "source", "size").agg(F.count("*").alias("rows"))
    joined = items.join(goal.withColumnRenamed("source", "of"), items.source.eqNullSafe(F.col("of"))).drop("of", "weight")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("rows")).otherwise(0.0)
    whole = F.least(F.floor(want + 1e-12), F.lit(int(most)) * F.col("rows"))
    rate = F.when(F.col("size") > 0, F.greatest(want - whole, F.lit(0.0))).otherwise(0.0)
    groups = F.ceil(F.col("n_docs") / LEAF)
    ready = joined.withColumns({"n": whole.cast("long"), "mass": rate, "node": F.pmod(F.xxhash64("id", "body", F.lit(seed)), groups)}).drop("n_docs")
    ready = written(ready)
    open_, nodes, depth, done = ready.where("mass > 0"), goal.agg(F.max(groups)).first()[0] or 1, 0, [ready.where("mass <= 0").withColumn("open", F.lit(False))]
    schema = ready.schema.simpleString()[len("struct<") : -1] + ",open:boolean"
    while True:
        level = written(open_.groupBy("source", "node").applyInArrow(_rounded(seed, depth, nodes == 1), schema))
        done.append(level.where("not open"))
        if nodes == 1:
            break
        nodes, depth = -(-nodes // FAN), depth + 1
        open_ = level.where("open").drop("open").withColumn("node", F.floor(F.col("node") / FAN))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    each = F.explode(F.transform(F.sequence(F.lit(1), F.col("rows")), lambda i: F.floor(F.col("n") / F.col("rows")) + (i <= F.col("n") % F.col("rows")).cast("long"))).alias("n")
    return out.select("id", "body", "source", "size", "source_size", "target", each).withColumn("taken", F.col("n") * F.col("size"))


def mixed(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 11) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of df, told apart by their place. Rows alike in id
    and text are taken together: one of them as often as all. Counts grow with the texts, so both sides are dealt by key at
    every size."""
    names = [f"__{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key, source, text = (names[df.columns.index(c)] for c in (id_col, source_col, text_col))
    by = copies(plain, key, source, text, seed).groupBy(F.col("id").alias("__id"), F.col("body").alias("__body"))
    counts = written(by.agg(F.sum("n").cast("int").alias("__n"), F.count("*").alias("__rows")).where("__n > 0"))
    rows = plain.withColumn("__key", body_of(text))
    found = rows.join(counts.hint("merge"), F.col(key).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__body")))
    if counts.where("__rows > 1").take(1):
        found = found.where("__rows = 1").union(found.where("__rows > 1").dropDuplicates([key, "__key"]))
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n"))).select(*names).toDF(*df.columns)
