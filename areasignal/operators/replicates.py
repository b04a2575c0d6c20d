"""Resamples and permutations as arrays: what a unit has in each of many replicates is one vector, so rows that move don't grow with
the number of replicates, and nothing is sorted once a replicate.

Entries that change their unit (who draws whom, who stands where) move packed, as one row for each block of units and batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.functions.vectors import ordinal
from areasignal.session import ship, written

#: Units whose entries one group holds; rows worked on at once.
BLOCK, ROWS = 1024, 512
#: Orders whose sorted entries one row has.
AT_ONCE = 16


def numbered(units: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """units with i, the place from 0 by unit within the keys, and n, how many there are. Units are dealt by range; what lies before
    a range comes from counts by range, so no task has all units."""
    dealt = written(units.repartitionByRange(*keys, unit).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = counts.withColumns({"_before": F.sum("_c").over(by.orderBy("_p")) - F.col("_c"), "n": F.sum("_c").over(by)})  # a row for each range
    own = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(unit)) - 1
    return written(dealt.withColumn("_own", own).join(before, [*keys, "_p"]).withColumn("i", F.col("_before") + F.col("_own")).drop("_p", "_own", "_c", "_before"))


def spread(rows: DataFrame, unit: str) -> DataFrame:
    """rows dealt by unit over the cores: a file of units is one task, but what is worked out of each of them is much."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, unit)


def _moved(df: DataFrame, keys: Sequence[str], make: Callable[[pa.RecordBatch], Iterator[tuple[tuple, np.ndarray, np.ndarray]]], take: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Sends entries to blocks. make(batch) yields (keys, blocks, entries) with entries a structured array; take(keys, block,
    entries) gives the rows of a block as a table."""
    ship(df.sparkSession)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys]
    names = [*keys, "block", "entries"]

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for key, blocks, entries in make(batch.slice(at, ROWS)):
                    order = np.argsort(blocks, kind="stable")
                    cuts = np.flatnonzero(np.diff(blocks[order])) + 1
                    parts = [p for p in np.split(order, cuts) if len(p)]
                    columns = [pa.array([k] * len(parts), df_kinds[j]) for j, k in enumerate(key)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([int(blocks[p[0]]) for p in parts], pa.int64()), pa.array([entries[p].tobytes() for p in parts], pa.binary())], names)

    from pyspark.sql.pandas.types import to_arrow_type

    df_kinds = [to_arrow_type(df.schema[c].dataType) for c in keys]
    sent = df.mapInArrow(send, ", ".join([*kinds, "block bigint", "entries binary"]))

    def group(key, table):
        return take(key[:-1], key[-1].as_py(), b"".join(table["entries"].to_pylist())).cast(schema)

    return sent.groupBy(*keys, "block").applyInArrow(group, ddl)


def _matrix(column: pa.Array, n: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    """Rows of numbers packed as bytes."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def draw_weights(units: DataFrame, unit: str, times: int, drawn: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """unit and w: how often each resample draws it (16-bit numbers, packed). drawn(b, i, n): the place that place i of resample b
    draws."""
    places = numbered(units.select(unit).distinct(), unit)
    rows = spread(places.select("i", "n"), "i").select("i", F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda b: drawn(b, F.col("i"), F.col("n"))).alias("js"))
    entry = np.dtype([("b", np.uint16), ("at", np.uint16)])

    def make(batch):
        j = _matrix(batch.column(1), batch.num_rows, np.int64)
        out = np.empty(j.size, entry)
        out["b"], out["at"] = np.tile(np.arange(times), len(j)), j.ravel() % BLOCK
        yield (), j.ravel() // BLOCK, out

    def take(_, block, packed):
        e = np.frombuffer(packed, entry)
        w = np.bincount(e["at"].astype(np.int64) * times + e["b"], minlength=BLOCK * times).astype(np.int16).reshape(BLOCK, times)
        return pa.table({"i": pa.array(np.arange(BLOCK) + block * BLOCK), "w": pa.array([r.tobytes() for r in w], pa.binary())})

    shape = pa.schema([("i", pa.int64()), ("w", pa.binary())])
    weights = _moved(rows, (), make, take, shape, "i bigint, w binary")
    none = F.lit(bytes(2 * times))
    return places.select(unit, "i").join(weights, "i", "left").select(unit, F.coalesce("w", none).alias("w"))


def _grouped_keys(batch: pa.RecordBatch, k: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The distinct values of the first k columns of a batch, and the rows of each."""
    if not k:
        yield (), np.arange(batch.num_rows)
        return
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(k)))):
        found.setdefault(key, []).append(i)
    yield from ((key, np.array(at)) for key, at in found.items())


def _ranked(rows: DataFrame, keys: Sequence[str], value: str, times: int, wide) -> DataFrame:
    """keys, value and r: twice its average rank less one in each replicate (packed), for each distinct value.

    Weights of equal values are added up, first in each batch; values are dealt by range and their weights added up in order, and
    what lies before a range comes from its sums: a value's replicates stay together, and none is sorted for itself.
    """
    k = len(keys)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    names = [*keys, value]

    def summed(kind, streamed: bool):
        def run(batches):
            held_key, held = None, None
            for batch in batches:
                out: dict[tuple, np.ndarray] = {} if held_key is None else {held_key: held}
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    w = _unpacked(part.column(k + 1), kind)
                    for i, key in enumerate(zip(*(part.column(j).to_pylist() for j in range(k + 1)))):
                        out[key] = out[key] + w[i] if key in out else w[i].astype(wide)
                    if len(out) > ROWS:  # few rows at once: each has all replicates
                        last = dict([out.popitem()]) if streamed else {}
                        yield from table(out)
                        out = last
                if streamed and out:  # rows come in order: the last value may go on in the next batch
                    held_key = next(reversed(out))
                    held = out.pop(held_key)
                yield from table(out)
            if held_key is not None:
                yield from table({held_key: held})

        return run

    kinds_of = [*(rows.schema[c].dataType for c in keys)]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [*(to_arrow_type(t) for t in kinds_of), pa.float64()]

    def table(found):
        cells = list(zip(*found)) if found else [()] * (k + 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, arrow)), pa.array([w.tobytes() for w in found.values()], pa.binary())], [*names, "w"])

    ddl = ", ".join([*kinds, f"`{value}` double", "w binary"])
    order = [F.col(c).asc_nulls_first() for c in names]
    added = rows.select(*names, "w").mapInArrow(summed(np.int16, False), ddl).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(summed(wide, True), ddl)
    dealt = written(added.withColumn("_p", F.spark_partition_id()))

    def totals(batches):
        out: dict[tuple, np.ndarray] = {}
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            w = _unpacked(batch.column(k + 1), wide)
            for key, at in _grouped_keys(pa.RecordBatch.from_arrays(batch.columns[: k + 1], [*keys, "_p"]), k + 1):
                s = w[at].sum(0, dtype=wide)
                out[key] = out[key] + s if key in out else s
        cells = list(zip(*out)) if out else [()] * (k + 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, [*arrow[:-1], pa.int32()])), pa.array([w.tobytes() for w in out.values()], pa.binary())], [*keys, "_p", "w"])

    by_range = dealt.select(*keys, "_p", "w").mapInArrow(totals, ", ".join([*kinds, "_p int", "w binary"]))

    def before(key, t):
        sums: dict[int, np.ndarray] = {}
        for p, w in zip(t["_p"].to_pylist(), _unpacked(t["w"].combine_chunks(), wide)):
            sums[p] = sums[p] + w if p in sums else w
        at, out = np.zeros(times, wide), []
        for p in sorted(sums):
            out.append((p, at))
            at = at + sums[p]
        return pa.table([*(pa.array([x.as_py()] * len(out), t) for x, t in zip(key, arrow)), pa.array([p for p, _ in out], pa.int32()), pa.array([a.tobytes() for _, a in out], pa.binary())], names=[*keys, "_p", "before"])

    starts = by_range.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(before if keys else (lambda key, t: before((), t)), ", ".join([*kinds, "_p int", "before binary"]))

    def ranks(batches):
        last, at = object(), None
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
            w, b = _unpacked(batch.column(k + 2), wide), batch.column(k + 3)
            out = []
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in (*range(k), k)))):
                if key != last:
                    last, at = key, np.frombuffer(b[i].as_py(), wide).copy()
                out.append((2 * at + w[i]).tobytes())  # twice the average rank, less one
                at += w[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], batch.column(k + 1), pa.array(out, pa.binary())], [*names, "r"])

    # of the ranges, each in one task and in order
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys]
    on = F.col("a._p") == F.col("b._p")
    for s in same:
        on = on & s
    joined = dealt.alias("a").join(starts.alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in keys), F.col("a._p").alias("_p"), F.col(f"a.{value}").alias(value), F.col("a.w").alias("w"), F.col("b.before").alias("before"))
    sorted_ = joined.repartition(*keys, "_p").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys), "_p", value)
    return sorted_.mapInArrow(ranks, ", ".join([*kinds, f"`{value}` double", "r binary"]))


#: What is added up of each replicate, beside its weight.
_SUMS = ("n", "y", "p", "yy", "pp", "yp", "ee", "e", "hit", "near", "ry", "rp", "ryy", "rpp", "ryp")


def scores(rows: DataFrame, times: int, keys: Sequence[str] = (), ranks: bool = True) -> DataFrame:
    """keys, b, n, rho, r2, pearson, mae, rmse, accuracy (of rounded and clipped values) and within_one of each replicate of rows
    (keys, y, p and the packed weights w); pairs with nulls are left out. ranks: whether rho is wanted, else it is null.

    Sums of all replicates are one product of weights and values in each batch. A replicate that a key has no rows in is left
    out.
    """
    ship(rows.sparkSession)
    k = len(keys)
    t, q = ordinal(F.col("y")), ordinal(F.col("p"))
    plain = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull()).select(*keys, F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p"), (t == q).alias("hit"), "w")
    if ranks:
        plain = written(plain)
        wide = np.int32 if plain.count() < 1 << 27 else np.int64
        ry, rp = _ranked(plain, keys, "y", times, wide), _ranked(plain, keys, "p", times, wide)
        for name, r in (("y", ry), ("p", rp)):
            left, right = plain.alias("a"), r.withColumnRenamed("r", f"r{name}").alias("b")
            on = F.col(f"a.{name}") == F.col(f"b.{name}")
            for c in keys:
                on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
            plain = left.join(right, on).select("a.*", f"b.r{name}")
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]

    def add(batches):
        found: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                y, p, hit = (batch.column(k + j).to_numpy(zero_copy_only=False).astype(float) for j in range(3))
                w = _unpacked(batch.column(k + 3), np.int16).astype(float)
                values = np.stack([np.ones(len(y)), y, p, y * y, p * p, y * p, (y - p) ** 2, np.abs(y - p), hit, np.abs(y - p) <= 1], 1)
                r = [_unpacked(batch.column(k + 4 + j), wide) / 2 + 0.5 for j in (0, 1)] if ranks else []
                for key, rows_ in _grouped_keys(batch, k):
                    part, own = w[rows_], [x[rows_] for x in r]
                    sums = [*(part.T @ values[rows_]).T]
                    if ranks:
                        a, b = own
                        sums += [(part * x).sum(0) for x in (a, b, a * a, b * b, a * b)]
                    else:
                        sums += [np.zeros(times)] * 5
                    sums = np.stack(sums)
                    found[key] = found[key] + sums if key in found else sums
        cells = list(zip(*found)) if found and k else [()] * k
        yield pa.RecordBatch.from_arrays([*(pa.array(c, a) for c, a in zip(cells, arrow)), pa.array([s.tobytes() for s in found.values()], pa.binary())], [*keys, "sums"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(rows.schema[c].dataType) for c in keys]
    by_task = plain.mapInArrow(add, ", ".join([*kinds, "sums binary"]))

    def total(key, table):
        s = dict(zip(_SUMS, sum(np.frombuffer(x).reshape(len(_SUMS), -1) for x in table["sums"].to_pylist())))
        with np.errstate(divide="ignore", invalid="ignore"):
            m = {c: s[c] / s["n"] for c in _SUMS}
            var = lambda x, xx: m[xx] - m[x] * m[x]
            line = lambda x, z, xx, zz, xz: np.where((var(x, xx) > 1e-12) & (var(z, zz) > 1e-12), (m[xz] - m[x] * m[z]) / np.sqrt(var(x, xx) * var(z, zz)), np.nan)
            out = {
                "n": s["n"], "rho": line("ry", "rp", "ryy", "rpp", "ryp") if ranks else np.full(len(s["n"]), np.nan), "r2": np.where(var("y", "yy") > 1e-12, 1 - m["ee"] / var("y", "yy"), np.nan),
                "pearson": line("y", "p", "yy", "pp", "yp"), "mae": m["e"], "rmse": np.sqrt(m["ee"]), "accuracy": m["hit"], "within_one": m["near"],
            }
        at = np.flatnonzero(s["n"] > 0)
        columns = [pa.array(at, pa.int32()), pa.array(out["n"][at].astype(np.int64)), *(pa.array(v[at], pa.float64(), from_pandas=True) for c, v in out.items() if c != "n")]
        return pa.table([*(pa.array([x.as_py()] * len(at), t) for x, t in zip(key, arrow)), *columns], names=[*keys, "b", *out])

    ddl = ", ".join([*kinds, "b int", "n bigint", "rho double", "r2 double", "pearson double", "mae double", "rmse double", "accuracy double", "within_one double"])
    return by_task.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(total if keys else (lambda key, t: total((), t)), ddl)


def kappas(rows: DataFrame, times: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys, b and qwk of the rounded and clipped values in each replicate of rows (keys, y, p, w): classes are numbered in the order
    of the labels that the replicate sees on either side. There are few labels, so their confusions are one small array."""
    ship(rows.sparkSession)
    k = len(keys)
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    plain = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull()).select(*keys, ordinal(F.col("y")).cast("int").alias("t"), ordinal(F.col("p")).cast("int").alias("q"), "w")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [*(to_arrow_type(rows.schema[c].dataType) for c in keys), pa.int32(), pa.int32()]

    def add(batches):
        found: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                w = _unpacked(batch.column(k + 2), np.int16)
                for key, rows_ in _grouped_keys(batch, k + 2):
                    s = w[rows_].sum(0, dtype=np.int64)
                    found[key] = found[key] + s if key in found else s
        cells = list(zip(*found)) if found else [()] * (k + 2)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, a) for c, a in zip(cells, arrow)), pa.array([s.tobytes() for s in found.values()], pa.binary())], [*keys, "t", "q", "n"])

    def total(key, table):
        t, q = (np.array(table[c].to_pylist()) for c in "tq")
        n = _unpacked(table["n"].combine_chunks(), np.int64).astype(float)
        labels = np.unique(np.r_[t, q])
        seen = np.stack([((t == x) | (q == x)) @ n > 0 for x in labels])  # of each label, in each replicate
        place = np.cumsum(seen, 0).astype(float)
        a, b = place[np.searchsorted(labels, t)], place[np.searchsorted(labels, q)]
        with np.errstate(divide="ignore", invalid="ignore"):
            m = lambda x: (x * n).sum(0) / n.sum(0)
            expected = m(a * a) + m(b * b) - 2 * m(a) * m(b)
            qwk = np.where(expected > 1e-12, 1 - m((a - b) ** 2) / expected, 0.0)
        at = np.flatnonzero(n.sum(0) > 0)
        return pa.table([*(pa.array([x.as_py()] * len(at), c) for x, c in zip(key, arrow)), pa.array(at, pa.int32()), pa.array(qwk[at])], names=[*keys, "b", "qwk"])

    by_task = plain.mapInArrow(add, ", ".join([*kinds, "t int", "q int", "n binary"]))
    return by_task.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(total if keys else (lambda key, t: total((), t)), ", ".join([*kinds, "b int", "qwk double"]))


def orders(rows: DataFrame, unit: str, keys: Sequence[str], times: int, hashed: Callable[[Column, Column], Column], take: Callable, shape: pa.Schema, ddl: str, ahead: int = 0, more: Mapping[str, type] | None = None, same: Sequence[str] = ()) -> DataFrame:
    """Units (keys, unit, i, n, value, more and same: numbered) in `times` orders by hashed(b, unit), ties by unit, within the keys: the
    rows that take makes of each block of BLOCK places. take(keys, first place, n, entries, *same): entries have b (from 0), place, i
    (the unit's own place by unit), value and more (columns to their types), of the block's places and of the `ahead` that follow
    them, round the end. same: doubles that don't vary within the keys, so they don't move with each entry.

    Hashes come in buckets of about BLOCK units of all orders; a bucket's entries are sorted together, its places start after
    those of the buckets before it, whose sizes alone are added up by key. No order is ever in one task. Sorted entries are
    written as a row for each AT_ONCE orders of a bucket: writers and readers of Parquet hold a hundred rows and more.
    """
    ship(rows.sparkSession)
    more, whole = dict(more or {}), list(keys)
    keys = [*keys, "n", *same]  # n and same go with the keys
    k = len(keys)
    ready = spread(rows, unit).select(*keys, "i", "value", *more, F.transform(F.sequence(F.lit(1), F.lit(times)), lambda b: hashed(b, F.col(unit))).alias("h"))
    entry = np.dtype([("h", np.float64), ("b", np.int16), ("i", np.int64), ("value", np.float64), *more.items()])
    placed = np.dtype([("place", np.int64), *entry.descr[1:]])
    kinds = [f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in keys]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(ready.schema[c].dataType) for c in keys]
    at_n = len(whole)

    def make(batch):
        h = _matrix(batch.column(k + 2 + len(more)), batch.num_rows)
        for key, at in _grouped_keys(batch, k):
            out = np.empty((len(at), times), entry)
            out["h"], out["b"] = h[at], np.arange(times)
            for j, name in enumerate(("i", "value", *more)):
                out[name] = batch.column(k + j).to_numpy(zero_copy_only=False)[at, None]
            buckets = -(-key[at_n] // BLOCK)
            yield key, np.minimum(np.floor(out["h"] * buckets), buckets - 1).astype(np.int64).ravel(), out.ravel()

    def sort(key, bucket, packed):
        e = np.frombuffer(packed, entry)
        e = e[np.lexsort((e["i"], e["h"], e["b"]))]
        counts = np.bincount(e["b"], minlength=times).astype(np.int64)
        upto, firsts = np.r_[0, np.cumsum(counts)], range(0, times, AT_ONCE)
        parts = [e[upto[f] : upto[min(f + AT_ONCE, times)]].tobytes() for f in firsts]
        sizes = [counts[f : f + AT_ONCE].tobytes() for f in firsts]
        return pa.table([*(pa.array([x.as_py()] * len(parts), t) for x, t in zip(key, arrow)), pa.array([bucket] * len(parts), pa.int64()), pa.array(list(firsts), pa.int32()), pa.array(sizes, pa.binary()), pa.array(parts, pa.binary())], names=[*keys, "bucket", "first", "counts", "entries"])

    sorted_ddl = ", ".join([*kinds, "bucket bigint, first int, counts binary, entries binary"])
    sorted_shape = pa.schema([*zip(keys, arrow), ("bucket", pa.int64()), ("first", pa.int32()), ("counts", pa.binary()), ("entries", pa.binary())])
    buckets = written(_moved(ready, keys, make, sort, sorted_shape, sorted_ddl))

    def start(key, table):
        at, out = 0, {}
        for b, c in sorted(zip(table["bucket"].to_pylist(), table["counts"].to_pylist())):
            c = np.frombuffer(c, np.int64)
            out[b] = (np.zeros_like(c) + at).tobytes()
            at = at + c
        return pa.table([*(pa.array([x.as_py()] * len(out), t) for x, t in zip(key, [*arrow, pa.int32()])), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=[*keys, "first", "bucket", "before"])

    starts = buckets.select(*keys, "first", "bucket", "counts").groupBy(*keys, "first").applyInArrow(start, ", ".join([*kinds, "first int, bucket bigint, before binary"]))
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.first") == F.col("b.first"))
    for c in keys:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = buckets.alias("a").join(starts.alias("b"), on).select(*(F.col(f"a.{c}").alias(c) for c in keys), "a.first", "a.counts", "b.before", "a.entries")

    def deal(batch):
        for r in range(batch.num_rows):
            key = tuple(batch.column(j)[r].as_py() for j in range(k))
            counts, before = (np.frombuffer(batch.column(k + j)[r].as_py(), np.int64) for j in (1, 2))
            e = np.frombuffer(batch.column(k + 3)[r].as_py(), entry)
            own = np.arange(len(e)) - np.repeat(np.cumsum(counts) - counts, counts)
            out = np.empty(len(e), placed)
            for c in placed.names[1:]:
                out[c] = e[c]
            out["place"] = before[e["b"] - batch.column(k)[r].as_py()] + own
            n = key[at_n]
            blocks = max(1, -(-n // BLOCK))
            to = out["place"] // BLOCK
            yield key, to, out
            for back in range(1, min(blocks - 1, -(-ahead // BLOCK)) + 1):  # those ahead of earlier blocks
                other = (to - back) % blocks
                near = (out["place"] - np.minimum((other + 1) * BLOCK, n)) % n < ahead
                if near.any():
                    yield key, other[near], out[near]

    def took(key, block, packed):
        return take(key[:at_n], block * BLOCK, key[at_n].as_py(), np.frombuffer(packed, placed), *(x.as_py() for x in key[at_n + 1 :]))

    return _moved(both, keys, deal, took, shape, ddl)


def permuted(units: DataFrame, unit: str, value: str, keys: Sequence[str], times: int, hashed: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, unit and v: the values that the unit gets when those of all are dealt anew in `times` orders (packed doubles)."""
    kinds = [f"`{c}` {units.schema[c].dataType.simpleString()}" for c in keys]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(units.schema[c].dataType) for c in keys]

    def take(key, first, n, e):
        size = min(BLOCK, n - first)
        v = np.zeros((size, times))
        v[e["place"] - first, e["b"]] = e["value"]
        return pa.table([*(pa.array([x.as_py()] * size, t) for x, t in zip(key, arrow)), pa.array(np.arange(first, first + size)), pa.array([r.tobytes() for r in v], pa.binary())], names=[*keys, "i", "v"])

    shape = pa.schema([*zip(keys, arrow), ("i", pa.int64()), ("v", pa.binary())])
    places = numbered(units.select(*keys, unit, F.col(value).cast("double").alias("value")), unit, keys)
    dealt = orders(places, unit, keys, times, hashed, take, shape, ", ".join([*kinds, "i bigint, v binary"]))
    return places.join(dealt, [*keys, "i"]).select(*keys, unit, "v")


def lag_products(vectors: DataFrame, unit: str, edges: DataFrame, keys: Sequence[str], times: int) -> DataFrame:
    """keys, b (from 1), up and s0: over units with neighbours, the sum of each one's value times its neighbours' mean, and their
    number, in each replicate of vectors (keys, unit, v). Edges are joined once; a unit's neighbours stream past its sum."""
    ship(vectors.sparkSession)
    k = len(keys)
    kinds = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keys]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(vectors.schema[c].dataType) for c in keys]
    near = edges.join(vectors.select(*keys, F.col(unit).alias("dst"), "v"), "dst").select(*keys, F.col("src").alias("u"), F.lit(1).alias("kind"), "v")
    own = vectors.select(*keys, F.col(unit).alias("u"), F.lit(0).alias("kind"), "v")
    met = own.union(near).repartition(*keys, "u").sortWithinPartitions(*keys, "u", "kind")

    def add(batches):
        found: dict[tuple, list] = {}
        last, mine, lag, n = object(), None, None, 0

        def close():
            if n and mine is not None:
                s = found.setdefault(last[:k], [np.zeros(times), 0])
                s[0] += mine * (lag / n)
                s[1] += 1

        for batch in batches:
            kind, vs = batch.column(k + 1).to_pylist(), batch.column(k + 2)
            for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(k + 1)))):
                if key != last:
                    close()
                    last, mine, lag, n = key, None, np.zeros(times), 0
                v = np.frombuffer(vs[i].as_py())
                if kind[i]:
                    lag, n = lag + v, n + 1
                else:
                    mine = v
        close()
        cells = list(zip(*found)) if found and k else [()] * k
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cells, arrow)), pa.array([s.tobytes() for s, _ in found.values()], pa.binary()), pa.array([n for _, n in found.values()], pa.int64())], [*keys, "up", "s0"])

    def total(key, table):
        up = sum(np.frombuffer(x) for x in table["up"].to_pylist())
        s0 = sum(table["s0"].to_pylist())
        return pa.table([*(pa.array([x.as_py()] * times, t) for x, t in zip(key, arrow)), pa.array(np.arange(1, times + 1), pa.int32()), pa.array(up), pa.array([s0] * times, pa.int64())], names=[*keys, "b", "up", "s0"])

    sums = met.mapInArrow(add, ", ".join([*kinds, "up binary, s0 bigint"]))
    return sums.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(total if keys else (lambda key, t: total((), t)), ", ".join([*kinds, "b int, up double, s0 bigint"]))


def share_above(units: DataFrame, unit: str, value: str, keys: Sequence[str], times: int, hashed: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """keys, unit and above: in how many orders the unit's value times the mean of the k units that follow it, round the end, over w,
    is at least local_i, to nine digits. units: keys, unit, value, k (at most `most`; 0 or null: not asked), local_i, w (the same within
    the keys)."""
    kinds = [f"`{c}` {units.schema[c].dataType.simpleString()}" for c in keys]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(units.schema[c].dataType) for c in keys]
    nine = lambda x: np.floor(np.abs(x) * 1e9 + 0.5) * np.sign(x)

    def take(key, first, n, e, w):
        size = min(BLOCK, n - first)
        wide = size + min(most, n)
        z, at = np.zeros((wide, times)), (e["place"] - first) % n
        for t in range(0, wide, n):  # a place may come again, round the end
            ok = at + t < wide
            z[(at + t)[ok], e["b"][ok]] = e["value"][ok]
        upto = np.vstack([np.zeros((1, times)), np.cumsum(z, 0)])
        mine = e[(e["place"] >= first) & (e["place"] < first + size) & (e["k"] > 0)]
        p, k = mine["place"] - first, mine["k"].astype(np.int64)
        mean = (upto[p + 1 + k, mine["b"]] - upto[p + 1, mine["b"]]) / mine["k"]
        hit = nine(mine["value"] * mean / w) >= nine(mine["local_i"])
        found, back = np.unique(mine["i"], return_inverse=True)
        above = np.bincount(back, hit, len(found)).astype(np.int64)
        return pa.table([*(pa.array([x.as_py()] * len(found), t) for x, t in zip(key, arrow)), pa.array(found), pa.array(above)], names=[*keys, "i", "above"])

    shape = pa.schema([*zip(keys, arrow), ("i", pa.int64()), ("above", pa.int64())])
    more = {"k": np.int32, "local_i": np.float64}
    plain = units.select(*keys, unit, "w", F.col(value).cast("double").alias("value"), *(F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)).alias(c) for c, t in (("k", "int"), ("local_i", "double"))))
    places = numbered(plain, unit, keys)
    counts = orders(places, unit, keys, times, hashed, take, shape, ", ".join([*kinds, "i bigint, above bigint"]), most, more, ["w"])
    return places.join(counts.groupBy(*keys, "i").agg(F.sum("above").alias("above")), [*keys, "i"]).select(*keys, unit, "above")
