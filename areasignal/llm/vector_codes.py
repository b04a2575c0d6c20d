"""Product codes of vectors: codebooks by Lloyd's rounds, with one lower bound a group of entries (Yinyang) and whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, kind_of, written

PARTS, ENTRIES, SCALE, ROUNDS, GROUPS = 4, 256, 1024, 4, 16
#: Products of so many dimensions of components up to this are exact in doubles; beyond, numpy counts in Python's whole numbers.
EXACT = 1 << 53


def kept(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def scaled(rows: pa.Array | Sequence[list], width: int) -> np.ndarray:
    """floor(SCALE * x) of each row, put to the width by zeros: doubles where exact, else Python's whole numbers."""
    if isinstance(rows, pa.Array) and len(rows) and (pc.list_value_length(rows).to_numpy() == width).all():
        out = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    else:
        out = np.zeros((len(rows), width))
        for i, r in enumerate(rows.to_pylist() if isinstance(rows, pa.Array) else rows):
            out[i, : len(r)] = r
    with np.errstate(over="ignore"):
        floor = np.floor(out * SCALE)
    if len(out) and np.abs(floor).max(initial=0) >= 1 << 24:
        whole = np.empty(out.shape, object)
        for at, x in np.ndenumerate(out):
            whole[at] = int(x) * SCALE if abs(x) >= EXACT else int(np.floor(x * SCALE))
        return whole
    return floor


def _same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles if every squared distance of theirs is exact there, else both as Python's whole numbers."""
    exact = a.dtype != object and b.dtype != object and 4 * a.shape[-1] * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) ** 2 < EXACT
    as_whole = lambda m: m if m.dtype == object else np.frompyfunc(int, 1, 1)(m)
    return (a, b) if exact else (as_whole(a), as_whole(b))


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all entries, whole numbers."""
    points, entries = _same_kind(points, entries)
    return (points * points).sum(1)[:, None] - 2 * (points @ entries.T) + (entries * entries).sum(1)[None, :]


def _paired(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    points, entries = _same_kind(points, entries)
    gap = points - entries
    return (gap * gap).sum(1)


def _root(squared: np.ndarray, up: bool) -> np.ndarray:
    """Square roots rounded up or down by more than the error of the doubles."""
    return np.sqrt(squared.astype(float)) * (1 + 1e-12 if up else 1 - 1e-12)


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """A group for each entry of one codebook, by a few rounds of Lloyd over the entries themselves: bounded by the codebook."""
    points = entries.astype(float)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)]
    for _ in range(rounds):
        of = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([points[of == g].mean(0) if (of == g).any() else c for g, c in enumerate(centres)])
    return of


class Assigner:
    """Nearest entries of one part's codebook, by bounds kept from round to round.

    `low` has, for each point and group, a distance that no entry of the group but the assigned one comes below. When entries
    move, it falls by the group's largest move (drift). The distance to the assigned entry is counted exactly; only groups
    whose bound isn't above it are scanned, in whole numbers, so ties go to the lower index exactly.
    """

    def __init__(self, entries: np.ndarray, groups: np.ndarray, before: np.ndarray | None = None):
        self.entries, self.members = entries, [np.flatnonzero(groups == g) for g in range(groups.max(initial=-1) + 1)]
        self.groups, self.scanned = groups, 0
        moved = np.zeros(len(entries)) if before is None else _root(_paired(entries, before), True)
        self.drift = np.array([moved[m].max(initial=0) for m in self.members])

    def first(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared distances and bounds from a full scan."""
        code = np.zeros(len(points), np.int64)
        low = np.full((len(points), len(self.members)), -np.inf)
        return self.again(points, code, low)

    def again(self, points: np.ndarray, code: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared distances and bounds from those of the round before."""
        low = low - self.drift
        best, old = code.copy(), _paired(points, self.entries[code])
        least = old.copy()
        need = low <= _root(old, True)[:, None]
        whole = {}
        for g, members in enumerate(self.members):
            at = np.flatnonzero(need[:, g])
            if not len(at) or not len(members):
                continue
            d = distances(points[at], self.entries[members])
            self.scanned += d.size
            if d.dtype != least.dtype:
                least, old = least.astype(object), old.astype(object)
            near = d.argmin(1)  # the first of equal ones: members are in order
            value = d[np.arange(len(at)), near]
            won = (value < least[at]) | ((value == least[at]) & (members[near] < best[at]))
            best[at[won]], least[at[won]] = members[near[won]], value[won]
            whole[g] = at, d
        for g, (at, d) in whole.items():
            own = np.flatnonzero(self.groups[best[at]] == g)
            if len(own):
                d = d.copy()
                d[own, np.searchsorted(self.members[g], best[at[own]])] = EXACT**8 if d.dtype == object else np.inf
            low[at, g] = _root(d.min(1), False)
        left = np.flatnonzero(best != code)  # an entry that was left is again one of its group's others
        if len(left):
            g = self.groups[code[left]]
            low[left, g] = np.minimum(low[left, g], _root(old[left], False))
        return best, least, low


def updated(entries: np.ndarray, counts: dict[int, int], sums: dict[int, list[int]]) -> np.ndarray:
    """Entries replaced by floor(sum / count) of their parts; unused ones stay."""
    out = np.array([[int(x) for x in e] if not counts.get(i) else [s // counts[i] for s in sums[i]] for i, e in enumerate(entries)], object)
    out = out.reshape(entries.shape)
    return out.astype(float) if len(out) and np.abs(out).max() < 1 << 24 else out


def _sums(code: np.ndarray, points: np.ndarray, into: dict, part: int) -> None:
    """Adds the points of each entry (sorted by entry, each run as one sum)."""
    order = np.argsort(code, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(code[order])) + 1] if len(code) else np.zeros(0, int)
    sums = np.add.reduceat(points[order], starts) if len(code) else ()
    for e, n, s in zip(code[order][starts].tolist(), np.diff(np.r_[starts, len(code)]).tolist(), sums):
        add = [int(x) for x in s]
        old = into.get((part, e))
        into[(part, e)] = (n, add) if old is None else (old[0] + n, [a + b for a, b in zip(old[1], add)])


def _pass(books: list[np.ndarray], groups: list[np.ndarray], before: list[np.ndarray] | None, width: int, id_kind: str, label_kind: str, end: bool):
    """The function of a round's tasks: rows (row, label, vector, codes, low) to the same with new codes and bounds, or errors at
    the end. Bounds are stored as floats rounded down."""

    def run(batches):
        makers = [Assigner(b, g, None if before is None else p) for b, g, p in zip(books, groups, before or books)]
        size = width // PARTS
        for batch in batches:
            points = scaled(batch.column(2), width)
            n, spans, at = len(points), [], 0
            old = None if before is None else batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, PARTS)
            bounds = None if before is None else np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(n, -1).astype(float)
            codes, errors = np.zeros((n, PARTS), np.int16), []
            for p, a in enumerate(makers):
                mine, k = points[:, p * size : (p + 1) * size], len(a.members)
                code, least, low = a.first(mine) if before is None else a.again(mine, old[:, p], bounds[:, at : at + k])
                codes[:, p], at = code, at + k
                spans.append(low)
                errors.append(least)
            if end:
                error = [str(sum(int(e[i]) for e in errors)) for i in range(n)]
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.string())], ["id", "label", "code", "error"])
            else:
                low = np.concatenate(spans, 1)
                small = low.astype(np.float32)
                small = np.where(small > low, np.nextafter(small, np.float32(-np.inf)), small)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(np.arange(0, PARTS * n + 1, PARTS, dtype=np.int32)), pa.array(codes.ravel())), pa.array([r.tobytes() for r in small], pa.binary())], ["id", "label", "vector", "codes", "low"]
                )

    return run


def _sums_of(rows: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and sum of the parts of each entry: added up in each task, then by part and entry; what comes to the driver is as
    large as the codebooks."""
    size = width // PARTS

    def add(batches):
        into: dict = {}
        for batch in batches:
            points, codes = scaled(batch.column(0), width), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, PARTS)
            for p in range(PARTS):
                _sums(codes[:, p], points[:, p * size : (p + 1) * size], into, p)
        if into:
            yield pa.RecordBatch.from_pylist([{"part": p, "entry": e, "n": n, "sums": [str(x) for x in s]} for (p, e), (n, s) in into.items()], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    def total(key, table):
        n, out = 0, [0] * size
        for r in table.to_pylist():
            n += r["n"]
            out = [a + int(b) for a, b in zip(out, r["sums"])]
        return pa.table({"part": [key[0].as_py()], "entry": [key[1].as_py()], "n": [n], "sums": [[str(x) for x in out]]}, schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    shape = "part int, entry int, n bigint, sums array<string>"
    by_task = arrow_map(rows.select("vector", "codes"), add, shape)
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["sums"]]) for r in by_task.groupBy("part", "entry").applyInArrow(total, shape).collect()}


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors and the codebooks: rows id, label, code (two hex digits a part), error (a long, the largest if beyond).

    Vectors that are null, or hold null or non-finite components, take no part. Components become floor(1024 * x); vectors are
    cut into 4 parts. The width is that of the longest vector, up to a multiple of 4; shorter ones (empty ones too) are filled
    by zeros. Codebooks start from the 256 smallest ids' parts (or all, if fewer; ids ascending, nulls last, ties by vector),
    and take `rounds` rounds. Repeated rows count each. An empty table has no rows and empty codebooks.

    Each round reads the table before, writes codes and bounds beside the vectors, and adds up sums in its tasks; the driver
    sees the codebooks alone. Two rounds' tables stand on disk at a time.
    """
    plain = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(kept(F.col("vector")))
    width = -(-(plain.agg(F.max(F.size("vector"))).first()[0] or 0) // PARTS) * PARTS
    size = width // PARTS
    seeds = plain.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    kinds = kind_of(plain, "id"), kind_of(plain, "label"), kind_of(plain, "vector")
    start = scaled([r["vector"] for r in seeds], width)
    books = [start[:, p * size : (p + 1) * size] for p in range(PARTS)]
    groups = [grouped(b) if len(b) else np.zeros(0, int) for b in books]
    table, before = plain, None
    for _ in range(rounds if seeds and width else 0):
        shape = f"id {kinds[0]}, label {kinds[1]}, vector {kinds[2]}, codes array<smallint>, low binary"
        done = written(arrow_map(table, _pass(books, groups, before, width, *kinds[:2], False), shape))
        if before is not None:
            _removed(table)
        table, before = done, books
        found = _sums_of(table, width)
        books = [updated(b, {e: n for (q, e), (n, _) in found.items() if q == p}, {e: s for (q, e), (_, s) in found.items() if q == p}) for p, b in enumerate(books)]
    if not seeds or not width:
        rows = plain.select("id", "label", F.lit("00" * PARTS).alias("code"), F.lit("0").alias("error"))
    else:
        rows = arrow_map(table, _pass(books, groups, before, width, *kinds[:2], True), f"id {kinds[0]}, label {kinds[1]}, code string, error string")
    return rows.withColumn("error", F.coalesce(F.expr("try_cast(error AS bigint)"), F.lit((1 << 63) - 1))), books


def _removed(table: DataFrame) -> None:
    """Takes away a round's table that the next one has replaced."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, with commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def decoded(code: str, books: Sequence[np.ndarray]) -> list[float]:
    """The vector that a code stands for: its entries' components over 1024."""
    return [int(x) / SCALE for p, b in enumerate(books) for x in b[int(code[2 * p : 2 * p + 2], 16)]]


def codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """id_col, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256 for each vector.

    Sums by label are aggregated before they are joined to rows, so a label that a third of the rows has doesn't meet in a task.
    """
    rows, books = compressed(df, id_col, vector_col, label_col, rounds)
    rows = written(rows)
    most = F.lit((1 << 63) - 1)
    by = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most.cast("decimal(38,0)")).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(by, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
