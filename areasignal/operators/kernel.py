"""Ridge for fewer rows than features, by the kernel of rows: no matrix of features by features is ever made.

Features are dealt in tiles. A tile's task has all rows' values of its features and adds their products of rows with rows; the
kernel's eigenvalues then serve all penalties, and a tile's weights come from its rows again. Rows are few here by a check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areasignal.session import written

#: Rows up to which the kernel is used where features are more; features of a tile; rows of a kernel's block.
DUAL_ROWS, TILE, BLOCK = 2048, 512, 256


def use(n: int, d: int) -> bool:
    """Whether the kernel of rows is the smaller way."""
    return n < d and n <= DUAL_ROWS


def _predicted(k: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Predictions of the test rows for each target (first) and penalty (second) by the train rows' ridge."""
    coefficients = dual(k[np.ix_(train, train)], y[train], alphas)
    cross = k[np.ix_(test, train)] - k[np.ix_(train, train)].mean(0)
    return y[train].mean(0)[:, None, None] + np.einsum("ij,jta->tai", cross, coefficients)


def dual(k: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Coefficients of rows (rows, targets, penalties) of ridge about the means. They add up to 0."""
    centred = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(centred)
    turned = vectors.T @ (y - y.mean(0))
    scaled = turned[:, :, None] / (np.maximum(values, 0)[:, None, None] + alphas)
    out = np.einsum("ij,jta->ita", vectors, scaled)
    return out - out.mean(0)


def chosen(k: np.ndarray, y: np.ndarray, inner: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (rows, targets) and the penalty of each target with the best mean share of variance explained over the inner
    parts, each left out in turn; the first of equals wins."""
    parts, t = np.unique(inner), y.shape[1]
    best = np.zeros(t, int)
    if len(parts) > 1 and len(alphas) > 1:
        marks = np.zeros((t, len(alphas)))
        for p in parts:
            test = np.flatnonzero(inner == p)
            found = _predicted(k, y, np.flatnonzero(inner != p), test, alphas)
            miss = ((found - y[test].T[:, None, :]) ** 2).sum(2)
            about = ((y[test] - y[test].mean(0)) ** 2).sum(0)[:, None]
            marks -= np.where(about > 1e-12, 1 - miss / np.where(about > 1e-12, about, 1), 0) / len(parts)
        best = marks.argmin(1)
    coefficients = dual(k, y, alphas)
    return coefficients[:, np.arange(t), best], alphas[best]


def _scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray, clip: float | None) -> np.ndarray:
    z = (x - mean) / sd
    return np.clip(z, -clip, clip) if clip else z


def dual_ridge(rows: DataFrame, scaling: dict, clip: float | None, alphas: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each held-out fold its weights ([bias, w] by target) and penalties. rows: unit, fold, inner, x, y; as many as are few."""
    numbered = written(rows.withColumn("i", F.row_number().over(Window.orderBy("unit", "fold")) - 1))  # few rows, by a check
    few = sorted((r.i, r.fold, r.inner, tuple(r.y)) for r in numbered.select("i", "fold", "inner", "y").collect())
    folds, inner, y = (np.array([r[j] for r in few]) for j in (1, 2, 3))
    only = len(scaling) == 1
    train = {k: np.flatnonzero((folds != k) | only) for k in scaling}
    n, d = len(few), len(next(iter(scaling.values()))[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for tile in range(-(-d // TILE)):
                part = np.ascontiguousarray(x[:, tile * TILE : (tile + 1) * TILE])
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(x), pa.int32()), batch.column(0), pa.array([r.tobytes() for r in part], pa.binary())], ["tile", "i", "x"])

    tiles = written(numbered.select(F.col("i").cast("int"), "x").mapInArrow(cut, "tile int, i int, x binary"))

    def values(table: pa.Table) -> np.ndarray:
        x = np.empty((n, len(table["x"][0].as_py()) // 8))
        x[table["i"].to_numpy()] = np.frombuffer(b"".join(table["x"].to_pylist())).reshape(table.num_rows, -1)
        return x

    def products(key: tuple, table: pa.Table) -> pa.Table:
        at, x, out = key[0].as_py() * TILE, values(table), []
        for k, (mean, sd) in scaling.items():
            z = _scaled(x, mean[at : at + TILE], sd[at : at + TILE], clip)[train[k]]
            out += [{"held": k, "block": b, "k": (z[b : b + BLOCK] @ z.T).tobytes()} for b in range(0, len(z), BLOCK)]
        return pa.Table.from_pylist(out, pa.schema([("held", pa.int32()), ("block", pa.int32()), ("k", pa.binary())]))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out():
            return pa.RecordBatch.from_pylist([{"held": key[0], "block": key[1], "k": total.tobytes()}], pa.schema([("held", pa.int32()), ("block", pa.int32()), ("k", pa.binary())]))

        for batch in batches:
            for held, block, k in zip(*(batch.column(j) for j in range(3))):
                now, part = (held.as_py(), block.as_py()), np.frombuffer(k.as_py())
                if now != key:
                    if key is not None:
                        yield out()
                    key, total = now, part
                else:
                    total = total + part
        if key is not None:
            yield out()

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        blocks = [b for _, b in sorted(zip(table["block"].to_pylist(), table["k"].to_pylist()))]
        size = len(train[k])
        kernel = np.frombuffer(b"".join(blocks)).reshape(size, size)
        a, alpha = chosen(kernel, y[train[k]], inner[train[k]], alphas)
        return pa.table([pa.array([k], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([alpha.tolist()], pa.list_(pa.float64()))], names=["held", "a", "alpha"])

    blocks = "held int, block int, k binary"
    by_tile = tiles.groupBy("tile").applyInArrow(products, blocks)
    kernels = by_tile.repartition("held", "block").sortWithinPartitions("held", "block").mapInArrow(summed, blocks)
    solved = {r.held: (np.frombuffer(r.a).reshape(len(train[r.held]), -1), np.array(r.alpha)) for r in kernels.groupBy("held").applyInArrow(solve, "held int, a binary, alpha array<double>").collect()}

    def weights(key: tuple, table: pa.Table) -> pa.Table:
        tile, x, out = key[0].as_py(), values(table), []
        for k, (mean, sd) in scaling.items():
            z = _scaled(x, mean[tile * TILE : (tile + 1) * TILE], sd[tile * TILE : (tile + 1) * TILE], clip)[train[k]]
            w = z.T @ solved[k][0]  # coefficients add up to 0, so means fall out
            out.append({"held": k, "tile": tile, "w": w.tobytes(), "shift": (z.mean(0) @ w).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("held", pa.int32()), ("tile", pa.int32()), ("w", pa.binary()), ("shift", pa.binary())]))

    found = tiles.groupBy("tile").applyInArrow(weights, "held int, tile int, w binary, shift binary").collect()
    made = {}
    for k in scaling:
        mine = sorted((r.tile, bytes(r.w), bytes(r.shift)) for r in found if r.held == k)
        w = np.frombuffer(b"".join(m[1] for m in mine)).reshape(d, -1)
        bias = y[train[k]].mean(0) - sum(np.frombuffer(m[2]) for m in mine)
        made[k] = np.vstack([bias, w]), solved[k][1]
    return made
