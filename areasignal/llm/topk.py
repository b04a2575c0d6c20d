"""Exact top-k inner products over an impact-ordered index, processed score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, written

#: Components of a shard's vectors, queries scored together, quantised impacts; of how many vectors one may be left to score.
SHARD, QUERIES, LEVELS, FEW = 1 << 20, 64, 8, 16
#: Sums of products below this are exact in doubles; what a score may be.
EXACT, LONG = float(1 << 53), (1 << 63) - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a whole double; null for a vector that is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)  # noqa: E731  (larger doubles are whole)
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: whole(x.cast("double") * scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter ones end in zeros."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(ends) and (ends == ends[0]).all():
        return values.reshape(len(ends), -1)
    out = np.zeros((len(ends), ends.max(initial=0)))
    out[np.arange(out.shape[1]) < ends[:, None]] = values
    return out


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    width = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]) if parts else np.zeros((0, 0))


class Index:
    """Posting lists of one shard: for each quantised impact, largest first, and each dimension, the vectors whose component
    there has that impact, with it.

    rest[l] has for each vector the length of what the segments after l hold of it: by Cauchy and Schwarz, a query's length
    times that bounds what they can still add. Sums run in single precision over components divided by the largest one;
    what rounding can take off or add is in rest as well, and members are scored exactly from the components themselves.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray) -> None:
        self.ids, self.q = ids, q
        self.top = float(np.abs(q).max(initial=0)) or 1.0
        x = q / self.top
        size = np.abs(x)
        some = size[size > 0]
        bounds = np.unique(np.quantile(some, np.linspace(0, 1, LEVELS + 1)[1:-1])) if some.size else np.zeros(0)
        level = np.where(size > 0, np.searchsorted(bounds, size), -1).T
        wide = np.ascontiguousarray(x.T, dtype=np.float32)
        self.segments: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.rest = []
        rounding = np.sqrt((x**2).sum(axis=1)) * (q.shape[1] + 2) * 2.0**-22
        for l in range(len(bounds), -1, -1):
            self.segments.append([(d, at.astype(np.int32), wide[d, at]) for d in range(len(wide)) if len(at := np.flatnonzero(level[d] == l))])
            self.rest.append((np.sqrt(np.where(level.T < l, x**2, 0.0).sum(axis=1)) * (1 + 1e-9) + rounding).astype(np.float32))
        norms = np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)
        self.tells = [len(r) > 0 and bool(np.median(r / norms) < 0.25) for r in self.rest]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each query its k best of the shard by exact score, ties to the smaller id: ids and scores.

        Segments are added in falling order of impact. A query is done as soon as the bounds prove all but a small part of the
        vectors out of its k best, or no segment is left; then all its possible members are scored exactly.
        """
        out: list[tuple[np.ndarray, list[int]]] = [(self.ids[:0], [])] * len(queries)
        width = max(queries.shape[1], self.q.shape[1])
        exact = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
        top = np.maximum(np.abs(exact).max(axis=1, initial=0), 1e-300)
        scaled = (exact / top[:, None]).astype(np.float32)
        lengths = (np.sqrt((scaled.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)).astype(np.float32)
        open_ = np.arange(len(queries))
        score = np.zeros((len(self.ids), len(queries)), np.float32)
        own = [np.flatnonzero(self.ids == i) for i in query_ids]
        above = k + max(map(len, own), default=0)  # so many best ones hold k others than a query's own
        few = max(4 * k, len(self.ids) // FEW)
        for at, (segment, rest) in enumerate(zip(self.segments, self.rest)):
            weights = scaled[open_]
            for d, vectors, impacts in segment:
                score[vectors] += impacts[:, None] * weights[:, d]
            last = at == len(self.segments) - 1
            if not last and not self.tells[at]:
                continue
            slack = rest[:, None] * lengths[open_]
            if len(self.ids) > above:
                low = score - slack
                low.partition(len(low) - above, axis=0)
                member = score + slack >= low[len(low) - above]
            else:
                member = np.ones(score.shape, bool)
            done = np.full(len(open_), True) if last else np.count_nonzero(member, axis=0) <= few
            for j in np.flatnonzero(done):
                member[own[open_[j]], j] = False
                out[open_[j]] = self._best(np.flatnonzero(member[:, j]), exact[open_[j]], k)
            if done.all():
                break
            if done.any():
                open_, score = open_[~done], np.ascontiguousarray(score[:, ~done])
        return out

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        width = self.q.shape[1]
        if self.top * float(np.abs(query).max(initial=0)) * max(1, width) < EXACT:
            scores = [int(s) for s in self.q[rows] @ query[:width]]
        else:  # whole numbers of any size
            of = [int(x) for x in query[:width]]
            scores = [sum(int(a) * b for a, b in zip(self.q[r].tolist(), of)) for r in rows]
        scores, ids = [max(-LONG - 1, min(LONG, s)) for s in scores], self.ids[rows].tolist()
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[i]))[:k]
        return self.ids[rows[order]], [scores[i] for i in order]


def top_k(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), id_col and score: for each row whose id is divisible by `every`, the k other rows of the
    highest integer inner product of the quantised vectors, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and null ids, take no part; shorter vectors count as ending
    in zeros. Rows with the query's id are its own and never its candidates; rows alike in id and vector ask once, and each
    is a candidate. Scores are exact for all finite components; one outside a long's range is the nearest long.

    Each row goes to one shard, whose index one task builds and holds; the queries, which alone are repeated, stream past
    every shard in blocks. A shard gives its k best for each query. An empty table gives no rows.
    """
    rows = written(df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("q")).where("id IS NOT NULL AND q IS NOT NULL"))
    shards = max(1, -(-(rows.agg(F.sum(F.size("q").cast("long"))).first()[0] or 0) // SHARD))
    indexed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "q")
    asked = rows.where(F.col("id") % every == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "q")
    dealt = indexed.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []

        def answered(asks: np.ndarray, queries: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(asks), QUERIES):
                found = index.search(queries[at : at + QUERIES], asks[at : at + QUERIES], k)
                n = [len(f[0]) for f in found]
                scores = pa.array([s for f in found for s in f[1]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asks[at : at + QUERIES], n)), pa.array(np.concatenate([f[0] for f in found])), scores], ["query_id", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]])
            bounds = [0, *(np.flatnonzero(np.diff(kinds).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                here, asks = kinds[:, a].tolist()
                part, q = batch.column(2)[a:b].to_numpy(zero_copy_only=False), _matrix(batch.column(3)[a:b])
                if here != shard:
                    shard, index, ids, vectors = here, None, [], []
                if not asks:
                    ids.append(part)
                    vectors.append(q)
                else:
                    if index is None:
                        index = Index(np.concatenate(ids), _stacked(vectors)) if ids else Index(np.zeros(0, np.int64), np.zeros((0, 0)))
                        ids, vectors = [], []
                    yield from answered(part, q)

    best = arrow_map(dealt, run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
