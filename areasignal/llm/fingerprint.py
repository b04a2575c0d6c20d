"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, kind_of

#: Words of a shingle, bins, low-order bits kept of each bin.
WORDS, BINS, BITS = 5, 512, 4
_FACTORS = np.array([xxhash.xxh3_64_intdigest(b"factor %d" % i) | 1 for i in range(WORDS)], np.uint64)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
#: For each bin the bins that it asks in turn when empty: the same for all documents.
_PROBES = np.array([[xxhash.xxh3_64_intdigest(b"%d %d" % (b, t)) % BINS for t in range(64)] for b in range(BINS)], np.int64)
_SALTS = np.array([xxhash.xxh3_64_intdigest(b"salt %d" % b) for b in range(BINS)], np.uint64)
_LATE = np.array([xxhash.xxh3_64_intdigest(b"late %d" % b) % BINS for b in range(BINS)], np.int64)


class _Words(dict):
    """Hashes of words seen lately; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str) -> np.ndarray:
    """Hashes of the word 5-grams (lower-cased A-Z, split at ASCII white space); fewer words are one shingle, none is none."""
    words = text.encode().lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for j in range(min(WORDS, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n] * _FACTORS[j]
        out ^= out >> np.uint64(29)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(32))


def fingerprint(hashes: np.ndarray) -> np.ndarray | None:
    """The low-order bits of each bin's value; None without shingles.

    Each hash is binned once, by its leading bits, and the least of a bin is its value. An empty bin takes the value of the
    first bin with one among those it asks in a fixed random order (optimal densification); should 64 be empty, it goes on
    from its own random place. A value is hashed with its bin before its low-order bits are kept: else a text of few
    shingles, whose bins share values, would agree by chance with another one in many bins at once.
    """
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    first = np.searchsorted(ordered, _EDGES)
    full = np.diff(np.append(first, len(ordered))) > 0
    value = ordered[np.minimum(first, len(ordered) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        asked = full[_PROBES[empty]]
        source = _PROBES[empty, asked.argmax(axis=1)]
        if len(late := np.flatnonzero(~asked.any(axis=1))):
            there = np.flatnonzero(full)
            source[late] = there[np.searchsorted(there, _LATE[empty[late]]) % len(there)]
        value[empty] = value[source]
    value = (value ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
    return ((value ^ value >> np.uint64(32)) >> np.uint64(8)).astype(np.uint8) & np.uint8((1 << BITS) - 1)


def packed(fp: np.ndarray | None) -> str:
    """Hexadecimal digits, one for a bin; all zero without shingles."""
    return "0" * BINS if fp is None else (fp[0::2] << 4 | fp[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less what bits that agree by chance add. No shingles on
    both sides is 1, on one side 0."""
    if a is None or b is None:
        return float(a is b)
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many code points from the start of the other, or all."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt so that each follows its predecessor by id within its partition and bucket, and every bucket ends with
    a copy of the row that comes after it (tail = 1): bucket, tail, id, text.

    The bounds of the buckets are quantiles of the ids (numbers; null comes first); bounds and first ids, of which there
    are as many as buckets, are all that the driver collects. One shuffle moves the texts, buckets of one range to one task.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = rows.select(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    bounds = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<bigint>")
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("id")))))
    firsts = sorted(rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id")).alias("first")).collect(), key=lambda r: r.bucket)
    to = [(r.first["id"], firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    starts = spark.createDataFrame(to, f"start {kind_of(df, id_col)}, to int")
    joined = rows.join(F.broadcast(starts), F.col("id").eqNullSafe(F.col("start")), "left")
    place = lambda b, t: F.struct(b.cast("int").alias("bucket"), F.lit(t).alias("tail"))
    places = F.when(F.col("to").isNull(), F.array(place(F.col("bucket"), 0))).otherwise(F.array(place(F.col("bucket"), 0), place(F.col("to"), 1)))
    return joined.select("id", "text", F.explode(places).alias("p")).select("p.bucket", "p.tail", "id", "text").repartitionByRange("bucket").sortWithinPartitions("bucket", "tail", "id", "text")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is `edited` of the text and that of the next row in order of id (after the last: the first; a single
    row is its own next). A null text is empty. Rows with equal ids are ordered by text; a null id comes before all.
    Other columns don't matter. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text, its fingerprint
        out: list[tuple] = []
        names = (id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

        def batch_of(kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            made = pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for bucket, tail, key, text in zip(*(batch.column(j) for j in range(4))):
                bucket, key, text = bucket.as_py(), key.as_py(), text.as_py()
                if held is not None and held[0] != bucket:
                    held = None
                if held is None and tail.as_py():  # another copy of a tail that was used
                    continue
                fp = fingerprint(shingles(text))
                if held is not None:
                    new = edited(held[2], text)
                    new_fp = fingerprint(shingles(new))
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), packed(held[3]), packed(new_fp), likeness(held[3], new_fp), likeness(held[3], fp)))
                held = None if tail.as_py() else (bucket, key, text, fp)
                if len(out) >= 512:
                    yield batch_of(batch.schema.field(2).type)
            if out:
                yield batch_of(batch.schema.field(2).type)

    kinds = f"`{id_col}` {kind_of(df, id_col)}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(in_order(df, id_col, text_col), run, kinds)
