"""Bootstrap over units: resamples are drawn by hash, so any engine draws the same, and all are scored at once from arrays of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.operators import replicates
from areasignal.session import written


def drawn(seed: int, b: Column, i: Column, n: Column) -> Column:
    """The index from 0 to n - 1 that place i of resample b draws."""
    h = F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), b.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, n)


def weighted(long: DataFrame, units: DataFrame, unit: str, times: int, seed: int = 42) -> DataFrame:
    """The columns of long and w: how often each resample of the units draws its unit, packed in one array."""
    weights = replicates.draw_weights(units, unit, times, lambda b, i, n: drawn(seed, b, i, n))
    return replicates.spread(long.join(weights, unit), unit)


def bootstrap(long: DataFrame, unit: str, times: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """b, keys, pooled_rho and pooled_r2 of each resample of the units of long (unit, domain, y, p)."""
    long = written(long)  # units and values both read it
    rows = weighted(long, long, unit, times, seed)
    return replicates.scores(rows, times, keys).select("b", *keys, F.col("rho").alias("pooled_rho"), F.col("r2").alias("pooled_r2"))


#: Columns of a report in their order.
SCORES = ("rmse", "mae", "accuracy", "within_one", "pearson", "rho", "r2", "qwk")


def report(long: DataFrame, unit: str, times: int = 500, seed: int = 42, by: str = "domain", source: str = "model") -> DataFrame:
    """by, source, n and, for each of SCORES, its value and the ends of its interval over resamples of the units; a last row
    `macro` has the means of the values over all rows of `by`."""
    long = written(long.select(unit, by, "y", "p"))  # units and values both read it
    rows = written(weighted(long, long, unit, times, seed))
    as_it_is = rows.withColumn("w", F.lit((1).to_bytes(2, "little")))
    scored = lambda of, n: replicates.scores(of, n, [by]).join(replicates.kappas(of, n, [by]), ["b", by]).select("b", by, "n", *SCORES)
    found = written(scored(rows, times).union(scored(as_it_is, 1).withColumn("b", F.lit(-1))))
    point = found.where("b = -1").drop("b")
    wide = point.join(interval(found.where("b >= 0"), SCORES, [by]), by)
    columns = [x for c in SCORES for x in (c, f"{c}_lo", f"{c}_hi")]
    macro = point.agg(F.sum("n").alias("n"), *(F.avg(c).alias(c) for c in SCORES), *(F.lit(None).cast("double").alias(f"{c}_{e}") for c in SCORES for e in ("lo", "hi")))
    return wide.select(by, F.lit(source).alias("source"), "n", *columns).union(macro.select(F.lit("macro"), F.lit(source), "n", *columns))


def bars(long: DataFrame, unit: str, times: int = 500, seed: int = 42, by: str = "domain") -> DataFrame:
    """by, rmse, mae and for each how far its bar reaches either way: 1.96 deviations over resamples of the units."""
    long = written(long.select(unit, by, "y", "p"))
    rows = weighted(long, long, unit, times, seed)
    again = replicates.scores(rows, times, [by], ranks=False)
    spread = again.groupBy(by).agg(*((1.96 * F.stddev_pop(c)).alias(f"{c}_bar") for c in ("rmse", "mae")))
    e = F.col("y") - F.col("p")
    return rows.groupBy(by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")).join(spread, by)


def interval(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """keys and, for each column, <column>_lo and _hi: percentiles by linear interpolation, nulls left out."""
    ends = ((1 - level) / 2, (1 + level) / 2)
    return df.groupBy(*keys).agg(*(F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in columns for n, q in zip(("lo", "hi"), ends)))


def paired(a: DataFrame, b: DataFrame, unit: str, times: int, seed: int = 42) -> DataFrame:
    """b, delta_rho and delta_r2 of b over a, over the units of both and the same draws."""
    shared = a.select(unit).distinct().join(b.select(unit).distinct(), unit)
    both = a.select(unit, "y", "p", F.lit(0).alias("run")).union(b.select(unit, "y", "p", F.lit(1)))
    found = replicates.scores(weighted(both, shared, unit, times, seed), times, ["run"])
    of = lambda c, run: F.max(F.when(F.col("run") == run, F.col(c)))
    return found.groupBy("b").agg(*((of(c, 1) - of(c, 0)).alias(f"delta_{c}") for c in ("rho", "r2")))
