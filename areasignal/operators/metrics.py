"""Ranks and scores of predictions, each in plans whose size doesn't depend on the largest group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.session import written


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """keys, each value seen within them (or over all rows) and its average rank; nulls are left out.

    Equal values are counted first; the counts are dealt by range, and what lies before a range within a key comes from
    sums by range, so no task holds a key's rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("_n").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s"))
    joined = dealt.join(before, [*keys, "_p"])
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy(value))
    return joined.select(*keys, value, (F.col("_before") + upto - (F.col("_n") - 1) / 2.0).alias(name))


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with the average rank of a value within the keys (or over all rows); nulls get none. Ranks are joined by key and value."""
    return df.join(value_ranks(df, value, keys, name), [*keys, value], "left")


def varies(x: Column) -> Column:
    """Whether there are two different values, as an aggregate."""
    return F.min(x) < F.max(x)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, as an aggregate; null if either is constant or there are fewer than two pairs. Constants are known by their ends:
    the deviation of equal values isn't always 0 where it comes from several tasks."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.when((F.count(x) > 1) & varies(x) & varies(y) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def r_squared(y: Column, p: Column) -> Column:
    """1 less the squared errors over the squares about the mean; null if y is constant."""
    both = y.isNotNull() & p.isNotNull()
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.when(varies(F.when(both, y)), F.nullif(F.var_pop(F.when(both, y)) * F.count_if(both), F.lit(0.0))))


def _pairs(df: DataFrame, y: str, p: str, keys: Sequence[str]) -> DataFrame:
    """keys, _y and _p2 of the pairs without nulls, of one type, written once: what is ranked and scored is read several times."""
    kind = df.schema[y].dataType.simpleString() if df.schema[y].dataType == df.schema[p].dataType else "double"
    return written(df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*keys, F.col(y).cast(kind).alias("_y"), F.col(p).cast(kind).alias("_p2")))


def _rho(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n and rho. Both sides of the pairs are ranked in one pass, as values of one dealt table."""
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("_side"), F.col(c).alias("_v")) for i, c in enumerate(("_y", "_p2")))))
    ranks = value_ranks(pairs.select(*keys, sides.alias("_x")).select(*keys, "_x.*"), "_v", [*keys, "_side"], "_r")
    of = lambda i, c, r: ranks.where(F.col("_side") == i).select(*keys, F.col("_v").alias(c), F.col("_r").alias(r))
    ranked = pairs.join(of(0, "_y", "_ry"), [*keys, "_y"]).join(of(1, "_p2", "_rp"), [*keys, "_p2"])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation(F.col("_ry"), F.col("_rp")).alias("rho"))


def _with_few(found: DataFrame, df: DataFrame, keys: Sequence[str], few: float | None) -> DataFrame:
    """found with a row for each of df's keys: rho is `few` of fewer than two pairs, mae and rmse are of none."""
    if few is None:
        return found
    found = (df.select(*keys).distinct().join(found, list(keys), "left") if keys else found).withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    least = {"rho": 2, "mae": 1, "rmse": 1}
    return found.withColumns({c: F.when(F.col("n") < k, F.lit(few)).otherwise(F.col(c)) for c, k in least.items() if c in found.columns})


def spearman(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), few: float | None = None) -> DataFrame:
    """keys, n and rho of pairs without nulls. few: rho of keys with fewer than two (none at all included); else these are null,
    and keys without pairs left out. Constants have no rho."""
    return _with_few(_rho(_pairs(df, y, p, keys), keys), df, keys, few)


def scores(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), few: float | None = None) -> DataFrame:
    """keys, n, rho, r2, pearson, mae and rmse. few: as of spearman, and mae and rmse of keys without pairs."""
    pairs, a, b = _pairs(df, y, p, keys), F.col("_y"), F.col("_p2")
    plain = pairs.groupBy(*keys).agg(r_squared(a, b).alias("r2"), correlation(a, b).alias("pearson"), F.avg(F.abs(a - b)).alias("mae"), F.sqrt(F.avg((a - b) ** 2)).alias("rmse"))
    rho = _rho(pairs, keys)
    return _with_few(rho.join(plain, list(keys)) if keys else rho.crossJoin(plain), df, keys, few)  # one row each


def unpivoted(df: DataFrame, ids: Sequence[str], domains: Sequence[str], pred: str = "pred_", target: str = "target_") -> DataFrame:
    """ids, domain, y and p: a row for each domain of wide predictions."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"{target}{d}").cast("double").alias("y"), F.col(f"{pred}{d}").cast("double").alias("p")) for d in domains)))
    return df.select(*ids, pairs.alias("_d")).select(*ids, "_d.*")


def also_pooled(long: DataFrame, name: str = "pooled", domain: str = "domain") -> DataFrame:
    """long with each row once more under one name for all domains, so that scores by domain and pooled come from one pass."""
    return long.withColumn(domain, F.explode(F.array(domain, F.lit(name))))


def pooled(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, pooled_rho and pooled_r2 over all domains stacked."""
    return scores(long, "y", "p", keys).select(*keys, "n", F.col("rho").alias("pooled_rho"), F.col("r2").alias("pooled_r2"))


def macro(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, macro_rho and macro_r2: means over domains."""
    by = scores(long, "y", "p", [*keys, "domain"])
    return by.groupBy(*keys).agg(F.avg("rho").alias("macro_rho"), F.avg("r2").alias("macro_r2"))


def confusion(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, t, q and n: how often each pair of classes is seen, or the sum of its weights."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(y).alias("t"), F.col(p).alias("q")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))


def classification(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, accuracy, balanced_accuracy (mean recall of true classes) and macro_f1 (over all classes seen)."""
    c = confusion(df, y, p, keys)
    sides = c.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit("t").alias("_side")), F.struct(F.col("q").alias("label"), F.lit("q").alias("_side")))).alias("x"), "n", (F.col("t") == F.col("q")).alias("ok")).select(*keys, "x.*", "n", "ok")
    by = sides.groupBy(*keys, "label").agg(*(F.sum(F.when(F.col("_side") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in "tq"), F.sum(F.when(F.col("ok") & (F.col("_side") == "t"), F.col("n")).otherwise(0)).alias("hit"))
    recall = F.when(F.col("n_t") > 0, F.try_divide("hit", "n_t"))
    f1 = F.try_divide(2 * F.col("hit"), F.col("n_t") + F.col("n_q"))
    return by.groupBy(*keys).agg((F.sum("hit") / F.sum("n_t")).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"))


def kappa(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys and qwk: 1 less the mean squared difference over that of independent marginals; 0 if there is none.

    The steps between classes are those of their values, so the number of classes doesn't matter.
    """
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    both = df.where(a.isNotNull() & b.isNotNull())
    expected = F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)
    return both.groupBy(*keys).agg(F.coalesce(1 - F.try_divide(F.avg((a - b) * (a - b)), F.when(expected > 1e-12, expected)), F.lit(0.0)).alias("qwk"))


def kappa_of_labels(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """As kappa, but classes are numbered in the order of the labels seen on either side."""
    c = confusion(df, y, p, keys, weight)
    labels = c.select(*keys, F.col("t").alias("label")).union(c.select(*keys, F.col("q"))).distinct()
    index = labels.withColumn("i", F.dense_rank().over(Window.partitionBy(*keys).orderBy("label")))  # classes, not rows
    at = lambda side, name: index.withColumnsRenamed({"label": side, "i": name})
    both = c.join(at("t", "_a"), [*keys, "t"]).join(at("q", "_b"), [*keys, "q"])
    w, n = lambda x: F.sum(x * F.col("n")), F.sum("n")
    a, b = F.col("_a").cast("double"), F.col("_b").cast("double")
    expected = w(a * a) / n + w(b * b) / n - 2 * w(a) / n * w(b) / n
    return both.groupBy(*keys).agg(F.coalesce(1 - F.try_divide(w((a - b) * (a - b)) / n, F.when(expected > 1e-12, expected)), F.lit(0.0)).alias("qwk"))


def within_one(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), low: int = 1, high: int = 10) -> DataFrame:
    """keys, accuracy of rounded and clipped values, within_one of the values as they are."""
    from areasignal.functions.vectors import ordinal

    a, b = F.col(y), F.col(p)
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.avg((ordinal(a, low, high) == ordinal(b, low, high)).cast("double")).alias("accuracy"), F.avg((F.abs(a - b) <= 1).cast("double")).alias("within_one"))


def deltas(df: DataFrame, run: str, order: str, columns: Sequence[str], first: str | None = None) -> DataFrame:
    """df with delta_<column>: less the value of the first run by order (or of the run named)."""
    base = df.where(F.col(run) == first) if first else df.orderBy(order).limit(1)
    return df.crossJoin(F.broadcast(base.select(*(F.col(c).alias(f"_b_{c}") for c in columns)))).select(*df.columns, *((F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in columns))  # one row


def cross_correlation(a: DataFrame, b: DataFrame, unit: str, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """left, right, n and rho (Spearman) of every pair of columns, over the units of both."""
    long = lambda df, cols, name, v: df.select(unit, F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(v)) for c in cols))).alias("_s")).select(unit, "_s.*")
    pairs = long(a, left, "left", "x").join(long(b, right, "right", "z"), unit)
    return spearman(pairs, "x", "z", ["left", "right"])


def signed(x: Column, digits: int = 4) -> Column:
    """A number as text with its sign, rounded as C's printf does: by its exact binary value, exact ties to even (Java's formatter
    rounds the shortest decimal half up)."""
    return F.udf(lambda v: None if v is None else f"{v:+.{digits}f}", "string")(x.cast("double"))


def markdown(rows: list[dict], columns: Sequence[str]) -> str:
    """A table of a report's few rows."""
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(r.get(c, "") for c in columns) for r in rows)])
