"""Keyed tables: first and last rows of a key, resuming, counts by type, pooling, imputing."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areasignal.functions.text import groups_of, phrase_key, tidy
from areasignal.session import written


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order; an aggregate, so rows are combined before they are shuffled."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What isn't done yet: rows of todo without their key in done."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the rows of left that it drops."""
    return left.join(right, list(keys)), left.join(right.select(*keys), list(keys), "left_anti")


def looked_up(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """left with the columns in defaults from right, which has a row for a key at most; where it has none, the defaults, and
    missing is 1."""
    side = right.select(*keys, *(F.col(c).alias(f"_{c}") for c in defaults), F.lit(0).alias("_there"))
    joined = left.join(side, list(keys), "left")
    return joined.select(*left.columns, *(F.when(F.col("_there").isNull(), F.lit(d)).otherwise(F.col(f"_{c}")).alias(c) for c, d in defaults.items()), F.coalesce("_there", F.lit(1)).alias("missing"))


def aligned(base: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """base with the columns of each block in turn, null where a block has no row of the key; a name that is taken gets the
    block's number before it."""
    out = base
    for i, block in enumerate(blocks):
        names = {c: f"b{i}_{c}" if c in out.columns else c for c in block.columns if c != key}
        out = out.join(block.withColumnsRenamed(names), key, "left")
    return out


def shared(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys that all tables have, once each."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def union_of(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys (first columns) of any of the tables, once each."""
    out = tables[0].select(F.col(tables[0].columns[0]).alias(key))
    for t in tables[1:]:
        out = out.union(t.select(t.columns[0]))
    return out.distinct()


def observed(units: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """Units that have an observation."""
    return units.join(observations.select(key), key, "left_semi")


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition."""
    return df.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """df with a number from 0 for each row within its key, by order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def resolve(columns: Sequence[str], candidates: Sequence[str], contains: Sequence[str] = ()) -> str:
    """The first candidate among the columns, else the first column that contains one of the words."""
    lower = {c.lower(): c for c in reversed(columns)}
    for c in candidates:
        if c in columns:
            return c
        if c.lower() in lower:
            return lower[c.lower()]
    for c in columns:
        if any(w in c.lower() for w in contains):
            return c
    raise ValueError(f"none of {list(candidates)} in {list(columns)}")


def select_columns(columns: Sequence[str], spec: Sequence[str]) -> list[str]:
    """`mean` and `std` stand for all columns ending so, sorted; other names for themselves; each once."""
    out: list[str] = []
    for s in spec:
        found = sorted(c for c in columns if c.endswith(f"_{s}")) if s in ("mean", "std") else [s] if s in columns else []
        if not found:
            raise ValueError(f"no column for {s!r}")
        out += [c for c in found if c not in out]
    return out


def type_counts(df: DataFrame, units: DataFrame, unit: str, kind: str, vocabulary: Sequence[str]) -> DataFrame:
    """For each row of units: total (of all types) and a column for each type of the vocabulary, 0 without rows."""
    counts = df.groupBy(unit).agg(F.count("*").alias("total"), *(F.count_if(F.col(kind) == v).alias(v) for v in vocabulary))
    return units.join(counts, unit, "left").fillna(0, ["total", *vocabulary])


def count_map(df: DataFrame, unit: str, kind: str) -> DataFrame:
    """unit and a map of type to count."""
    return df.groupBy(unit, kind).agg(F.count("*").alias("_n")).groupBy(unit).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias("counts"))


def vocabulary(df: DataFrame, kind: str, n: str, most: int) -> list[str]:
    """The types of the largest sums, ties by name; as many names as asked for reach the driver."""
    return [r[0] for r in df.groupBy(kind).agg(F.sum(n).alias("_n")).orderBy(F.desc("_n"), kind).limit(most).collect()]


class CountScaler:
    """Counts of a fixed vocabulary and the rest, as log1p, scaled by the mean and deviation of the units it was fitted on."""

    def __init__(self, most: int = 15) -> None:
        self.most, self.names, self.moments = most, [], {}

    def _raw(self, df: DataFrame, unit: str, kind: str, n: str) -> DataFrame:
        known = F.when(F.col(kind).isin(self.names), F.col(kind)).otherwise("other")
        sums = df.withColumn("_k", known).groupBy(unit).agg(*(F.log1p(F.sum(F.when(F.col("_k") == v, F.col(n)).otherwise(0)).cast("double")).alias(v) for v in self.columns))
        return sums

    @property
    def columns(self) -> list[str]:
        return [*self.names, "other"]

    def fit(self, df: DataFrame, unit: str, kind: str, n: str) -> CountScaler:
        self.names = vocabulary(df, kind, n, self.most)
        r = self._raw(df, unit, kind, n).agg(*(f(c).alias(f"{c}_{i}") for c in self.columns for i, f in enumerate((F.avg, F.stddev_pop)))).first()
        self.moments = {c: (r[f"{c}_0"] or 0.0, r[f"{c}_1"] or 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame, unit: str, kind: str, n: str) -> DataFrame:
        return self._raw(df, unit, kind, n).select(unit, *(((F.col(c) - m) / s).alias(c) for c, (m, s) in self.moments.items()))

    def save(self, spark: SparkSession, path: str) -> None:
        """The kinds and their moments as a table, a row for each column."""
        rows = [(i, c, *map(float, self.moments[c])) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, "at int, name string, mean double, sd double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CountScaler:
        """What `save` wrote."""
        rows = spark.read.parquet(path).orderBy("at").collect()
        out = cls(sum(r.name != "other" for r in rows))
        out.names = [r.name for r in rows if r.name != "other"]
        out.moments = {r.name: (r.mean, r.sd) for r in rows}
        return out


def top_phrases_by(df: DataFrame, unit: str, phrase: str, order: Sequence[str], most: int) -> DataFrame:
    """unit, place, phrase, n: the most frequent phrases of each unit, ties by key, spelled as first seen."""
    tidied = df.withColumn("_p", tidy(F.col(phrase))).where(F.coalesce("_p", F.lit("")) != "")
    by = tidied.groupBy(unit, F.lower("_p").alias("_k")).agg(F.count("*").alias("n"), F.min_by("_p", F.struct(*order, "_p")).alias("phrase"))
    lists = by.groupBy(unit).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "_k", "phrase"))), 1, most).alias("_l"))
    return lists.select(unit, F.posexplode("_l").alias("at", "r")).select(unit, (F.col("at") + 1).alias("place"), "r.phrase", (-F.col("r.m")).alias("n"))


def group_counts(df: DataFrame, unit: str, phrase: str) -> DataFrame:
    """unit, grp and n: how many phrases of each unit are in each keyword group. Patterns are matched once for each phrase
    that there is, however many units have it."""
    distinct = written(df.groupBy(unit, tidy(F.col(phrase)).alias("_p")).agg(F.count("*").alias("_n")))
    groups = phrase_groups(distinct, "_p").withColumnRenamed("_p", "_of")
    return distinct.join(groups, F.col("_p").eqNullSafe(F.col("_of"))).select(unit, F.explode("_gs").alias("grp"), "_n").groupBy(unit, "grp").agg(F.sum("_n").alias("n"))


def phrase_groups(df: DataFrame, phrase: str) -> DataFrame:
    """phrase and _gs: the keyword groups of each distinct phrase."""
    return df.select(phrase).distinct().withColumn("_gs", groups_of(F.col(phrase)))


def first_phrases(df: DataFrame, keys: Sequence[str], phrase: str, order: Sequence[str]) -> DataFrame:
    """keys and phrases: distinct phrases in the order in which each came first, trimmed."""
    named = df.withColumn("_k", phrase_key(F.col(phrase))).where(F.coalesce("_k", F.lit("")) != "")
    # each spelling's first place in hash tables; only spellings are sorted, not rows
    spelled = named.groupBy(*keys, "_k", F.trim(F.col(phrase)).alias("_p")).agg(F.min(order[0] if len(order) == 1 else F.struct(*order)).alias("_o"))
    first = spelled.groupBy(*keys, "_k").agg(F.min(F.struct("_o", "_p")).alias("_r"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_p"]).alias("phrases"))


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, pos and value: the mean of each component over a key's rows; components are combined before the shuffle."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "_x")).groupBy(*keys, "pos").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys and the mean vector."""
    pooled = mean_pool(df, keys, vector)
    return pooled.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda r: r["value"]).alias(vector))


def impute_by_fold(df: DataFrame, fold: str, columns: Sequence[str], folds: Sequence[int]) -> DataFrame:
    """A copy of the rows for each held-out fold, with nulls replaced by the mean of the other folds, else 0.

    The means come from sums by fold, so the rows are read once for them whatever the number of folds.
    """
    sums = df.groupBy(fold).agg(*(f(c).alias(f"_{i}_{c}") for c in columns for i, f in enumerate((F.sum, F.count))))
    held = df.sparkSession.createDataFrame([(k,) for k in folds], "held_out int")
    means = sums.join(F.broadcast(held), F.col(fold) != F.col("held_out"), "right").groupBy("held_out").agg(*(F.try_divide(F.sum(f"_0_{c}"), F.sum(f"_1_{c}")).alias(f"_m_{c}") for c in columns))
    out = df.withColumn("held_out", F.explode(F.array(*map(F.lit, folds)))).join(F.broadcast(means), "held_out")
    return out.select("held_out", *(F.coalesce(c, f"_m_{c}", F.lit(0.0)).alias(c) if c in columns else c for c in df.columns))


# Pixel classes that are kept, by channel; all others together are `other`.
PIXEL_CLASSES = {1: "building", 2: "sky", 4: "tree", 6: "road", 9: "grass", 11: "sidewalk", 12: "person", 13: "earth", 17: "plant", 20: "car", 32: "fence", 43: "signboard", 87: "streetlight", 93: "pole"}
RATIOS = (*PIXEL_CLASSES.values(), "other")


def class_ratios(df: DataFrame, image: str, channel: str) -> DataFrame:
    """A row for each image: the share of each kept class, and of all others."""
    return df.groupBy(image).agg(*((F.count_if(F.col(channel) == k) / F.count("*")).alias(v) for k, v in PIXEL_CLASSES.items()), F.greatest(F.lit(0.0), 1 - F.count_if(F.col(channel).isin(*PIXEL_CLASSES)) / F.count("*")).alias("other"))


def poor_image() -> Column:
    """Images that show a wall, the road alone or nothing known; those with nulls aren't."""
    c = F.col
    return F.coalesce(((c("sky") < 0.01) & (c("building") > 0.6)) | ((c("road") > 0.5) & (c("sidewalk") < 0.01) & (c("building") < 0.1)) | (c("other") > 0.8), F.lit(False))


def unit_ratios(df: DataFrame, unit: str, tile: str | None = None, columns: Sequence[str] = RATIOS) -> DataFrame:
    """n_images, n_filtered, mean and population deviation of each ratio over the images kept; null means without any."""
    bad = poor_image()
    of = lambda f, c: f(F.when(~bad, F.col(c)))
    counts = [F.count("*").alias("n_images"), F.count_if(bad).alias("n_filtered"), *([F.count_distinct(tile).alias("n_tiles")] if tile else [])]
    return df.groupBy(unit).agg(*counts, *(x for c in columns for x in (of(F.avg, c).alias(f"{c}_mean"), of(F.stddev_pop, c).alias(f"{c}_std"))))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """keys and a column for each name: the value at that share of the ordered values, by linear interpolation; nulls and NaN are
    left out.

    Equal values are counted first and the counts dealt by range. Sums by range tell which ranges hold the wanted places; only
    those are looked into. So no task has all distinct values, of one key either, and the driver none.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = written(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("_n").alias("_s"))
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row for each range
    ranges = sums.withColumns({"_before": F.sum("_s").over(by.orderBy("_p")) - F.col("_s"), "_all": F.sum("_s").over(by)})
    at = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("share"), F.lit(up).alias("up")) for n, q in shares.items() for up in (False, True)))
    exact = F.col("w.share") * (F.col("_all") - 1)
    wanted = ranges.withColumn("w", F.explode(at)).withColumn("_place", F.when(F.col("w.up"), F.ceil(exact)).otherwise(F.floor(exact)))
    wanted = wanted.where((F.col("_place") >= F.col("_before")) & (F.col("_place") < F.col("_before") + F.col("_s")))
    wanted = written(wanted.select(*keys, "_p", "w.name", "w.up", (F.col("_place") - F.col("_before")).alias("_local"), (exact - F.floor(exact)).alias("_part")))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    same = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*keys, *more)]
    all_of = lambda conditions: functools.reduce(operator.and_, conditions)
    near = dealt.alias("d").join(wanted.select(*keys, "_p").distinct().alias("r"), all_of(same("d", "r", "_p")), "left_semi").withColumn("_upto", upto)
    hit = near.alias("d").join(wanted.alias("w"), all_of([*same("d", "w", "_p"), F.col("_local") >= F.col("_upto") - F.col("_n"), F.col("_local") < F.col("_upto")]))
    hit = hit.select(*(F.col(f"d.{c}").alias(c) for c in keys), "name", "up", "_part", "_v")
    of = lambda n, up: F.max(F.when((F.col("name") == n) & (F.col("up") == up), F.col("_v")))
    part = lambda n: F.max(F.when(F.col("name") == n, F.col("_part")))
    return hit.groupBy(*keys).agg(*((of(n, False) + part(n) * (of(n, True) - of(n, False))).alias(n) for n in shares))


def quantile_bounds(df: DataFrame, column: str, n: int = 5) -> list[float]:
    """Distinct bounds of n bins of equal numbers, by linear interpolation."""
    found = quantiles(df, column, {f"q{i}": i / n for i in range(n + 1)}).first() or ()
    return sorted({float(x) for x in found if x is not None})


def binned(column: Column, bounds: Sequence[float]) -> Column:
    """The number, from 1, of the right-closed bin; the lowest bound is in the first; null outside."""
    out = F.when(column.isNull() | (column < bounds[0]) | (column > bounds[-1]), None)
    for i, b in enumerate(bounds[1:], 1):
        out = out.when(column <= b, i)
    return out
