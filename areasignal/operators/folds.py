"""Folds that keep groups together and strata even, and splits of them."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.functions.geo import hashed_unit
from areasignal.session import written


#: Groups that are dealt one by one, and bundles that all further ones are put into.
GROUPS, BUNDLES = 100_000, 10_000


def group_folds(df: DataFrame, group: str, stratum: str, n: int = 5, most: int = GROUPS, bundles: int = BUNDLES) -> DataFrame:
    """group and fold: every group in one fold, strata as even over folds as greedy assignment makes them.

    Groups go in falling order of their spread over strata to the fold whose strata then differ least; ties go by the size
    and the name of a group, and to the fold that has least. What reaches the driver is a count for each stratum of at most
    `most` groups and `bundles` bundles: of more groups, those of the least spread are put together by hash of their name,
    and each bundle is dealt like a group.
    """
    counted = written(df.groupBy(group, stratum).agg(F.count("*").alias("_n")))
    if counted.select(group).distinct().count() <= most:
        return _dealt(counted, group, stratum, n)
    kinds, each = counted.select(stratum).distinct().count(), F.col("_n").cast("double")
    sizes = counted.groupBy(group).agg(F.round(F.sum(each * each) - F.sum(each) ** 2 / kinds, 6).alias("_spread"), F.sum("_n").alias("_size"))
    alone = sizes.orderBy(F.desc("_spread"), F.desc("_size"), F.col(group).cast("string")).limit(most).select(group, F.lit(True).alias("_alone"))
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64(group), F.lit(bundles)))
    items = written(counted.join(alone, group, "left").withColumn("_item", F.when(F.col("_alone"), F.concat(F.lit("group "), group)).otherwise(bundle)))
    dealt = _dealt(items.groupBy("_item", stratum).agg(F.sum("_n").alias("_n")), "_item", stratum, n)
    return items.select(group, "_item").distinct().join(dealt, "_item").select(group, "fold")


def _dealt(counted: DataFrame, group: str, stratum: str, n: int) -> DataFrame:
    """group and fold by the greedy rule, from _n by group and stratum of a bounded number of groups."""
    counts: dict[object, dict[object, int]] = defaultdict(dict)
    for r in counted.select(group, stratum, "_n").collect():
        counts[r[0]][r[1]] = r[2]
    strata = sorted({s for c in counts.values() for s in c}, key=str)
    total = {s: sum(c.get(s, 0) for c in counts.values()) for s in strata}
    filled = [{s: 0 for s in strata} for _ in range(n)]
    mean = {g: sum(c.values()) / max(1, len(strata)) for g, c in counts.items()}
    spread = {g: round(sum((c.get(s, 0) - mean[g]) ** 2 for s in strata), 6) for g, c in counts.items()}
    out = []
    for g in sorted(counts, key=lambda g: (-spread[g], -sum(counts[g].values()), str(g))):
        def cost(k: int) -> tuple[float, int, int]:
            worse = sum(((filled[k][s] + counts[g].get(s, 0)) ** 2 - filled[k][s] ** 2) / total[s] ** 2 for s in strata if total[s])
            return round(worse, 9), sum(filled[k].values()), k
        k = min(range(n), key=cost)
        for s, c in counts[g].items():
            filled[k][s] += c
        out.append((g, k))
    kind = counted.schema[group].dataType.simpleString()
    return counted.sparkSession.createDataFrame(out, f"`{group}` {kind}, fold int")


def stratified_split(df: DataFrame, unit: str, label: str, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, group: str | None = None) -> DataFrame:
    """df with split: train, val or test, each label dealt by hashed order; train and val get their rounded shares (half to
    even), test the rest.

    With a group, all its rows go the same way: groups are dealt, by the label of their last unit. Rows or groups take their
    place within a label from counts of hash ranges, so no task sorts a whole label.
    """
    if abs(sum(shares) - 1) > 1e-6:
        raise ValueError("shares must add up to 1")
    if group is not None:
        labels = df.groupBy(F.col(group).alias("_g")).agg(F.max_by(label, unit).alias("_l"))
        split = stratified_split(labels, "_g", "_l", shares, seed).select(F.col("_g").alias(group), "split")
        return df.join(split, group).select(*df.columns, "split")
    u = hashed_unit(F.lit(seed), F.col(unit))
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * 1024).cast("int"))
    sums = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    before = sums.withColumn("_before", F.sum("_c").over(Window.partitionBy(label).orderBy("_b")) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(label)))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", unit)) + F.col("_before")
    first = F.bround(F.col("_n") * shares[0])
    second = first + F.bround(F.col("_n") * shares[1])
    out = rows.join(before, [label, "_b"]).withColumn("_i", place)
    return out.withColumn("split", F.when(F.col("_i") <= first, "train").when(F.col("_i") <= second, "val").otherwise("test")).select(*df.columns, "split")


def fold_of(key: Column, n: int = 5) -> Column:
    """A fold from a number."""
    return F.pmod(key, F.lit(n)).cast("int")
