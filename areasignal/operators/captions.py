"""Captions of areas from their segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.functions import text
from areasignal.operators import tables
from areasignal.session import written


def templated(df: DataFrame) -> DataFrame:
    """df (sat, ntl, sv, counts) with caption: sentences on each modality.

    They take the first distinct phrases of the images from above, the most frequent of each group of street phrases, the
    most frequent of the rest, and the counts. Patterns are matched once for each phrase that there is, however many areas
    have it, and phrases ranked by aggregates; what the
    sentences are made of is written before they are, so that nothing is worked out again for each place it stands in.
    """
    rows = written(df.withColumn("_key", F.monotonically_increasing_id()))
    one = rows.select("_key", F.posexplode(F.transform(text.split_segment(F.col("sv")), text.tidy)).alias("_i", "_p")).where("_p <> ''")
    each = written(one.groupBy("_key", F.lower("_p").alias("_k")).agg(F.count("*").alias("_n"), F.min_by("_p", "_i").alias("_p")))
    by = each.join(tables.phrase_groups(each, "_k"), "_k").withColumn("_g", F.explode("_gs"))
    best = by.groupBy("_key", "_g").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "_k", "_p"))), 1, 3), lambda r: r["_p"]).alias("_top"))
    tops = best.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_g", "_top"))).alias("_tops"))
    none = F.array().cast("array<string>")
    top = lambda g: F.coalesce(F.try_element_at("_tops", F.lit(g)), none)
    first = lambda c, n: F.slice(text.distinct_phrases(F.transform(text.split_segment(F.col(c)), text.tidy)), 1, n)
    recurring = F.slice(text.distinct_phrases(F.concat(*(F.slice(top(g), 1, 2) for g in text.CAPTION_GROUPS))), 1, 10)
    said = {"sat": first("sat", 6), "ntl": first("ntl", 5), "sv": recurring, "other": top("other"), "poi": text.poi_phrases(F.col("counts"))}
    out = written(rows.join(tops, "_key", "left").select(*df.columns, *(c.alias(f"_say_{k}") for k, c in said.items())))
    default = lambda k: F.array(F.lit(text.SENTENCES[k][1])) if text.SENTENCES[k][1] else none
    parts = [text.sentence(text.SENTENCES[k][0], F.when(F.size(f"_say_{k}") > 0, F.col(f"_say_{k}")).otherwise(default(k))) for k in said]
    return out.withColumn("caption", F.array_join(F.filter(F.array(*parts, F.lit(text.SENTENCES["end"][0])), lambda p: p != ""), " ")).select(*df.columns, "caption")


def modality_texts(df: DataFrame) -> Column:
    """The four texts apart, markers for missing ones."""
    texts = {"sat": "sat", "ntl": "ntl", "sv": "sv", "poi": "poi_text"}
    return F.struct(*(F.coalesce(F.col(c), F.lit(text.NO_EVIDENCE[k])).alias(k) for k, c in texts.items()))


def captioned(df: DataFrame, mode: str) -> DataFrame:
    """df with caption, by mode: concat, templated or modality (a struct of four texts)."""
    if mode == "concat":
        return df.withColumn("caption", text.tagged(F.col("sat"), F.col("ntl"), F.col("sv"), F.col("poi_text")))
    if mode == "templated":
        return templated(df)
    if mode == "modality":
        return df.withColumn("caption", modality_texts(df))
    raise ValueError(f"unknown caption mode {mode!r}")
