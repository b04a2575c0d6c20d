"""Phrases, summaries and captions by hand."""

import pytest
from pyspark.sql import functions as F

from areasignal.functions import text
from areasignal.functions.loose_json import first_object
from areasignal.operators import captions


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first().r


def test_distinct_phrases_and_segments(spark):
    phrases = [" Old house", "old HOUSE ", "", None, "road", "Road", " "]
    assert one(spark, "p array<string>", (phrases,), text.distinct_phrases(F.col("p"))) == ["Old house", "road"]
    assert one(spark, "p array<string>", (phrases,), text.segment(F.col("p"), "none", 1)) == "Old house"
    assert one(spark, "p array<string>", ([],), text.segment(F.col("p"), "none")) == "none"
    many = [f"p{i}" for i in range(80)]
    assert one(spark, "p array<string>", (many,), text.segment(F.col("p"), "", 60)).count(";") == 59
    assert one(spark, "t string", ("a; b ;; c",), text.split_segment(F.col("t"))) == ["a", "b", "c"]
    for empty in (None, "[no satellite evidence]", ""):
        assert one(spark, "t string", (empty,), text.split_segment(F.col("t"))) == []


@pytest.mark.parametrize(
    ("said", "counts", "total"),
    [("42 POIs total: amenity ×18, shop x9", {"amenity": 18, "shop": 9}, 42), ("(no POI recorded)", {}, 0), ("", {}, 0), (None, {}, 0), ("shop ×1, shop ×3", {"shop": 3}, 3), ("café ×3", {"café": 3}, 3), ("1 POI total: a x1", {"a": 1}, 1)],
)
def test_summaries_are_parsed(spark, said, counts, total):
    assert one(spark, "t string", (said,), text.parsed_counts(F.col("t"))) == counts
    assert one(spark, "t string", (said,), text.parsed_total(F.col("t"))) == total


def test_summary_is_written(spark):
    assert one(spark, "m map<string,bigint>", ({"b": 2, "a": 2, "c": 5, "z": 0},), text.poi_summary(F.col("m"))) == "9 POIs total: c ×5, a ×2, b ×2"
    for empty in ({}, {"a": 0}, None):
        assert one(spark, "m map<string,bigint>", (empty,), text.poi_summary(F.col("m"))) == "(no POI recorded)"


def test_groups_sentences_and_tops(spark):
    assert one(spark, "p string", ("parked CARS by the curb",), text.groups_of(F.col("p"))) == ["sidewalk", "road", "mobility"]
    assert one(spark, "p string", ("oscar",), text.groups_of(F.col("p"))) == ["other"]
    assert one(spark, "p array<string>", (["A", "b", "a", "C"],), text.sentence("X ", F.col("p"))) == "X a, b, and c."
    assert one(spark, "p array<string>", (["A"],), text.sentence("X ", F.col("p"))) == "X a."
    assert one(spark, "p array<string>", ([],), text.sentence("X ", F.col("p"))) == ""
    assert one(spark, "p array<string>", (["b_b", "A", "a", "B b", "c"],), text.top_phrases(F.col("p"), 2)) == ["A", "b b"]
    assert one(spark, "m map<string,bigint>", ({"shop": 2, "odd": 1},), text.poi_phrases(F.col("m"))) == ["2 retail entries"]
    assert one(spark, "m map<string,bigint>", ({"odd": 3},), text.poi_phrases(F.col("m"))) == ["3 total POI entries"]


def test_captions(spark):
    df = spark.createDataFrame([("[no satellite evidence]", "dim", "road; wide road; sky", None, "t")], "sat string, ntl string, sv string, counts map<string,bigint>, poi_text string")
    got = captions.captioned(df, "templated").first().caption
    assert got.startswith("Satellite imagery suggests a mixed urban form with limited explicit cues. Nighttime light patterns show dim. ")
    assert "include road, and wide road. Local variation is also visible through sky. The POI summary indicates no listed poi entries. " in got
    assert captions.captioned(df, "concat").first().caption == "[SAT] [no satellite evidence] [NTL] dim [SV] road; wide road; sky [POI] t"
    assert captions.captioned(df, "modality").first().caption.poi == "t"
    with pytest.raises(ValueError):
        captions.captioned(df, "other")


@pytest.mark.parametrize(
    ("said", "want"),
    [('{"a": 1}', '{"a": 1}'), ('So: {"a": {"b": "}"}} and {"c": 2}', '{"a": {"b": "}"}}'), ('{"a": "x\\"y}"}', '{"a": "x\\"y}"}'), ('x {"a": [1, 2', '{"a": [1, 2]}'), ('{"a": [{"b": "cut', '{"a": [{"b": "cut"}]}'), ("none", None), ("", None), (None, None), ("{]", None)],
)
def test_json_in_prose(said, want):
    assert first_object(said) == want


def test_small_ones(spark):
    assert one(spark, "p string", ("runs/a/oof.jsonl",), text.run_name(F.col("p"))) == "a"
    assert one(spark, "p string", (" nan ",), text.code(F.col("p"))) is None
    assert one(spark, "p string", ("3.9",), text.whole(F.col("p"))) == 3 and one(spark, "p string", ("x",), text.whole(F.col("p"))) is None
    assert one(spark, "p array<string>", (["odd", "cafe"],), text.first_known(F.col("p"), {"cafe": "food"})) == "food"
    assert one(spark, "q int", (None,), text.level(F.col("q"))) == "unknown"
    street = F.array(*(F.struct(F.lit(f"streetview_{i:02d}").alias("key"), F.array(F.lit(f"s{i}"), F.lit("")).alias("phrases")) for i in range(8)))
    block = text.evidence_block(F.array(F.lit("a")), F.array().cast("array<string>"), street, F.array(F.lit("p")), F.array(F.lit("g"), F.lit(None), F.lit("h")))
    assert one(spark, "q int", (1,), block).split("\n") == ["satellite: a", *(f"streetview_{i:02d}: s{i}" for i in range(6)), "(+2 more streetviews omitted)", "POI: p", "general: g; h"]
    assert one(spark, "p string", ("/old/dataset/a/b.png",), text.anchored(F.col("p"), "/new/")) == "/new/dataset/a/b.png"
    assert one(spark, "p string", ("/old/b.png",), text.anchored(F.col("p"), "/new/")) == "/old/b.png"


def test_lists_of_phrases_are_made_once(spark):
    def texts(df, c):
        return df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("split(")

    df = spark.createDataFrame([("b; A ;a;; B;c",), (None,)], "t string")
    parts = F.split("t", ";")
    assert [r.x for r in df.select(text.distinct_phrases(parts).alias("x")).collect()] == [["b", "A", "c"], None]
    assert texts(df, text.distinct_phrases(parts)) == 1 and texts(df, text.sentence("Of ", parts)) == 1
    assert [r.x for r in df.select(text.sentence("Of ", parts).alias("x")).collect()][0] == "Of b, a, and c."


def test_first_phrases_sort_no_rows(spark):
    from areasignal.operators import tables

    rows = spark.createDataFrame([(1, 3, " b "), (1, 2, "B"), (1, 1, "a"), (1, 3, "c"), (2, 1, None), (2, 5, "d"), (2, 5, "D")], "u int, pos long, p string")
    found = tables.first_phrases(rows, ["u"], "p", ["pos"])
    assert {r.u: r.phrases for r in found.collect()} == {1: ["a", "B", "c"], 2: ["D"]}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.split("Aggregate")[-2].endswith("Hash")  # the one on rows


def test_each_distinct_phrase_is_encoded_once(spark):
    from areasignal.operators import encode

    asked = spark.sparkContext.accumulator(0)

    def length(t):
        asked.add(1)
        return [float(len(t)), 1.0]

    rows = spark.createDataFrame([(i, "s", "n", None, "a; bbb; a" if i % 2 else "bbb") for i in range(40)], "u int, sat string, ntl string, poi_text string, sv string")
    found = {r.u: r.embedding for r in encode.by_modality(rows, "u", F.udf(length, "array<double>"), 2).collect()}
    assert found[1][4:6] == [pytest.approx(5 / 3), 1.0] and found[2][4:6] == [3.0, 1.0]
    assert asked.value <= 40 * 3 + 2  # three texts of each unit, and two phrases


def test_hashed_places_and_signs(spark):
    import hashlib

    from areasignal.operators import encode

    want = [0.0] * 8
    for g in ("a", "b", "a", "a b", "b a"):
        h = int(hashlib.md5(f"42_{g}".encode()).hexdigest()[:8], 16)
        want[h // 2 % 8] += 1 if h % 2 else -1
    n = sum(v * v for v in want) ** 0.5
    got = spark.range(1).select(encode.hashed(8)(F.lit("A, b a")).alias("v"), encode.hashed(8)(F.lit(None).cast("string")).alias("none")).first()
    assert got.v == pytest.approx([v / n for v in want]) and got.none == [0.0] * 8
