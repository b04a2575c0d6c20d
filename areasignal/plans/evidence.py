"""Queries on phrases, counts, ratios and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from areasignal.functions import text, vectors
from areasignal.functions.loose_json import extracted
from areasignal.operators import captions, tables
from areasignal.plans.base import ctes, frame, query, table
from areasignal.sources.records import indicator_vector

FIRST = """, firsts AS (
    SELECT unit_id, modality, lower(trim(phrase)) AS k, min(struct_pack(pos := pos, p := trim(phrase))) AS r FROM phrases GROUP BY ALL
)"""


@query(ctes("phrases") + FIRST + " SELECT unit_id, modality, k AS key, r.pos AS pos, r.p AS phrase FROM firsts")
def phrase_dedupe_first(spark, sf_dir):
    rows = frame(spark, sf_dir, "phrases").select("unit_id", "modality", text.phrase_key(F.col("phrase")).alias("key"), "pos", F.trim("phrase").alias("phrase"))
    return tables.keep_first(rows, ["unit_id", "modality", "key"], ["pos"])


SEGMENTS = FIRST + """, lists AS (
    SELECT unit_id, modality, list(r.p ORDER BY r) AS phrases FROM firsts GROUP BY ALL
), segments AS (
    SELECT unit_id, coalesce(max(CASE modality WHEN 'sat' THEN array_to_string(phrases, '; ') END), '[no satellite evidence]') AS sat,
        coalesce(max(CASE modality WHEN 'ntl' THEN array_to_string(phrases, '; ') END), '[no nightlight evidence]') AS ntl,
        coalesce(max(CASE modality WHEN 'sv' THEN array_to_string(phrases[1:60], '; ') END), '[no streetview evidence]') AS sv
    FROM lists GROUP BY unit_id
)"""


def segments(spark, sf_dir):
    lists = tables.first_phrases(frame(spark, sf_dir, "phrases"), ["unit_id", "modality"], "phrase", ["pos"])
    of = lambda m: F.max(F.when(F.col("modality") == m, F.col("phrases")))
    return lists.groupBy("unit_id").agg(*(of(m).alias(m) for m in ("sat", "ntl", "sv"))).select("unit_id", *(text.segment(F.col(m), text.NO_EVIDENCE[m], 60 if m == "sv" else None, distinct=True).alias(m) for m in ("sat", "ntl", "sv")))


@query(ctes("phrases") + SEGMENTS + " SELECT * FROM segments")
def phrase_segments_capped(spark, sf_dir):
    return segments(spark, sf_dir)


@query(
    ctes("phrases") + """, tidied AS (
    SELECT unit_id, pos, trim(regexp_replace(replace(phrase, '_', ' '), '\\s+', ' ', 'g')) AS p FROM phrases
), grp AS (SELECT unit_id, lower(p) AS k, count(*) AS n, min(struct_pack(pos := pos, p := p)).p AS phrase FROM tidied GROUP BY unit_id, lower(p)
), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY n DESC, k) AS place FROM grp)
SELECT unit_id, place::INTEGER AS place, phrase, n FROM r WHERE place <= 4"""
)
def phrase_top_k(spark, sf_dir):
    return tables.top_phrases_by(frame(spark, sf_dir, "phrases"), "unit_id", "phrase", ["pos"], 4)


def _groups_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(p, '(?i)\\b(?:{'|'.join(w)})\\b') THEN '{g}' END" for g, w in text.STREET_GROUPS.items())
    return f"list_filter([{cases}], lambda g: g IS NOT NULL)"


@query(
    ctes("phrases") + f""", g AS (SELECT unit_id, {_groups_sql()} AS gs FROM (SELECT unit_id, replace(phrase, '_', ' ') AS p FROM phrases)
), e AS (SELECT unit_id, unnest(CASE WHEN len(gs) > 0 THEN gs ELSE ['other'] END) AS grp FROM g)
SELECT unit_id, grp, count(*) AS n FROM e GROUP BY ALL"""
)
def phrase_keyword_groups(spark, sf_dir):
    return tables.group_counts(frame(spark, sf_dir, "phrases"), "unit_id", "phrase")


COUNTS = ", counts AS (SELECT unit_id, kind, count(*) AS n FROM poi GROUP BY ALL)"


def _join_sql(lst: str) -> str:
    return f"CASE WHEN len({lst}) = 1 THEN {lst}[1] ELSE array_to_string({lst}[1:-2], ', ') || ', and ' || {lst}[-1] END"


@query(
    ctes("phrases", "poi") + SEGMENTS + COUNTS + f""", sv AS (
    SELECT s.unit_id, u.i, trim(replace(trim(u.p), '_', ' ')) AS p FROM segments AS s, unnest(string_split(s.sv, ';')) WITH ORDINALITY AS u(p, i)
), grouped AS (SELECT unit_id, i, p, unnest(CASE WHEN len(gs) > 0 THEN gs ELSE ['other'] END) AS grp FROM (SELECT *, {_groups_sql()} AS gs FROM sv)
), ranked AS (SELECT unit_id, grp, lower(p) AS k, row_number() OVER (PARTITION BY unit_id, grp ORDER BY count(*) DESC, lower(p)) AS place, min(struct_pack(i := i, p := p)).p AS p FROM grouped GROUP BY unit_id, grp, lower(p)
), dominant AS (SELECT unit_id, k, min(struct_pack(o := list_position({list(text.CAPTION_GROUPS)}, grp), place := place)) AS o FROM ranked WHERE grp <> 'other' AND place <= 2 GROUP BY unit_id, k
), dom AS (SELECT unit_id, list(k ORDER BY o)[1:10] AS l FROM dominant GROUP BY unit_id
), oth AS (SELECT unit_id, list(k ORDER BY place) AS l FROM ranked WHERE grp = 'other' AND place <= 3 GROUP BY unit_id
), img AS (SELECT unit_id, [lower(replace(trim(x), '_', ' ')) FOR x IN string_split(sat, ';')][1:6] AS a, [lower(replace(trim(x), '_', ' ')) FOR x IN string_split(ntl, ';')][1:5] AS b FROM segments
), named AS (SELECT unit_id, list(n || CASE kind WHEN 'shop' THEN ' retail entries' ELSE ' ' || kind || ' entries' END ORDER BY list_position(['shop', 'amenity', 'office', 'tourism'], kind)) AS l FROM counts WHERE kind <> 'error' GROUP BY unit_id)
SELECT s.unit_id, 'Satellite imagery suggests ' || {_join_sql('img.a')} || '. Nighttime light patterns show ' || {_join_sql('img.b')} || '. Across the street-view images, recurring elements include ' || {_join_sql('dom.l')} || '. '
    || CASE WHEN oth.l IS NULL THEN '' ELSE 'Local variation is also visible through ' || {_join_sql('oth.l')} || '. ' END
    || 'The POI summary indicates ' || CASE WHEN named.l IS NULL THEN 'no listed poi entries' ELSE {_join_sql('named.l')} END || '. {text.SENTENCES["end"][0]}' AS caption
FROM segments AS s JOIN img USING (unit_id) JOIN dom USING (unit_id) LEFT JOIN oth USING (unit_id) LEFT JOIN named USING (unit_id)"""
)
def caption_templated(spark, sf_dir):
    counts = tables.count_map(frame(spark, sf_dir, "poi"), "unit_id", "kind")
    rows = segments(spark, sf_dir).join(counts, "unit_id", "left")
    return captions.captioned(rows, "templated").select("unit_id", "caption")


SUMMARY = COUNTS + """, summary AS (SELECT unit_id, sum(n)::BIGINT || ' POIs total: ' || string_agg(kind || ' ×' || n, ', ' ORDER BY n DESC, kind) AS poi_text FROM counts GROUP BY unit_id)"""


@query(ctes("phrases", "poi") + SEGMENTS + SUMMARY + """ SELECT s.unit_id, '[SAT] ' || sat || ' [NTL] ' || ntl || ' [SV] ' || sv || ' [POI] ' || coalesce(poi_text, '(no POI recorded)') AS caption FROM segments AS s LEFT JOIN summary USING (unit_id)""")
def caption_concat(spark, sf_dir):
    counts = tables.count_map(frame(spark, sf_dir, "poi"), "unit_id", "kind").select("unit_id", text.poi_summary(F.col("counts")).alias("poi_text"))
    rows = segments(spark, sf_dir).join(counts, "unit_id", "left")
    return captions.captioned(rows.withColumn("poi_text", F.coalesce("poi_text", F.lit(text.NO_EVIDENCE["poi"]))), "concat").select("unit_id", "caption")


VOCABULARY = ("amenity", "craft", "emergency", "healthcare", "historic", "leisure", "office", "public_transport", "railway", "shop", "sport", "tourism")


@query(ctes("poi") + " SELECT c_custkey AS unit_id, count(kind) AS total, " + ", ".join(f"count(*) FILTER (kind = '{v}') AS {v}" for v in VOCABULARY) + " FROM customer LEFT JOIN poi ON unit_id = c_custkey GROUP BY c_custkey")
def poi_pivot_counts(spark, sf_dir):
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit_id"))
    return tables.type_counts(frame(spark, sf_dir, "poi"), units, "unit_id", "kind", VOCABULARY)


@query(ctes("poi") + SUMMARY + " SELECT * FROM summary")
def poi_summary_text(spark, sf_dir):
    return tables.count_map(frame(spark, sf_dir, "poi"), "unit_id", "kind").select("unit_id", text.poi_summary(F.col("counts")).alias("poi_text"))


@query(ctes("poi") + COUNTS + " SELECT unit_id, kind, n, sum(n) OVER (PARTITION BY unit_id)::BIGINT AS total FROM counts")
def poi_summary_parse(spark, sf_dir):
    rows = poi_summary_text(spark, sf_dir).select("unit_id", text.parsed_counts(F.col("poi_text")).alias("counts"), text.parsed_total(F.col("poi_text")).alias("total"))
    return rows.select("unit_id", F.explode("counts").alias("kind", "n"), "total")


@query(ctes("poi") + " SELECT kind, count(*) AS n FROM poi GROUP BY kind ORDER BY n DESC, kind LIMIT 3")
def poi_vocab_topk(spark, sf_dir):
    return frame(spark, sf_dir, "poi").groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(3)


@query(
    ctes("poi") + COUNTS + """, v AS (SELECT kind FROM counts GROUP BY kind ORDER BY sum(n) DESC, kind LIMIT 2
), k AS (SELECT unit_id, CASE WHEN kind IN (FROM v) THEN kind ELSE 'other' END AS kind, n FROM counts
), u AS (SELECT DISTINCT unit_id FROM counts), c AS (SELECT kind FROM v UNION ALL SELECT 'other'
), raw AS (SELECT u.unit_id, c.kind, ln(1 + coalesce(sum(n), 0)) AS x FROM u CROSS JOIN c LEFT JOIN k ON k.unit_id = u.unit_id AND k.kind = c.kind GROUP BY ALL
), m AS (SELECT kind, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd FROM raw GROUP BY kind)
SELECT unit_id, kind, round((x - mean) / sd, 6) AS z FROM raw JOIN m USING (kind)"""
)
def poi_log1p_zscore(spark, sf_dir):
    counts = frame(spark, sf_dir, "poi").groupBy("unit_id", "kind").agg(F.count("*").alias("n"))
    scaler = tables.CountScaler(2).fit(counts, "unit_id", "kind", "n")
    wide = scaler.transform(counts, "unit_id", "kind", "n")
    return wide.unpivot("unit_id", scaler.columns, "kind", "z").select("unit_id", "kind", F.round("z", 6).alias("z"))


_KIND = "CASE {k} % 9 WHEN 0 THEN 'point_of_interest' WHEN 1 THEN 'cafe' WHEN 2 THEN 'bank' WHEN 3 THEN 'park' WHEN 4 THEN 'zoo' WHEN 5 THEN 'school' WHEN 6 THEN 'establishment' WHEN 7 THEN 'store' ELSE 'police' END"


@query(
    f"""WITH t AS (SELECT c_nationkey AS unit_id, [{_KIND.format(k='c_custkey')}, {_KIND.format(k='(c_custkey * 7 + 3)')}] AS types FROM customer
), m(kind, category) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in text.CATEGORY_OF.items())}),
r AS (SELECT unit_id, coalesce((SELECT category FROM m WHERE kind = types[1]), (SELECT category FROM m WHERE kind = types[2]), 'other') AS category FROM t)
SELECT unit_id, category, count(*) AS n FROM r GROUP BY ALL"""
)
def type_category_first_match(spark, sf_dir):
    types = F.array(F.expr(_KIND.format(k="c_custkey")), F.expr(_KIND.format(k="(c_custkey * 7 + 3)")))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("unit_id"), text.first_known(types, text.CATEGORY_OF).alias("category")).groupBy("unit_id", "category").agg(F.count("*").alias("n"))


RATIOS = """WITH p AS (SELECT vec_id, label, [x::DOUBLE * x * x * x * x * x FOR x IN embedding[1:15]] AS v FROM embeddings
), r AS (SELECT vec_id, label, """ + ", ".join(f"v[{i + 1}] / list_sum(v) AS {c}" for i, c in enumerate(tables.RATIOS)) + """ FROM p
), b AS (SELECT *, (sky < 0.01 AND building > 0.6) OR (road > 0.5 AND sidewalk < 0.01 AND building < 0.1) OR other > 0.8 AS bad FROM r)"""


def image_ratios(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 15), lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(5)), x.cast("double"), lambda a, _: a * x))
    p = table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("v")).withColumn("s", F.aggregate("v", F.lit(0.0), lambda a, x: a + x))
    return p.select("vec_id", "label", *((F.get("v", F.lit(i)) / F.col("s")).alias(c) for i, c in enumerate(tables.RATIOS)))


@query(RATIOS + " SELECT label, count(*) AS n_images, count(*) FILTER (bad) AS n_filtered FROM b GROUP BY label")
def ratio_quality_filter(spark, sf_dir):
    return tables.unit_ratios(image_ratios(spark, sf_dir), "label", columns=()).select("label", "n_images", "n_filtered")


@query(RATIOS + " SELECT label, count(DISTINCT vec_id) AS n_tiles, " + ", ".join(f"round(avg({c}) FILTER (NOT bad), 6) AS {c}_mean, round(stddev_pop({c}) FILTER (NOT bad), 6) AS {c}_std" for c in tables.RATIOS) + " FROM b GROUP BY label")
def ratio_unit_mean_std(spark, sf_dir):
    found = tables.unit_ratios(image_ratios(spark, sf_dir), "label", "vec_id")
    return found.select("label", "n_tiles", *(F.round(f"{c}_{s}", 6).alias(f"{c}_{s}") for c in tables.RATIOS for s in ("mean", "std")))


@query("WITH s AS (SELECT l_suppkey AS image, l_partkey % 150 AS c FROM lineitem) SELECT image, " + ", ".join(f"round(count(*) FILTER (c = {k}) / count(*), 9) AS {v}" for k, v in tables.PIXEL_CLASSES.items()) + f", round(count(*) FILTER (c NOT IN ({', '.join(map(str, tables.PIXEL_CLASSES))})) / count(*), 9) AS other FROM s GROUP BY image")
def class_histogram_ratios(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS image", "l_partkey % 150 AS c")
    return tables.class_ratios(rows, "image", "c").select("image", *(F.round(c, 9).alias(c) for c in tables.RATIOS))


@query("SELECT label, (i - 1)::INTEGER AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) AS r(i) GROUP BY ALL")
def vector_mean_pool(spark, sf_dir):
    return tables.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query("SELECT (vec_id * vec_id % 97 % 25) AS unit_id, (i - 33)::INTEGER AS pos, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(33, 49) AS r(i) GROUP BY ALL")
def ragged_mean_pool(spark, sf_dir):
    """Units have from few to many vectors, as the squares of the ids fall."""
    phrases = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * F.col("vec_id") % 97 % 25).alias("unit_id"), F.slice("embedding", 33, 16).alias("v"))
    return tables.mean_pool(phrases, ["unit_id"], "v").select("unit_id", "pos", F.round("value", 6).alias("value"))


@query("SELECT vec_id, (i - 1)::INTEGER AS pos, round(CASE WHEN i BETWEEN 17 AND 32 THEN 0 ELSE embedding[i]::DOUBLE END, 6) AS value FROM embeddings, range(1, 65) AS r(i)")
def modality_mask(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.masked(F.col("embedding"), 16, ablate=["ntl"])).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("value"))


@query("WITH n AS (SELECT vec_id, embedding, sqrt(list_sum([x::DOUBLE * x FOR x IN embedding])) AS l FROM embeddings) SELECT vec_id, (i - 1)::INTEGER AS pos, round(embedding[i]::DOUBLE / l, 6) AS value FROM n, range(1, 65) AS r(i)")
def l2_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalised(F.col("embedding"))).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("value"))


@query(ctes("units") + ", v AS (SELECT unit_id, fold, CASE WHEN unit_id % 7 = 0 THEN NULL ELSE balance END AS x FROM units), h AS (SELECT unnest(range(5))::INTEGER AS held_out) SELECT held_out, unit_id, round(coalesce(x, (SELECT avg(w.x) FROM v AS w WHERE w.fold <> held_out), 0), 4) AS x FROM v CROSS JOIN h")
def fold_mean_impute(spark, sf_dir):
    rows = frame(spark, sf_dir, "units").select("unit_id", "fold", F.when(F.col("unit_id") % 7 != 0, F.col("balance")).alias("x"))
    return tables.impute_by_fold(rows, "fold", ["x"], range(5)).select("held_out", "unit_id", F.round("x", 4).alias("x"))


@query(ctes("obs") + ", s AS (SELECT DISTINCT target_income AS score FROM obs), l AS (SELECT score, greatest(0.001, least(0.999, (score - 1) / 9)) AS p FROM s) SELECT score, round(ln(p / (1 - p)), 6) AS logit, round(1 + 9 / (1 + exp(-ln(p / (1 - p)))), 6) AS back FROM l")
def logit_targets_roundtrip(spark, sf_dir):
    y = vectors.to_logit(F.col("score"))
    return frame(spark, sf_dir, "obs").select(F.col("target_income").alias("score")).distinct().select("score", F.round(y, 6).alias("logit"), F.round(vectors.from_logit(y), 6).alias("back"))


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def json_extract_repair(spark, sf_dir):
    """Objects within prose, some cut off at the end."""
    raw = F.concat(F.lit("Answer: "), F.when(F.col("event_id") % 3 == 0, F.rtrim("props", F.lit("}"))).otherwise(F.concat("props", F.lit(" done"))))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(extracted(raw), "$.k").cast("bigint").alias("k"))


@query("WITH v AS (SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events) SELECT event_id, CASE WHEN k % 7 <= 4 AND k % 5 <= 4 THEN [(k % 7)::DOUBLE, (k % 5)::DOUBLE] ELSE [0::DOUBLE, 0::DOUBLE] END AS vec, (k % 7 > 4)::INTEGER AS missing FROM v")
def indicator_validity(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    raw = F.to_json(F.struct(F.struct((k % 7).alias("score"), F.lit("c").alias("cue")).alias("a"), F.struct((k % 5).alias("score")).alias("b")))
    vec, missing = indicator_vector(F.col("raw"), ["a", "b"])
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw")).select("event_id", vec.alias("vec"), missing.alias("missing"))


@query(ctes("phrases") + FIRST + """, lists AS (SELECT unit_id, modality, list(r.p ORDER BY r) AS l FROM firsts GROUP BY ALL),
w AS (SELECT unit_id, max(CASE modality WHEN 'sat' THEN l END) AS sat, max(CASE modality WHEN 'ntl' THEN l END) AS ntl, max(CASE modality WHEN 'sv' THEN l END) AS sv FROM lists GROUP BY unit_id)
SELECT unit_id, array_to_string(list_filter([CASE WHEN unit_id % 5 > 0 THEN 'satellite: ' || array_to_string(sat[1:5], '; ') END, 'nightlight: ' || array_to_string(ntl[1:5], '; ')]
    || [CASE WHEN len(sv[1 + i * 2 : 2 + i * 2]) > 0 THEN 'streetview_0' || i || ': ' || array_to_string(sv[1 + i * 2 : 2 + i * 2], '; ') END FOR i IN range(6)]
    || ['(+2 more streetviews omitted)', 'POI: (no POI recorded)', CASE WHEN unit_id % 3 = 0 THEN 'general: quiet; mixed' END], lambda x: x IS NOT NULL), chr(10)) AS block FROM w""")
def prompt_evidence_block(spark, sf_dir):
    lists = tables.first_phrases(frame(spark, sf_dir, "phrases"), ["unit_id", "modality"], "phrase", ["pos"])
    of = lambda m: F.max(F.when(F.col("modality") == m, F.col("phrases")))
    wide = lists.groupBy("unit_id").agg(*(of(m).alias(m) for m in ("sat", "ntl", "sv")))
    street = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.format_string("streetview_%02d", i).alias("key"), F.slice("sv", 1 + i * 2, F.lit(2)).alias("phrases")))
    sat, general = F.when(F.col("unit_id") % 5 > 0, F.slice("sat", 1, 5)), F.when(F.col("unit_id") % 3 == 0, F.array(F.lit("quiet"), F.lit(""), F.lit("mixed")))
    return wide.select("unit_id", text.evidence_block(sat, F.slice("ntl", 1, 5), street, F.array(F.lit(text.NO_EVIDENCE["poi"])), general).alias("block"))
