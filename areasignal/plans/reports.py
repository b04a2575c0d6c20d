"""Queries behind figures, and queries of whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from areasignal.config import RunConfig
from areasignal.functions import geo
from areasignal.operators import crossval, encode, metrics, perceive, replicates, resample, spatial, tables
from areasignal.plans.areas import EDGES, UNIT_VALUES, edges, polygons, unit_values
from areasignal.plans.base import DOMAINS, ctes, frame, query, table
from areasignal.plans.evidence import SEGMENTS, segments
from areasignal.plans.scores import BANDS, LISA, LONG, OOF, REPORT_TIMES, X, Y, cross_domain_corr, draws, features, long, oof, rho, rounded, significant
from areasignal.session import written


@query(ctes("obs") + BANDS + " SELECT domain, band, count(*) AS n, round(quantile_cont(p - y, 0.25), 6) AS q1, round(quantile_cont(p - y, 0.5), 6) AS median, round(quantile_cont(p - y, 0.75), 6) AS q3 FROM banded GROUP BY domain, band")
def error_by_band(spark, sf_dir):
    rows = oof(spark, sf_dir)
    banded = metrics.unpivoted(rows.withColumn("band", tables.binned(F.col("target_income"), tables.quantile_bounds(rows, "target_income"))), ["unit_id", "band"], DOMAINS)
    e = F.col("p") - F.col("y")
    errors = written(banded.select("domain", "band", e.alias("e")))
    quartiles = tables.quantiles(errors, "e", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["domain", "band"])
    return rounded(errors.groupBy("domain", "band").agg(F.count("*").alias("n")).join(quartiles, ["domain", "band"]), "q1", "median", "q3")


#: Every pair of a prediction's and a target's, and of two targets.
SQUARE = OOF + ", crossed AS (" + " UNION ALL ".join(f"SELECT '{kind}/{a}/{b}' AS pair, {kind}_{a} AS y, target_{b} AS p FROM oof" for kind in ("pred", "target") for a in DOMAINS for b in DOMAINS) + ")" + rho("pair", "crossed")


@query(ctes("obs") + SQUARE + ", s AS (SELECT string_split(pair, '/') AS s, round(rho, 6) AS rho FROM rho) SELECT s[2] AS domain, round(max(CASE WHEN s[1] = 'pred' AND s[2] = s[3] THEN rho END), 5) AS own, round(avg(CASE WHEN s[1] = 'target' AND s[2] <> s[3] THEN rho END), 5) AS others FROM s GROUP BY s[2]")
def own_and_other_domains(spark, sf_dir):
    """How a domain's prediction goes with its own target, and how its target goes with the other ones on the whole."""
    c = cross_domain_corr(spark, sf_dir)
    own = c.where("pred = target").select(F.col("pred").alias("domain"), F.col("rho").alias("own"))
    rows = oof(spark, sf_dir)
    names = [f"target_{d}" for d in DOMAINS]
    between = metrics.cross_correlation(rows, rows, "unit_id", names, names).where("left <> right")
    others = between.groupBy(F.substring("left", 8, 99).alias("domain")).agg(F.avg(F.round("rho", 6)).alias("others"))
    return rounded(own.join(others, "domain"), "own", "others", digits=5)


@query(ctes("units") + LISA + ", q AS (SELECT CASE WHEN p_sim < 0.05 THEN quadrant ELSE 0 END AS cluster FROM lisa) SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM q), 6) AS share FROM q GROUP BY cluster")
def lisa_cluster_counts(spark, sf_dir):
    """Units of each cluster and their share of all; cluster 0 are those that aren't significant."""
    q = written(significant(spark, sf_dir))
    n = q.groupBy("cluster").agg(F.count("*").alias("n"))
    return rounded(n.crossJoin(F.broadcast(q.agg(F.count("*").alias("all")))).select("cluster", "n", (F.col("n") / F.col("all")).alias("share")), "share")  # one row


def _report_sql() -> str:
    """Scores of the rows as they are (b = -1) and of each resample, by domain; QWK over the labels seen in each."""
    clip = lambda c: f"greatest(1, least(10, round_even({c}, 0)))::INTEGER"
    of = {"rmse": "rmse", "mae": "mae", "accuracy": "acc", "within_one": "w1", "pearson": "pearson", "rho": "rho", "r2": "r2", "qwk": "qwk"}
    cells = ", ".join(f"round(any_value(s.{v}) FILTER (b = -1), 4) AS {k}, round(quantile_cont(s.{v}, 0.025) FILTER (b >= 0), 4) AS {k}_lo, round(quantile_cont(s.{v}, 0.975) FILTER (b >= 0), 4) AS {k}_hi" for k, v in of.items())
    mean = ", ".join(f"round(avg(s.{v}), 4), NULL, NULL" for v in of.values())
    return ctes("obs") + LONG + draws(REPORT_TIMES) + f""", x AS (SELECT domain || '/' || b AS db, y, p FROM (SELECT b, unit_id FROM drawn UNION ALL SELECT -1, unit_id FROM oof) JOIN long USING (unit_id)){rho("db", "x")},
l AS (SELECT db, y, p, {clip("y")} AS t, {clip("p")} AS q FROM x), labels AS (SELECT db, t AS label FROM l UNION SELECT db, q FROM l), place AS (SELECT db, label, dense_rank() OVER (PARTITION BY db ORDER BY label) AS i FROM labels),
j AS (SELECT l.db, y, p, t, q, a.i AS a, b.i AS b FROM l JOIN place AS a ON a.db = l.db AND a.label = t JOIN place AS b ON b.db = l.db AND b.label = q),
k AS (SELECT db, avg(CASE WHEN t = q THEN 1.0 ELSE 0 END) AS acc, avg(CASE WHEN abs(y - p) <= 1 THEN 1.0 ELSE 0 END) AS w1, coalesce(1 - avg((a - b) ** 2) / nullif(avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b), 0), 0) AS qwk FROM j GROUP BY db),
s AS (SELECT string_split(db, '/')[1] AS domain, string_split(db, '/')[2]::INTEGER AS b, * FROM rho JOIN k USING (db))
SELECT domain, 'model' AS source, any_value(n) FILTER (b = -1) AS n, {cells} FROM s GROUP BY domain UNION ALL SELECT 'macro', 'model', sum(n)::BIGINT, {mean} FROM s WHERE b = -1"""


@query(_report_sql())
def domain_report_full(spark, sf_dir):
    """Eight scores by domain with intervals over 500 resamples, and their means."""
    found = resample.report(long(spark, sf_dir), "unit_id", REPORT_TIMES)
    return rounded(found, *found.columns[3:], digits=4)


@query(ctes("obs") + LONG + draws(REPORT_TIMES) + ", x AS (SELECT b, domain, y, p FROM drawn JOIN long USING (unit_id)), e AS (SELECT b, domain, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae FROM x GROUP BY b, domain), s AS (SELECT domain, 1.96 * stddev_pop(rmse) AS r, 1.96 * stddev_pop(mae) AS m FROM e GROUP BY domain) SELECT domain, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(any_value(r), 6) AS rmse_bar, round(any_value(m), 6) AS mae_bar FROM long JOIN s USING (domain) GROUP BY domain")
def rmse_bars(spark, sf_dir):
    return rounded(resample.bars(long(spark, sf_dir), "unit_id", REPORT_TIMES), "rmse", "mae", "rmse_bar", "mae_bar")


@query(ctes("obs") + LONG + draws(REPORT_TIMES) + ", x AS (SELECT domain || '/' || b AS db, y, p FROM drawn JOIN long USING (unit_id))" + rho("db", "x") + " SELECT string_split(db, '/')[1] AS domain, round(quantile_cont(r2, 0.025), 6) AS r2_lo, round(quantile_cont(r2, 0.975), 6) AS r2_hi, round(quantile_cont(mae, 0.025), 6) AS mae_lo, round(quantile_cont(mae, 0.975), 6) AS mae_hi FROM rho GROUP BY 1")
def domain_report_ci(spark, sf_dir):
    rows = written(long(spark, sf_dir))
    by = replicates.scores(resample.weighted(rows, rows, "unit_id", REPORT_TIMES), REPORT_TIMES, ["domain"], ranks=False)
    found = resample.interval(by, ["r2", "mae"], ["domain"])
    return rounded(found, "r2_lo", "r2_hi", "mae_lo", "mae_hi")


@query(ctes("units") + EDGES + ", d AS (SELECT u.unit_id, count(dst) AS degree FROM units AS u LEFT JOIN edges ON src = u.unit_id GROUP BY u.unit_id) SELECT degree, count(*) AS n FROM d GROUP BY degree")
def neighbour_count_histogram(spark, sf_dir):
    lists = spatial.neighbour_lists(frame(spark, sf_dir, "units"), "unit_id", edges(spark, sf_dir))
    return lists.groupBy(F.size("neighbours").cast("bigint").alias("degree")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (o_totalprice IS NOT NULL) AS priced, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def value_summary(spark, sf_dir):
    v = F.col("o_totalprice")
    return rounded(table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.count_if(v.isNotNull()).alias("priced"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("most")), "mean", "median", digits=4)


@query(
    """WITH RECURSIVE u AS (SELECT s_suppkey AS unit_id, (s_suppkey % 10)::DOUBLE AS x, ((s_suppkey - s_suppkey % 10) / 10)::DOUBLE AS y, CASE WHEN s_suppkey % 8 >= 6 THEN -1 WHEN s_suppkey % 8 >= 3.5 THEN 8 ELSE 0 END AS most FROM supplier),
c AS (SELECT unit_id, most, x + i * 0.125::DOUBLE + 0.125 AS cx, y + j * 0.125::DOUBLE + 0.125 AS cy, sqrt((i * 0.125 + 0.125 - 0.5) ** 2 + (j * 0.125 + 0.125 - 0.5) ** 2) AS far FROM u, range(7) AS a(i), range(7) AS b(j) WHERE most <> 0
    AND (unit_id % 11 <> 0 OR NOT (i * 0.125 + 0.125 BETWEEN 0.25 AND 0.75 AND j * 0.125 + 0.125 BETWEEN 0.25 AND 0.75))),
e AS (SELECT x + 0.25 AS ex, y + 0.25 AS ey FROM u WHERE unit_id % 5 = 0),
o AS (SELECT *, row_number() OVER (ORDER BY unit_id, far, cy, cx) AS i FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE abs(cx - ex) <= 0.25 AND abs(cy - ey) <= 0.25)),
f AS (SELECT 0::BIGINT AS i, []::STRUCT(u BIGINT, x DOUBLE, y DOUBLE)[] AS taken UNION ALL
    SELECT o.i, CASE WHEN (most < 0 OR len(list_filter(taken, lambda t: t.u = o.unit_id)) < most) AND len(list_filter(taken, lambda t: abs(t.x - cx) <= 0.25 AND abs(t.y - cy) <= 0.25)) = 0 THEN list_append(taken, {'u': o.unit_id, 'x': cx, 'y': cy}) ELSE taken END FROM f JOIN o ON o.i = f.i + 1),
t AS (SELECT unnest(taken) AS t, unnest(range(len(taken))) AS n FROM (SELECT max_by(taken, i) AS taken FROM f))
SELECT t.u AS unit_id, row_number() OVER (PARTITION BY t.u ORDER BY n)::INTEGER AS place, t.x AS x, t.y AS y FROM t"""
)
def extra_tiles(spark, sf_dir):
    """Half-size boxes in each area, none on another; areas that hold an existing box keep clear of it."""
    areas = polygons(spark, sf_dir).select("unit_id", "ord", "rings", (F.col("x") + 0.5).alias("cx"), (F.col("y") + 0.5).alias("cy"), geo.tier(F.col("unit_id") % 8).alias("most"))
    there = frame(spark, sf_dir, "units").where("unit_id % 5 = 0").select((F.col("x") + 0.25).alias("x"), (F.col("y") + 0.25).alias("y"))
    return spatial.placed_boxes(areas.where("most <> 0"), "unit_id", there, 0.25)


@query(
    ctes("units") + """, d AS (SELECT unit_id, u.x AS ux, u.y AS uy, i, u.x + ('0x' || substr(md5(unit_id || '_' || i || '_x'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x, u.y + ('0x' || substr(md5(unit_id || '_' || i || '_y'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS y FROM units AS u, range(1, 161) AS r(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY i) - 1 AS place FROM d WHERE unit_id % 11 <> 0 OR NOT (x BETWEEN ux + 0.25 AND ux + 0.75 AND y BETWEEN uy + 0.25 AND uy + 0.75))
SELECT unit_id, place::INTEGER AS place, round(x, 9) AS x, round(y, 9) AS y FROM f WHERE place < 5"""
)
def random_points_in_areas(spark, sf_dir):
    return rounded(geo.random_points(polygons(spark, sf_dir), "unit_id", "rings", 5), "x", "y", digits=9)


@query(
    ctes("phrases") + SEGMENTS + r""", texts AS (
    SELECT unit_id, 0 AS block, 0 AS k, sat AS t FROM segments UNION ALL SELECT unit_id, 1, 0, ntl FROM segments UNION ALL SELECT unit_id, 3, 0, '(no POI recorded)' FROM segments
    UNION ALL SELECT unit_id, 2, k, list_filter(list_transform(string_split(sv, ';'), lambda p: trim(p)), lambda p: p <> '')[k] FROM segments, range(1, 61) AS r(k) WHERE k <= len(string_split(sv, ';'))
), words AS (SELECT unit_id, block, k, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM texts),
grams AS (SELECT unit_id, block, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words),
codes AS (SELECT unit_id, block, k, ('0x' || substr(md5('42_' || g), 1, 8))::BIGINT AS h FROM grams),
places AS (SELECT unit_id, block, k, (h // 2) % 16 AS place, sum(CASE WHEN h % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END) AS v FROM codes GROUP BY ALL),
lengths AS (SELECT unit_id, block, k, sqrt(sum(v * v)) AS n FROM places GROUP BY ALL), counts AS (SELECT unit_id, block, count(*) AS c FROM texts GROUP BY ALL),
sums AS (SELECT unit_id, block, place, sum(CASE WHEN n > 0 THEN v / n ELSE 0 END) AS s FROM places JOIN lengths USING (unit_id, block, k) GROUP BY ALL)
SELECT unit_id, list(round(coalesce(s, 0) / c, 8) + 0.0 ORDER BY block, place) AS embedding FROM counts CROSS JOIN range(16) AS r(place) LEFT JOIN sums USING (unit_id, block, place) GROUP BY unit_id"""
)
def modality_embeddings(spark, sf_dir):
    rows = segments(spark, sf_dir).withColumn("poi_text", F.lit(None).cast("string"))
    made = encode.by_modality(rows, "unit_id", encode.encoder("hashed", width=16), 16)
    return made.select("unit_id", F.transform("embedding", lambda x: F.round(x, 8) + 0.0).alias("embedding"))


@query(
    "WITH p AS (SELECT label || '_' || lpad(vec_id::VARCHAR, greatest(4, length(vec_id::VARCHAR))::INTEGER, '0') || '.png' AS image FROM embeddings), c AS (SELECT image, floor(('0x' || substr(md5(image || '_' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE * "
    + str(len(tables.PIXEL_CLASSES) + 1) + ")::INTEGER AS k FROM p, range(1, 65) AS r(i)) SELECT image, " + ", ".join(f"round(count(*) FILTER (k = {i}) / 64, 9) AS {c}" for i, c in enumerate([*tables.PIXEL_CLASSES.values(), "other"])) + " FROM c GROUP BY image"
)
def segmented_images(spark, sf_dir):
    """Class shares of images by the stand-in segmenter."""
    paths = table(spark, sf_dir, "embeddings").select(F.format_string("%s_%04d.png", F.col("label"), F.col("vec_id")).alias("image"))
    found = tables.class_ratios(paths.select("image", F.explode(perceive.stand_in_classes()(F.col("image"))).alias("channel")), "image", "channel")
    return rounded(found.select("image", *tables.RATIOS), *tables.RATIOS, digits=9)


def run_tables(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("embedding", encode.hashed(16)(F.concat_ws(" ", F.col("group_id").cast("string"), F.round("x0").cast("string"), F.round("x1", -2).cast("string"))))
    return rows, {"poi": X, "coordinates": ["x", "y"]}


@query(
    ctes("units") + EDGES + UNIT_VALUES + """, lag AS (SELECT src AS unit_id, avg(quantity) AS q, avg(discount) AS d FROM edges JOIN vals ON vals.unit_id = dst GROUP BY src),
w AS (SELECT unit_id, fold, quantity + discount AS poi, quantity - coalesce(q, quantity) + discount - coalesce(d, discount) AS gap, (x + y)::DOUBLE AS place, CASE WHEN unit_id % 7 > 0 THEN balance END AS b FROM units JOIN vals USING (unit_id) LEFT JOIN lag USING (unit_id)),
m AS (SELECT f AS fold, avg(b) AS other FROM w, range(5) AS r(f) WHERE fold <> f GROUP BY f)
SELECT unit_id, unnest(['poi', 'ego_gap', 'coordinates', 'ratios']) AS block, unnest([0, 2, 4, 6]) AS first, unnest([2, 4, 6, 7]) AS past, unnest([round(poi, 6), round(gap, 6), round(place, 6), round(coalesce(b, other, 0), 6)]) + 0.0 AS total FROM w LEFT JOIN m USING (fold)"""
)
def feature_layout(spark, sf_dir):
    """The features that a run's settings put together: where each block starts and ends, and what it adds up to for a unit."""
    units = frame(spark, sf_dir, "units").select("unit_id", F.col("fold").cast("int").alias("fold"), "x", "y", F.when(F.col("unit_id") % 7 > 0, F.col("balance")).alias("balance_mean"))
    rows = units.join(unit_values(spark, sf_dir), "unit_id")
    config = RunConfig.of({"use_target_lag": False, "use_coordinates": True, "ratio_columns": ["mean"]})
    made, columns, slices = crossval.assembled(config, rows, "unit_id", [], written(edges(spark, sf_dir)), {"poi": ["quantity", "discount"], "coordinates": ["x", "y"]})
    parts = [F.struct(F.lit(n).alias("block"), F.lit(a).alias("first"), F.lit(b).alias("past"), (F.round(sum((F.col(c).cast("double") for c in columns[a:b]), F.lit(0.0)), 6) + 0.0).alias("total")) for n, a, b in slices]
    return made.select("unit_id", F.explode(F.array(*parts)).alias("p")).select("unit_id", "p.*")


@query()
def run_from_settings(spark, sf_dir):
    """Summaries of a run that its settings describe: embedding of four blocks, one ablated, lags, ridge in log odds."""
    rows, blocks = run_tables(spark, sf_dir)
    config = RunConfig.of({"name": "no_ntl", "ablate": ["ntl"], "use_coordinates": True, "logit_target": True})
    made = written(crossval.run(config, rows, "unit_id", Y, written(edges(spark, sf_dir)), blocks, ("embedding", 4)))
    return crossval.summary(made, rows, "unit_id", Y)


@query()
def ablation_table(spark, sf_dir):
    """Three runs and their differences from the first."""
    rows, blocks = run_tables(spark, sf_dir)
    rows, near = written(rows), written(edges(spark, sf_dir))
    settings = {"base": {}, "no_lag": {"use_target_lag": False}, "no_space": {"use_target_lag": False, "use_ego_gap": False}}
    made = {n: crossval.run(RunConfig.of({"name": n, "use_embedding": False}, s), rows, "unit_id", Y, near, blocks) for n, s in settings.items()}
    return crossval.compared(made, rows, "unit_id", Y)
