"""Queries on predictions: ranks, scores, resamples, folds, fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from areasignal.functions import vectors
from areasignal.operators import boosting, folds, learn, metrics, resample, spatial, tables
from areasignal.plans.areas import EDGES, UNIT_VALUES, edges, unit_values
from areasignal.plans.base import DOMAINS, ctes, frame, query, table
from areasignal.session import written

OOF = """, oof AS (SELECT unit_id, max(fold) AS fold, count(*) AS n_rows, """ + ", ".join(f"avg({s}_{d}) AS {s}_{d}" for s in ("target", "pred") for d in DOMAINS) + """ FROM obs GROUP BY unit_id)"""
LONG = OOF + ", long AS (" + " UNION ALL ".join(f"SELECT unit_id, '{d}' AS domain, target_{d} AS y, pred_{d} AS p FROM oof" for d in DOMAINS) + ")"


def rho(by: str, source: str, name: str = "rho") -> str:
    """A common table of Spearman's rho, n and other scores of y and p by some columns."""
    part = f"PARTITION BY {by} " if by else ""
    sel = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    same = f", {by}" if by else ""
    return f""", {name}_r AS (SELECT *, rank() OVER ({part}ORDER BY y) + (count(*) OVER (PARTITION BY y{same}) - 1) / 2.0 AS ry, rank() OVER ({part}ORDER BY p) + (count(*) OVER (PARTITION BY p{same}) - 1) / 2.0 AS rp FROM {source}),
{name} AS (SELECT {sel}count(*) AS n, CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rp) > 0 THEN corr(ry, rp) END AS rho, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) END AS r2, CASE WHEN stddev_pop(y) > 0 AND stddev_pop(p) > 0 THEN corr(y, p) END AS pearson, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse FROM {name}_r{group})"""


def oof(spark, sf_dir):
    """Duplicate rows of a unit as one, by their means."""
    rows = frame(spark, sf_dir, "obs")
    return rows.groupBy("unit_id").agg(F.max("fold").alias("fold"), F.count("*").alias("n_rows"), *(F.avg(f"{s}_{d}").alias(f"{s}_{d}") for s in ("target", "pred") for d in DOMAINS))


def long(spark, sf_dir):
    return metrics.unpivoted(oof(spark, sf_dir), ["unit_id"], DOMAINS)


def rounded(df, *names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else c for c in df.columns))


@query(ctes("obs") + OOF + " SELECT unit_id, fold, n_rows, " + ", ".join(f"round({s}_{d}, 6) AS {s}_{d}" for s in ("target", "pred") for d in DOMAINS) + ", round((pred_income + pred_health + pred_crime) / 3, 6) AS pred_overall FROM oof")
def oof_aggregate(spark, sf_dir):
    rows = oof(spark, sf_dir).withColumn("pred_overall", sum((F.col(f"pred_{d}") for d in DOMAINS), F.lit(0.0)) / len(DOMAINS))
    return rounded(rows, *(c for c in rows.columns if c.startswith(("target_", "pred_"))))


@query(ctes("obs") + LONG + rho("domain", "long") + " SELECT domain, n, round(rho, 6) AS rho FROM rho")
def spearman_per_domain(spark, sf_dir):
    return rounded(metrics.spearman(long(spark, sf_dir), "y", "p", ["domain"]), "rho")


@query(ctes("obs") + LONG + rho("", "long") + " SELECT n, round(rho, 6) AS pooled_rho, round(r2, 6) AS pooled_r2 FROM rho")
def pooled_spearman_r2(spark, sf_dir):
    return rounded(metrics.pooled(long(spark, sf_dir)), "pooled_rho", "pooled_r2")


@query(ctes("obs") + LONG + rho("domain", "long") + " SELECT round(avg(rho), 6) AS macro_rho, round(avg(r2), 6) AS macro_r2 FROM rho")
def macro_metrics(spark, sf_dir):
    return rounded(metrics.macro(long(spark, sf_dir)), "macro_rho", "macro_r2")


@query(
    "WITH pairs AS (SELECT l_orderkey AS id, l_quantity AS y, l_tax * 100 AS p FROM lineitem WHERE l_linenumber > 1)" + rho("id", "pairs")
    + " SELECT id, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) < 2 THEN 0 ELSE rho END, 6) AS rho, round(coalesce(mae, 0), 6) AS mae, round(coalesce(rmse, 0), 6) AS rmse FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) LEFT JOIN rho USING (id)"
)
def scores_of_few_pairs(spark, sf_dir):
    """Scores within each order, of which the first lines have no prediction: 0 where there are too few pairs."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("y"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") * 100).alias("p"))
    return rounded(metrics.scores(rows, "y", "p", ["id"], few=0.0).select("id", "n", "rho", "mae", "rmse"), "rho", "mae", "rmse")


@query(ctes("obs") + LONG + rho("domain", "long") + " SELECT domain, n, round(rho, 6) AS rho, round(r2, 6) AS r2, round(pearson, 6) AS pearson, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM rho")
def regression_report(spark, sf_dir):
    return rounded(metrics.scores(long(spark, sf_dir), "y", "p", ["domain"]), "rho", "r2", "pearson", "mae", "rmse")


_T, _Q = "1 + o_orderkey % 5", "1 + (o_orderkey % 5 + o_custkey % 3) % 5"
LABELS = f"WITH l AS (SELECT o_orderstatus AS s, {_T} AS t, {_Q} AS q FROM orders)"


def labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS s", f"{_T} AS t", f"{_Q} AS q")


@query(
    LABELS + """, c AS (SELECT s, t, q, count(*) AS n FROM l GROUP BY ALL), k AS (SELECT s, t AS label FROM c UNION SELECT s, q FROM c),
b AS (SELECT s, label, (SELECT coalesce(sum(n), 0) FROM c WHERE c.s = k.s AND t = label) AS nt, (SELECT coalesce(sum(n), 0) FROM c WHERE c.s = k.s AND q = label) AS nq, (SELECT coalesce(sum(n), 0) FROM c WHERE c.s = k.s AND t = label AND q = label) AS hit FROM k)
SELECT s, round(sum(hit) / sum(nt), 6) AS accuracy, round(avg(CASE WHEN nt > 0 THEN hit / nt END), 6) AS balanced_accuracy, round(avg(2 * hit / (nt + nq)), 6) AS macro_f1 FROM b GROUP BY s"""
)
def classification_report(spark, sf_dir):
    return rounded(metrics.classification(labels(spark, sf_dir), "t", "q", ["s"]), "accuracy", "balanced_accuracy", "macro_f1")


@query(LABELS + " SELECT s, round(1 - avg((t - q) ** 2) / (avg(t * t) + avg(q * q) - 2 * avg(t) * avg(q)), 6) AS qwk FROM l GROUP BY s")
def qwk_fixed(spark, sf_dir):
    return rounded(metrics.kappa(labels(spark, sf_dir), "t", "q", ["s"]), "qwk")


@query(
    LABELS + """, m AS (SELECT s, t * t AS t, q * 3 AS q FROM l), k AS (SELECT s, t AS label FROM m UNION SELECT s, q FROM m), i AS (SELECT s, label, dense_rank() OVER (PARTITION BY s ORDER BY label) AS i FROM k),
j AS (SELECT m.s, a.i AS a, b.i AS b FROM m JOIN i AS a ON a.s = m.s AND a.label = t JOIN i AS b ON b.s = m.s AND b.label = q)
SELECT s, round(1 - avg((a - b) ** 2) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) AS qwk FROM j GROUP BY s"""
)
def qwk_label_union(spark, sf_dir):
    rows = labels(spark, sf_dir).select("s", (F.col("t") * F.col("t")).alias("t"), (F.col("q") * 3).alias("q"))
    return rounded(metrics.kappa_of_labels(rows, "t", "q", ["s"]), "qwk")


@query(ctes("obs") + " SELECT fold, round(avg(CASE WHEN greatest(1, least(10, round_even(target_income, 0))) = greatest(1, least(10, round_even(pred_income, 0))) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN abs(target_income - pred_income) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one FROM obs GROUP BY fold")
def accuracy_within1(spark, sf_dir):
    return rounded(metrics.within_one(frame(spark, sf_dir, "obs"), "target_income", "pred_income", ["fold"]), "accuracy", "within_one")


BANDS = LONG + ", q AS (SELECT quantile_cont(target_income, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM oof), banded AS (SELECT l.*, CASE WHEN o.target_income <= b[2] THEN 1 WHEN o.target_income <= b[3] THEN 2 WHEN o.target_income <= b[4] THEN 3 WHEN o.target_income <= b[5] THEN 4 ELSE 5 END AS band FROM long AS l JOIN oof AS o USING (unit_id) CROSS JOIN q)"


@query(ctes("obs") + BANDS + rho("domain, band", "banded") + " SELECT domain, band, n, round(rho, 6) AS rho, round(r2, 6) AS r2, round(pearson, 6) AS pearson, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM rho")
def metrics_by_band(spark, sf_dir):
    rows = oof(spark, sf_dir)
    bounds = tables.quantile_bounds(rows, "target_income")
    banded = metrics.unpivoted(rows.withColumn("band", tables.binned(F.col("target_income"), bounds)), ["unit_id", "band"], DOMAINS)
    return rounded(metrics.scores(banded, "y", "p", ["domain", "band"]), "rho", "r2", "pearson", "mae", "rmse")


@query(ctes("obs") + LONG + ", m AS (SELECT domain, avg(y) AS p FROM long GROUP BY domain) SELECT domain, count(*) AS n, round(avg(abs(y - m.p)), 6) AS mae, round(sqrt(avg((y - m.p) ** 2)), 6) AS rmse, NULL::DOUBLE AS pearson FROM long JOIN m USING (domain) GROUP BY domain")
def mean_baseline(spark, sf_dir):
    rows = long(spark, sf_dir)
    same = rows.groupBy("domain").agg(F.avg("y").alias("p"))
    found = metrics.scores(rows.drop("p").join(F.broadcast(same), "domain"), "y", "p", ["domain"])
    return rounded(found.select("domain", "n", "mae", "rmse", "pearson"), "mae", "rmse", "pearson")


@query(ctes("units") + EDGES + UNIT_VALUES + ", base AS (SELECT src AS unit_id, avg(quantity) AS p FROM edges JOIN vals ON unit_id = dst GROUP BY src), x AS (SELECT quantity AS y, p FROM vals JOIN base USING (unit_id))" + rho("", "x") + " SELECT n, round(rho, 6) AS rho, round(r2, 6) AS r2, round(mae, 6) AS mae FROM rho")
def spatial_lag_baseline(spark, sf_dir):
    v = unit_values(spark, sf_dir)
    lag = edges(spark, sf_dir).join(v.select(F.col("unit_id").alias("dst"), F.col("quantity").alias("p")), "dst").groupBy(F.col("src").alias("unit_id")).agg(F.avg("p").alias("p"))
    found = metrics.scores(v.join(lag, "unit_id"), "quantity", "p")
    return rounded(found.select("n", "rho", "r2", "mae"), "rho", "r2", "mae")


RUNS = LONG + ", runs AS (SELECT r AS run, unit_id, domain, y, p + r * (unit_id % 4) / 4.0 AS p FROM long, range(3) AS t(r))"


def runs(spark, sf_dir):
    return long(spark, sf_dir).withColumn("run", F.explode(F.array(*(F.lit(r).cast("bigint") for r in range(3))))).withColumn("p", F.col("p") + F.col("run") * (F.col("unit_id") % 4) / 4.0)


@query(ctes("obs") + RUNS + rho("run", "runs") + " SELECT run, round(rho, 6) AS pooled_rho, round(r2, 6) AS pooled_r2, round(rho - first_value(rho) OVER (ORDER BY run), 6) AS delta_rho, round(r2 - first_value(r2) OVER (ORDER BY run), 6) AS delta_r2 FROM rho")
def run_comparison_deltas(spark, sf_dir):
    found = metrics.deltas(metrics.pooled(runs(spark, sf_dir), ["run"]), "run", "run", ["pooled_rho", "pooled_r2"]).drop("n")
    return rounded(found.withColumnsRenamed({"delta_pooled_rho": "delta_rho", "delta_pooled_r2": "delta_r2"}), "pooled_rho", "pooled_r2", "delta_rho", "delta_r2")


CROSS = OOF + ", crossed AS (" + " UNION ALL ".join(f"SELECT '{a}' || '/' || '{b}' AS pair, pred_{a} AS y, target_{b} AS p FROM oof" for a in DOMAINS for b in DOMAINS) + ")" + rho("pair", "crossed")


@query(ctes("obs") + CROSS + " SELECT string_split(pair, '/')[1] AS pred, string_split(pair, '/')[2] AS target, n, round(rho, 6) AS rho FROM rho")
def cross_domain_corr(spark, sf_dir):
    rows = oof(spark, sf_dir)
    found = metrics.cross_correlation(rows, rows, "unit_id", [f"pred_{d}" for d in DOMAINS], [f"target_{d}" for d in DOMAINS])
    return rounded(found.select(F.substring("left", 6, 99).alias("pred"), F.substring("right", 8, 99).alias("target"), "n", "rho"), "rho")


@query(ctes("obs") + CROSS + " SELECT pair, round(rho, 6) AS rho FROM rho WHERE rho IS NOT NULL ORDER BY abs(round(rho, 6)) DESC, pair LIMIT 4")
def top_corr_pairs(spark, sf_dir):
    found = cross_domain_corr(spark, sf_dir).where("rho is not null").select(F.concat_ws("/", "pred", "target").alias("pair"), "rho")
    return found.orderBy(F.desc(F.abs("rho")), "pair").limit(4)


#: Resamples of the intervals, and of the report by domain.
TIMES, REPORT_TIMES = 1000, 500


def draws(times: int) -> str:
    return """, ids AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT unit_id FROM oof)),
draws AS (SELECT b, ('0x' || substr(md5('42_' || b || '_' || i), 1, 8))::BIGINT % n AS j FROM ids, range(TIMES) AS t(b)),
drawn AS (SELECT b, unit_id FROM draws JOIN ids ON i = j)""".replace("TIMES", str(times))


@query(ctes("obs") + LONG + draws(TIMES) + ", x AS (SELECT b, y, p FROM drawn JOIN long USING (unit_id))" + rho("b", "x") + " SELECT round(quantile_cont(rho, 0.025), 6) AS pooled_rho_lo, round(quantile_cont(rho, 0.975), 6) AS pooled_rho_hi, round(quantile_cont(r2, 0.025), 6) AS pooled_r2_lo, round(quantile_cont(r2, 0.975), 6) AS pooled_r2_hi FROM rho")
def bootstrap_ci(spark, sf_dir):
    found = resample.interval(resample.bootstrap(long(spark, sf_dir), "unit_id", TIMES), ["pooled_rho", "pooled_r2"])
    return rounded(found, *found.columns)


@query(
    ctes("obs") + RUNS + draws(TIMES) + ", x AS (SELECT run * 10000 + b AS rb, y, p FROM drawn JOIN runs USING (unit_id) WHERE run < 2)" + rho("rb", "x")
    + " SELECT (b.rb % 10000)::BIGINT AS b, round(b.rho - a.rho, 6) AS delta_rho, round(b.r2 - a.r2, 6) AS delta_r2 FROM rho AS a JOIN rho AS b ON a.rb + 10000 = b.rb"
)
def paired_bootstrap_delta(spark, sf_dir):
    rows = written(runs(spark, sf_dir))  # both runs and the units they share are read from it
    found = resample.paired(rows.where("run = 0").drop("run"), rows.where("run = 1").drop("run"), "unit_id", TIMES)
    return rounded(found.withColumn("b", F.col("b").cast("bigint")), "delta_rho", "delta_r2")


Z = EDGES + UNIT_VALUES + ", z AS (SELECT unit_id, quantity - avg(quantity) OVER () AS z, stddev_pop(quantity) OVER () AS sd FROM vals), lag AS (SELECT src AS unit_id, avg(z) AS lag FROM edges JOIN z ON unit_id = dst GROUP BY src)"


@query(ctes("units") + Z + " SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) * sum(z.z * lag) / count(*) / (SELECT sum(z * z) FROM z), 6) AS moran_i, round(-1.0 / ((SELECT count(*) FROM z) - 1), 6) AS expected FROM z JOIN lag USING (unit_id)")
def moran_i(spark, sf_dir):
    return rounded(spatial.moran(unit_values(spark, sf_dir), "unit_id", "quantity", edges(spark, sf_dir)), "moran_i", "expected")


@query(ctes("units") + Z + " SELECT unit_id, round(z / sd, 6) AS z, round(lag / sd, 6) AS lag, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM z JOIN lag USING (unit_id)")
def lisa_quadrants(spark, sf_dir):
    return rounded(spatial.lisa(unit_values(spark, sf_dir), "unit_id", "quantity", edges(spark, sf_dir)), "z", "lag")


#: The units of Z in 999 orders by hash, from 0.
ORDERS = """, h AS (SELECT b::INTEGER AS b, unit_id, z, ('0x' || substr(md5('42_' || b || '_' || unit_id), 1, 8))::BIGINT AS h FROM z, range(1, 1000) AS t(b)),
dealt AS (SELECT b, unit_id, z, row_number() OVER (PARTITION BY b ORDER BY h, unit_id) - 1 AS pos FROM h)"""


@query(
    ctes("units") + Z + ORDERS + """, own AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) - 1 AS pos FROM z),
again AS (SELECT b, own.unit_id, z FROM dealt JOIN own USING (pos)), lags AS (SELECT b, src AS unit_id, avg(z) AS lag FROM edges JOIN again ON unit_id = dst GROUP BY b, src),
v AS (SELECT (SELECT sum(z * z) FROM z) AS ss, (SELECT count(*) FROM z) AS n), i AS (SELECT b, sum(z * lag) / count(*) * any_value(n) / any_value(ss) AS i FROM again JOIN lags USING (b, unit_id) CROSS JOIN v GROUP BY b),
r AS (SELECT sum(z.z * lag) / count(*) * any_value(n) / any_value(ss) AS real FROM z JOIN lag USING (unit_id) CROSS JOIN v),
c AS (SELECT count(*) AS n, count(*) FILTER (round(i, 9) >= round(real, 9)) AS above, any_value(real) AS real, avg(i) AS mean, stddev_pop(i) AS sd FROM i CROSS JOIN r)
SELECT round(real, 6) AS moran_i, round((least(above, n - above) + 1) / (n + 1), 6) AS p, round((real - mean) / sd, 5) AS z_sim FROM c"""
)
def moran_pseudo_p(spark, sf_dir):
    found = spatial.moran_p(unit_values(spark, sf_dir), "unit_id", "quantity", written(edges(spark, sf_dir)))
    return rounded(rounded(found, "moran_i", "p"), "z_sim", digits=5)


#: Local I of each unit of Z, and its share of orders, by drawing the units that follow it.
LISA = Z + ORDERS + """, k AS (SELECT unit_id, z.z, lag.lag, sd, (SELECT count(*) FROM edges JOIN z AS n ON n.unit_id = dst WHERE src = z.unit_id) AS k FROM z JOIN lag USING (unit_id)),
n AS (SELECT count(*) AS n FROM z), d AS (SELECT k.unit_id, dealt.b, avg(o.z) AS drawn FROM k JOIN dealt USING (unit_id) CROSS JOIN n JOIN dealt AS o ON o.b = dealt.b AND (o.pos - dealt.pos + n.n) % n.n BETWEEN 1 AND k GROUP BY k.unit_id, dealt.b),
own AS (SELECT unit_id, z, sd, round(z * lag / (sd * sd), 9) AS local_i, CASE WHEN z > 0 AND lag > 0 THEN 1 WHEN z <= 0 AND lag > 0 THEN 2 WHEN z <= 0 THEN 3 ELSE 4 END AS quadrant FROM k),
c AS (SELECT unit_id, any_value(local_i) AS local_i, any_value(quadrant) AS quadrant, count(*) AS n, count(*) FILTER (round(z * drawn / (sd * sd), 9) >= local_i) AS above FROM own JOIN d USING (unit_id) GROUP BY unit_id),
lisa AS (SELECT unit_id, local_i, quadrant, (least(above, n - above) + 1) / (n + 1) AS p_sim FROM c)"""


def significant(spark, sf_dir):
    return spatial.lisa_significance(unit_values(spark, sf_dir), "unit_id", "quantity", written(edges(spark, sf_dir)))


@query(ctes("units") + LISA + " SELECT unit_id, round(local_i, 6) AS local_i, quadrant, round(p_sim, 6) AS p_sim, CASE WHEN p_sim < 0.05 THEN quadrant ELSE 0 END AS cluster FROM lisa")
def lisa_significant(spark, sf_dir):
    return rounded(significant(spark, sf_dir), "local_i", "p_sim")


#: Residuals of the predictions as values on the grid, by domain.
RESIDUALS = OOF + EDGES + ", res AS (" + " UNION ALL ".join(f"SELECT unit_id, '{d}' AS domain, pred_{d} - target_{d} AS e FROM oof" for d in DOMAINS) + "), z AS (SELECT domain, unit_id, e - avg(e) OVER (PARTITION BY domain) AS z, count(*) OVER (PARTITION BY domain) AS n FROM res)"


@query(ctes("obs", "units") + RESIDUALS + ", lag AS (SELECT domain, src AS unit_id, avg(z) AS lag FROM edges JOIN z ON unit_id = dst GROUP BY domain, src), s AS (SELECT domain, sum(z * z) AS ss FROM z GROUP BY domain) SELECT domain, any_value(n) AS n, round(any_value(n) * sum(z * lag) / count(*) / any_value(ss), 6) AS moran_i, round(-1.0 / (any_value(n) - 1), 6) AS expected FROM z JOIN lag USING (domain, unit_id) JOIN s USING (domain) GROUP BY domain")
def moran_by_domain(spark, sf_dir):
    rows = long(spark, sf_dir).select("domain", "unit_id", (F.col("p") - F.col("y")).alias("e"))
    return rounded(spatial.moran(rows, "unit_id", "e", edges(spark, sf_dir), ["domain"]), "moran_i", "expected")


@query(
    """WITH u AS (SELECT s_nationkey AS g, s_suppkey % 3 AS label, s_suppkey AS id FROM supplier), l AS (SELECT g, max_by(label, id) AS label, ('0x' || substr(md5('42_' || g), 1, 8))::BIGINT AS h FROM u GROUP BY g),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, g) AS i, count(*) OVER (PARTITION BY label) AS n FROM l)
SELECT id, g AS group_id, CASE WHEN i <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM u JOIN r USING (g)"""
)
def stratified_split_of_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("group_id"), (F.col("s_suppkey") % 3).alias("label"))
    return folds.stratified_split(rows, "id", "label", group="group_id").select("id", "group_id", "split")


#: Groups by strata, and folds by the greedy rule: groups in falling order of their spread, each to the fold whose strata then
#: are most even. A recursion over the groups with the folds' counts so far as lists.
KFOLD = """WITH RECURSIVE u AS (SELECT s_suppkey AS unit_id, s_nationkey AS g, s_suppkey % 5 AS s FROM supplier), c AS (SELECT g, s, count(*) AS n FROM u GROUP BY g, s), strata AS (SELECT s, sum(n) AS total, row_number() OVER (ORDER BY s::VARCHAR) AS i FROM c GROUP BY s),
m AS (SELECT g, list(coalesce(n, 0)::BIGINT ORDER BY i) AS ns, list(total::BIGINT ORDER BY i) AS totals FROM (SELECT DISTINCT g FROM c) CROSS JOIN strata LEFT JOIN c USING (g, s) GROUP BY g),
o AS (SELECT g, ns, totals, row_number() OVER (ORDER BY -round(list_sum(list_transform(ns, lambda x: (x - list_avg(ns)) ** 2)), 6), -list_sum(ns), g::VARCHAR) AS at FROM m),
f AS (SELECT 0::BIGINT AS at, NULL::INTEGER AS g, NULL::BIGINT AS fold, (SELECT list_transform(range(5), lambda k: list_transform(ns, lambda x: 0::BIGINT)) FROM o WHERE o.at = 1) AS filled
UNION ALL SELECT o.at, o.g, p.k, list_transform(f.filled, lambda x, i: CASE WHEN i = p.k + 1 THEN list_transform(x, lambda y, j: y + o.ns[j]) ELSE x END)
FROM f JOIN o ON o.at = f.at + 1, LATERAL (SELECT k FROM range(5) AS r(k) ORDER BY round(list_sum(list_transform(o.ns, lambda n, j: ((f.filled[k + 1][j] + n) ** 2 - f.filled[k + 1][j] ** 2) / o.totals[j] ** 2)), 9), list_sum(f.filled[k + 1]), k LIMIT 1) AS p)"""


@query(KFOLD + " SELECT unit_id, u.g AS group_id, f.fold::INTEGER AS fold FROM u JOIN f ON f.g = u.g")
def group_kfold(spark, sf_dir):
    """Every unit's fold: groups stay together, strata are even."""
    units = frame(spark, sf_dir, "units").select("unit_id", "group_id", (F.col("unit_id") % 5).alias("stratum"))
    return units.join(folds.group_folds(units, "group_id", "stratum"), "group_id").select("unit_id", "group_id", "fold")


@query(
    """WITH u AS (SELECT c_custkey AS id, c_mktsegment AS label, ('0x' || substr(md5('42_' || c_custkey), 1, 8))::BIGINT AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id) AS i, count(*) OVER (PARTITION BY label) AS n FROM u)
SELECT id, label, CASE WHEN i <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN i <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def stratified_group_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return folds.stratified_split(rows, "id", "label")


def features(spark, sf_dir):
    """Units with features, targets from 1 to 10 and a fold."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id")).agg(
        F.avg("l_quantity").alias("x0"), F.avg("l_extendedprice").alias("x1"), F.avg("l_discount").alias("x2"), F.avg("l_tax").alias("x3"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("x4"), F.stddev_pop("l_quantity").alias("x5"), F.avg(F.col("l_quantity") * F.col("l_discount")).alias("x6"), F.avg((F.col("l_linestatus") == "F").cast("double")).alias("x7"),
    )
    units = frame(spark, sf_dir, "units").select("unit_id", "group_id", F.col("fold").cast("int").alias("fold"), "x", "y", "balance")
    t = units.join(line, "unit_id")
    return t.withColumns({"income": vectors.clipped(5 + (F.col("x0") - 25.5) / 2 + F.col("x") / 4, 1.0, 10.0), "health": vectors.clipped(5 + F.col("balance") / 3000 + (F.col("x2") - 0.05) * 100, 1.0, 10.0)})


X, Y = [f"x{i}" for i in range(8)], ["income", "health"]


@query()
def ridge_oof(spark, sf_dir):
    return learn.linear_oof(features(spark, sf_dir), "unit_id", "fold", [*X, "x", "y"], Y)


@query()
def ridge_target_lag_oof(spark, sf_dir):
    rows = written(features(spark, sf_dir))  # lags, fits and predictions read them
    lag = spatial.target_lag(rows, "unit_id", "fold", Y, edges(spark, sf_dir), list(range(5))).where("held_out = fold").drop("held_out", "fold")
    return learn.residual_oof(written(rows.join(lag, "unit_id")), "unit_id", "fold", [f"{t}_lag" for t in Y], X, Y)


@query()
def elastic_net_oof(spark, sf_dir):
    return learn.linear_oof(features(spark, sf_dir), "unit_id", "fold", X, Y, "elastic")


@query()
def lasso_oof(spark, sf_dir):
    return learn.linear_oof(features(spark, sf_dir), "unit_id", "fold", X, Y, "lasso")


@query()
def gbt_oof(spark, sf_dir):
    """Up to 2,000 rounds of boosted trees in log odds, stopped after 100 without gain."""
    rows = features(spark, sf_dir).withColumns({t: vectors.to_logit(F.col(t)) for t in Y})
    made = boosting.boosted_oof(rows, "unit_id", "fold", X, Y)
    return made.select("unit_id", "fold", *(vectors.from_logit(F.col(f"pred_{t}")).alias(f"pred_{t}") for t in Y))


@query()
def pca_blocks(spark, sf_dir):
    return learn.pca_oof(features(spark, sf_dir), "unit_id", "fold", X, 4)


@query()
def stacking_oof(spark, sf_dir):
    rows = features(spark, sf_dir)
    a = learn.linear_oof(rows, "unit_id", "fold", X, Y)
    b = learn.linear_oof(rows, "unit_id", "fold", ["x", "y", "balance"], Y, "lasso")
    return learn.stacked_oof(rows, "unit_id", "fold", [a, b], Y)


@query(
    ctes("units") + EDGES + UNIT_VALUES + """, t AS (SELECT unit_id, fold, quantity, discount FROM vals JOIN units USING (unit_id)),
m AS (SELECT f AS fold, avg(quantity) AS mq, stddev_pop(quantity) AS sq, avg(discount) AS md, stddev_pop(discount) AS sd FROM t, range(5) AS r(f) WHERE fold <> f GROUP BY f),
p AS (SELECT src AS unit_id, avg(n.quantity) AS q, avg(n.discount) AS d FROM edges JOIN t AS n ON n.unit_id = dst JOIN t AS s ON s.unit_id = src WHERE n.fold <> s.fold GROUP BY src),
o AS (SELECT t.unit_id, (quantity - mq) / sq AS yq, (coalesce(q, mq) - mq) / sq AS pq, (discount - md) / sd AS yd, (coalesce(d, md) - md) / sd AS pd FROM t JOIN m USING (fold) LEFT JOIN p USING (unit_id)),
long AS (SELECT 'quantity' AS domain, yq AS y, pq AS p FROM o UNION ALL SELECT 'discount', yd, pd FROM o)""" + rho("domain", "long", "each") + rho("", "long", "pool")
    + " SELECT domain, n, round(rho, 5) AS rho, round(r2, 5) AS r2 FROM each UNION ALL SELECT 'pooled', n, round(rho, 5), round(r2, 5) FROM pool"
)
def leak_safe_lag_quality(spark, sf_dir):
    """Flagship: how well the mean of neighbours outside a unit's fold predicts it, per domain and pooled."""
    rows = unit_values(spark, sf_dir).join(frame(spark, sf_dir, "units").select("unit_id", F.col("fold").cast("int").alias("fold")), "unit_id")
    names = ["quantity", "discount"]
    lag = spatial.target_lag(rows, "unit_id", "fold", names, edges(spark, sf_dir), list(range(5))).where("held_out = fold").drop("held_out", "fold")
    by = rows.groupBy("fold").agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("v", F.var_pop))))
    held = by.select(F.col("fold").alias("held_out")).join(by, F.col("held_out") != F.col("fold"))
    total = F.sum("n")
    mean = {c: F.sum(F.col("n") * F.col(f"m_{c}")) / total for c in names}
    scale = held.groupBy(F.col("held_out").alias("fold")).agg(*(x for c in names for x in (mean[c].alias(f"mean_{c}"), F.sqrt(F.sum(F.col("n") * (F.col(f"v_{c}") + F.col(f"m_{c}") * F.col(f"m_{c}"))) / total - mean[c] * mean[c]).alias(f"sd_{c}"))))
    z = lambda x, c: (F.col(x) - F.col(f"mean_{c}")) / F.col(f"sd_{c}")
    wide = rows.join(lag, "unit_id").join(F.broadcast(scale), "fold").select("unit_id", *(x for c in names for x in (z(c, c).alias(f"target_{c}"), z(f"{c}_lag", c).alias(f"pred_{c}"))))
    by_domain = metrics.scores(metrics.also_pooled(metrics.unpivoted(wide, ["unit_id"], names)), "y", "p", ["domain"])
    return rounded(by_domain.select("domain", "n", "rho", "r2"), "rho", "r2", digits=5)
