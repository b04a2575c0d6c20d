"""Tables, geometry, scores, folds, fits and sources by hand or by numpy."""

import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from areasignal import config
from areasignal.functions import geo, vectors
from areasignal.operators import folds, learn, metrics, resample, spatial, tables
from areasignal.sources import records, shapes

SQUARE = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))]
HOLE = [{"x": x, "y": y} for x, y in ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0))]


@pytest.mark.parametrize(("x", "y", "inside"), [(0.5, 0.5, True), (0.0, 2.0, True), (4.0, 4.0, True), (1.5, 1.5, False), (1.0, 1.5, False), (5.0, 1.0, False), (-1.0, 0.0, False)])
def test_point_in_polygon(spark, x, y, inside):
    df = spark.createDataFrame([(x, y, [SQUARE, HOLE])], f"x double, y double, rings {shapes.RINGS}")
    assert df.select(geo.in_polygon(F.col("x"), F.col("y"), F.col("rings"))).first()[0] is inside


def test_geometry(spark):
    df = spark.createDataFrame([(SQUARE,)], "r array<struct<x:double,y:double>>")
    r = df.select(geo.ring_area(F.col("r")).alias("a"), geo.ring_centroid(F.col("r")).alias("c"), geo.boundary_distance(F.lit(1.0), F.lit(2.5), F.array("r")).alias("d")).first()
    assert r.a == 16 and (r.c.x, r.c.y) == (2, 2) and r.d == 1
    km = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0]
    assert abs(km - 111194.93) < 0.1


def test_joins_of_points(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, None, 1.0), (4, 9.0, 9.0)], "p int, x double, y double")
    polygons = spark.createDataFrame([("a", 2, [SQUARE]), ("b", 1, [SQUARE, HOLE])], f"q string, ord int, rings {shapes.RINGS}")
    first = spatial.points_in_polygons(points, polygons, "p", "q", 1.0)
    assert sorted((r.p, r.q) for r in first.collect()) == [(1, "b"), (2, "a")]
    every = spatial.points_in_polygons(points, polygons, "p", "q", 1.5, first=False, left=True)
    assert sorted(((r.p, r.q) for r in every.collect()), key=str) == [(1, "a"), (1, "b"), (2, "a"), (3, None), (4, None)]


def test_neighbours_by_tolerance(spark):
    box = lambda a, b: [[{"x": a + p, "y": b + q} for p, q in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]]
    df = spark.createDataFrame([(1, box(0.0, 0.0)), (2, box(1.0, 1.0)), (3, box(2.2, 0.0)), (4, box(9.0, 9.0))], f"u int, rings {shapes.RINGS}")
    pairs = lambda t: {(r.src, r.dst) for r in spatial.neighbours(df, "u", 1.0, t).collect()}
    assert pairs(0.0) == {(1, 2), (2, 1)}
    assert pairs(0.5) == {(1, 2), (2, 1), (2, 3), (3, 2)}
    lists = {r.u: r.neighbours for r in spatial.neighbour_lists(df, "u", spatial.neighbours(df, "u", 1.0)).collect()}
    assert lists == {1: [2], 2: [1], 3: [], 4: []}


def test_target_lag_never_reads_its_own_fold(spark):
    edges = spark.createDataFrame([(a, b) for a in range(6) for b in range(6) if abs(a - b) == 1], "src int, dst int")
    rows = [(u, u % 2, float(u)) for u in range(6)]
    lag = lambda r: {(x.held_out, x.u): x.t_lag for x in spatial.target_lag(spark.createDataFrame(r, "u int, fold int, t double"), "u", "fold", ["t"], edges, [0, 1]).collect()}
    changed = lag([(u, f, t + 100 * (f == 0)) for u, f, t in rows])
    assert {k: v for k, v in lag(rows).items() if k[0] == 0} == {k: v for k, v in changed.items() if k[0] == 0}
    assert lag(rows)[0, 0] == 1.0 and lag(rows)[0, 1] == 3.0  # no neighbour outside: the mean of all outside


def test_scores_of_few_pairs(spark):
    rows = [("none", None, 1.0), ("one", 2.0, 5.0), ("two", 1.0, 2.0), ("two", 3.0, 4.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, y double, p double")
    got = {r.k: (r.n, r.rho, r.mae, r.rmse) for r in metrics.scores(df, "y", "p", ["k"], few=0.0).collect()}
    assert got == {"none": (0, 0.0, 0.0, 0.0), "one": (1, 0.0, 3.0, 3.0), "two": (2, 1.0, 1.0, 1.0), "flat": (2, None, 1.5, 2.5**0.5)}
    assert {r.k: r.rho for r in metrics.spearman(df, "y", "p", ["k"]).collect()} == {"one": None, "two": 1.0, "flat": None}
    r = metrics.scores(df.where("false"), "y", "p", few=0.0).first()
    assert (r.n, r.rho, r.rmse, r.r2) == (0, 0.0, 0.0, None)
    whole = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 3.0)], "y int, p double")  # of two types
    assert abs(metrics.spearman(whole, "y", "p").first().rho - 0.5) < 1e-12


def test_ranks_and_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 2.0, 5.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 3.0)], "k string, y double, p double")
    ranks = metrics.average_rank(df, "y", ["k"]).where("k = 'a'").orderBy("y", "p").select("rank").collect()
    assert [r[0] for r in ranks] == [None, 1.0, 2.5, 2.5]
    got = {r.k: r for r in metrics.scores(df, "y", "p", ["k"]).collect()}
    assert got["b"].rho is None and got["b"].r2 is None and got["a"].n == 3
    assert abs(got["a"].rho - 0.5) < 1e-9 and abs(got["a"].mae - 4 / 3) < 1e-9
    many = spark.range(1000).selectExpr("id % 37 AS y", "pow(id % 37, 3) AS p")
    assert abs(metrics.spearman(many, "y", "p").first().rho - 1) < 1e-12


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (5, 5), (5, 3)], "t int, q int")
    r = metrics.classification(df, "t", "q").first()
    assert abs(r.accuracy - 0.5) < 1e-12 and abs(r.balanced_accuracy - 0.5) < 1e-12 and abs(r.macro_f1 - (1 + 0 + 0 + 2 / 3) / 4) < 1e-12
    t, q = np.array([1, 2, 5, 5]), np.array([1, 3, 5, 3])
    want = 1 - ((t - q) ** 2).mean() / ((t[:, None] - q[None, :]) ** 2).mean()
    assert abs(metrics.kappa(df, "t", "q").first().qwk - want) < 1e-12
    assert metrics.kappa(df.where("t = 1"), "t", "q").first().qwk == 0.0
    w = metrics.within_one(spark.createDataFrame([(2.5, 2.4), (3.5, 4.6), (10.0, 12.0)], "y double, p double"), "y", "p").first()
    assert abs(w.accuracy - 2 / 3) < 1e-12 and abs(w.within_one - 1 / 3) < 1e-12


def test_images_units_and_folds(spark):
    rows = [("u", 0.0, 0.7, 0.0, 0.0, 0.0), ("u", 0.3, 0.2, 0.0, 0.0, 0.0), ("v", 0.0, 0.0, 0.6, 0.0, 0.0), ("v", None, None, None, None, 0.9), ("w", None, 0.9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "u string, sky double, building double, road double, sidewalk double, other double")
    got = {r.u: r for r in tables.unit_ratios(df, "u", columns=("sky", "building")).collect()}
    assert (got["u"].n_images, got["u"].n_filtered, got["u"].sky_mean, got["u"].sky_std) == (2, 1, 0.3, 0.0)
    assert got["v"].n_filtered == 2 and got["v"].sky_mean is None and got["w"].n_filtered == 0
    units = spark.createDataFrame([(i, i % 12, i % 2) for i in range(120)], "u int, g int, s int")
    made = units.join(folds.group_folds(units, "g", "s", 4), "g")
    assert made.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(r["count"] for r in made.groupBy("fold").count().collect()) == [30] * 4
    # One group of a third of all rows, 2,000 small ones: most of them are dealt in bundles.
    rows = spark.range(9000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id") % 2000).alias("g"), (F.col("id") % 3).alias("s"))
    dealt = folds.group_folds(rows, "g", "s", 4, most=50, bundles=100)
    again = folds.group_folds(rows.repartition(7), "g", "s", 4, most=50, bundles=100)
    assert sorted(dealt.collect()) == sorted(again.collect()) and dealt.count() == dealt.select("g").distinct().count() == 2001
    by = {(r.fold, r.s): r["count"] for r in rows.where("g >= 0").join(dealt, "g").groupBy("fold", "s").count().collect()}
    alone = dealt.where("g = -1").first().fold
    assert all(abs(by[k, s] - 2000 / 3) < 70 for k in range(4) if k != alone for s in range(3)) and not any(by.get((alone, s), 0) > 200 for s in range(3))


def test_imputing_vectors_and_bins(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (2, 0, None), (3, 1, 6.0), (4, 1, None)], "u int, fold int, x double")
    got = {(r.held_out, r.u): r.x for r in tables.impute_by_fold(df, "fold", ["x"], [0, 1]).collect()}
    assert got[0, 2] == 6.0 and got[1, 2] == 2.0 and got[0, 1] == 2.0
    v = spark.createDataFrame([([1.0] * 8,)], "v array<double>")
    assert v.select(vectors.masked(F.col("v"), 2, ablate=["ntl"])).first()[0] == [1, 1, 0, 0, 1, 1, 1, 1]
    assert v.select(vectors.masked(F.col("v"), 2, ablate=["sat"], keep=["poi"])).first()[0] == [0] * 6 + [1, 1]
    assert abs(sum(x * x for x in v.select(vectors.l2_normalised(F.col("v"))).first()[0]) - 1) < 1e-12
    n = spark.range(1, 12).select(F.col("id").cast("double").alias("x"))
    bounds = tables.quantile_bounds(n, "x")
    assert [r[0] for r in n.select(tables.binned(F.col("x"), bounds)).collect()] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert spark.range(1).select(vectors.ordinal(F.lit(2.5)), vectors.ordinal(F.lit(11.0)), vectors.from_logit(vectors.to_logit(F.lit(4.0)))).first() == (2, 10, pytest.approx(4.0))


def test_resamples_are_repeatable(spark):
    units = spark.range(30).select(F.col("id").alias("u"))
    a, b = (sorted((r.u, *np.frombuffer(r.w, np.int16)) for r in resample.weighted(units.repartition(k), units, "u", 5).collect()) for k in (1, 3))
    assert a == b and len(a) == 30 and (np.array(a)[:, 1:].sum(0) == 30).all()
    long = units.selectExpr("u", "'d' AS domain", "CAST(u AS DOUBLE) AS y", "CAST(u * u AS DOUBLE) AS p")
    delta = resample.paired(long, long, "u", 5).collect()
    assert len(delta) == 5 and all(r.delta_rho == 0 and r.delta_r2 == 0 for r in delta)
    assert resample.interval(resample.bootstrap(long, "u", 20), ["pooled_rho"]).first().pooled_rho_lo == pytest.approx(1.0)


def folded(spark, n=120, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 10, 0.1, 5, 0] + 3
    y = x[:, :1] * 2 - x[:, 1:2] * 0.3 + rng.normal(size=(n, 1)) * 0.1
    fold = np.arange(n) % 4
    df = spark.createDataFrame([(i, int(fold[i]), *map(float, x[i]), float(y[i, 0])) for i in range(n)], "u int, fold int, " + ", ".join(f"x{j} double" for j in range(d)) + ", t double")
    return df.repartition(3), x, y[:, 0], fold


def test_ridge_against_numpy(spark):
    df, x, y, fold = folded(spark)
    names = [f"x{j}" for j in range(5)]
    got = np.array([r.pred_t for r in learn.linear_oof(df, "u", "fold", names, ["t"], alphas=[3.0]).orderBy("u").collect()])
    for k in range(4):
        m, s = x[fold != k].mean(0), x[fold != k].std(0)
        s = np.where(s > 1e-12, s, 1)
        z, zt = (x[fold != k] - m) / s, (x[fold == k] - m) / s
        yk = y[fold != k]
        w = np.linalg.solve(z.T @ z + 3 * np.eye(5), z.T @ (yk - yk.mean()))
        assert np.allclose(got[fold == k], zt @ w + yk.mean(), atol=1e-6)


def inner_of(units):
    """The part of the training rows that each unit is in, as the hash says."""
    return np.array([int(int(hashlib.md5(f"inner_{u}".encode()).hexdigest()[:8], 16) / 2**32 * learn.INNER) for u in units])


def test_ridge_penalty_is_chosen_as_by_numpy(spark):
    df, x, y, fold = folded(spark)
    names, inner = [f"x{j}" for j in range(5)], inner_of(range(len(x)))
    models = learn.fitted(df, "u", "fold", names, ["t"])
    for k, made in models.items():
        rest = fold != k
        z = (x[rest] - x[rest].mean(0)) / np.where(x[rest].std(0) > 1e-12, x[rest].std(0), 1)
        yk, part = y[rest], inner[rest]
        marks = []
        for alpha in learn.RIDGE:
            found = []
            for j in np.unique(part):
                a, b = part != j, part == j
                m, c = z[a].mean(0), yk[a].mean()
                w = np.linalg.solve((z[a] - m).T @ (z[a] - m) + alpha * np.eye(5), (z[a] - m).T @ (yk[a] - c))
                left = yk[b] - (z[b] - m) @ w - c
                found.append(1 - (left**2).sum() / ((yk[b] - yk[b].mean()) ** 2).sum())
            marks.append(np.mean(found))
        assert made.alpha[0] == learn.RIDGE[int(np.argmax(marks))]


def test_lasso_and_elastic_net_are_optimal(spark):
    df, x, y, fold = folded(spark)
    names = [f"x{j}" for j in range(5)]
    for kind in ("lasso", "elastic"):
        for k, m in learn.fitted(df, "u", "fold", names, ["t"], kind).items():
            z, n = (x[fold != k] - m.mean) / m.sd, (fold != k).sum()
            w, l1, l2 = m.weights[1:, 0], m.alpha[0] * m.share[0], m.alpha[0] * (1 - m.share[0])
            slope = z.T @ (y[fold != k] - m.weights[0] - z @ w) / n - l2 * w
            assert all(abs(g - l1 * np.sign(c)) < 1e-5 if c else abs(g) <= l1 + 1e-6 for g, c in zip(slope, w))
            assert kind == "lasso" and m.share[0] == 1.0 or m.share[0] in learn.L1_SHARES
            assert m.alpha[0] <= np.abs(z.T @ (y[fold != k] - y[fold != k].mean())).max() / n / m.share[0] * (1 + 1e-9)


def test_pca_and_stack(spark):
    df, x, y, fold = folded(spark)
    names = [f"x{j}" for j in range(5)]
    mean, parts, var = learn.pca(df, "u", names, 3)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(parts @ vt[:3].T), np.eye(3), atol=1e-6) and np.allclose(var, s[:3] ** 2 / len(x)) and np.allclose(mean, x.mean(0))
    got = np.array([[r.a_pc0, r.a_pc1, r.x4] for r in learn.reduced(df, "u", "fold", {"a": names[:2], "b": names[2:4]}, 2).orderBy("u").collect()])
    for k in range(4):
        part = x[fold != k][:, :2]
        _, _, vt = np.linalg.svd(part - part.mean(0), full_matrices=False)
        assert np.allclose(np.abs(got[fold == k][:, :2]), np.abs((x[fold == k][:, :2] - part.mean(0)) @ vt.T), atol=1e-6)
    assert np.allclose(got[:, 2], x[:, 4])
    rows = df.withColumn("t", vectors.clipped(F.col("t") / 4 + 5, 1.0, 10.0))
    oofs = [learn.linear_oof(rows, "u", "fold", names, ["t"], kind) for kind in ("ridge", "elastic")]
    stacked = learn.stacked_oof(rows, "u", "fold", [oofs[0], oofs[1].where("u > 3")], ["t"]).join(rows.select("u", "t"), "u")
    assert stacked.count() == 120 and stacked.agg(F.corr("pred_t", "t")).first()[0] > 0.9


def test_wide_features_against_numpy(spark, tmp_path):
    """An array of 1,100 features, over several tiles, with values that the clip bounds; models are saved and loaded."""
    rng = np.random.default_rng(7)
    n, d = 400, 1100
    x = rng.normal(size=(n, d))
    x[:, 0] = np.where(np.arange(n) % 397 == 0, 1e6, x[:, 0])
    y = np.stack([x[:, 1:30].sum(axis=1) + rng.normal(size=n), x[:, 5] * 3], axis=1)
    fold = np.arange(n) % 3
    df = spark.createDataFrame([(i, int(fold[i]), x[i].tolist(), *map(float, y[i])) for i in range(n)], "u int, fold int, x array<double>, t double, s double")
    models = learn.fitted(df, "u", "fold", "x", ["t", "s"], clip=10.0, alphas=[50.0])
    learn.save(models, spark, str(tmp_path / "models"))
    models = learn.load(spark, str(tmp_path / "models"))
    got = np.array([[r.pred_t, r.pred_s] for r in learn.apply_linear(df, "u", "fold", "x", ["t", "s"], models).orderBy("u").collect()])
    for k in range(3):
        rest = fold != k
        m, s = x[rest].mean(0), x[rest].std(0)
        z, zt = (np.clip((x[a] - m) / s, -10, 10) for a in (rest, fold == k))
        c = z.mean(0)
        w = np.linalg.solve((z - c).T @ (z - c) + 50 * np.eye(d), (z - c).T @ (y[rest] - y[rest].mean(0)))
        assert np.allclose(got[fold == k], (zt - c) @ w + y[rest].mean(0), atol=1e-6)


def test_json_sources(spark, tmp_path):
    good = {"patch_id": "p", "datazone": "u", "streetview_indices": [4], "reasoning_json": {"evidence": {"satellite": ["a"], "streetview_04": ["x", "y"], "streetview_01": ["w"], "POI": {"shop": 2, "bar": 0, "total": 3}}}}
    listed = {"datazone": "v", "reasoning_json": {"evidence": {"nightlight": ["n"], "POI": ["2 POIs total: shop ×2"]}}}
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(listed)]))
    rows = records.read_json_lines(spark, str(tmp_path / "p.jsonl"), records.PERCEPTION)
    got = {r.datazone: r for r in records.parsed_evidence(rows).collect()}
    assert got["u"].sat == ["a"] and got["u"].sv == ["w", "x", "y"] and got["u"].counts == {"shop": 2, "bar": 0} and got["u"].total == 3
    assert got["v"].ntl == ["n"] and got["v"].counts == {"shop": 2} and got["v"].total == 2 and got["v"].sv == []
    assert records.read_json_lines(spark, str(tmp_path / "p.jsonl"), records.PERCEPTION, lines=2).count() == 1
    one = dict.fromkeys(records.DOMAINS, 2.0)
    (tmp_path / "o.jsonl").write_text(json.dumps({"datazone": "u", "prediction_json": one, "target_raw": one}))
    r = records.read_oof(spark, str(tmp_path / "o.jsonl")).first()
    assert r.fold == -1 and r.pred_Crime == 2.0 and r.target_Income == 2.0
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        records.read_oof(spark, str(tmp_path / "e.jsonl"))


@pytest.mark.parametrize(("raw", "vec", "missing"), [('{"a": {"score": 3}, "b": {"score": 0.5}}', [3.0, 0.5], 0), ('{"a": {"score": 5}, "b": {"score": 1}}', [0.0, 0.0], 1), ('{"a": {"score": true}, "b": {"score": 1}}', [0.0, 0.0], 1), ('{"a": {"score": 1}}', [0.0, 0.0], 1), ("{}", [0.0, 0.0], 1), (None, [0.0, 0.0], 1)])
def test_indicators(spark, raw, vec, missing):
    v, m = records.indicator_vector(F.col("raw"), ["a", "b"])
    r = spark.createDataFrame([(raw,)], "raw string").select(v.alias("v"), m.alias("m")).first()
    assert (r.v, r.m) == (vec, missing)


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("DataZone,income_score,employment_score,health_score,education_score,access_score,crime_score,housing_score\nz,1,2,3,4,5,6,7\n")
    assert records.truth(spark.read.option("header", True).csv(str(tmp_path / "t.csv"))).first().housing == 7.0
    (tmp_path / "c.csv").write_text("id,lat,lon\n1,2.5,x\n2,3,4\n")
    assert records.read_table(spark, str(tmp_path / "c.csv"), ["id"], ["lat", "lon"]).count() == 1
    with pytest.raises(ValueError):
        records.read_table(spark, str(tmp_path / "c.csv"), ["none"], [])
    df = spark.createDataFrame([(1, 2.0), (2, 3.14159)], "k int, v double")
    for _ in range(2):
        records.append_new(df, str(tmp_path / "out"), ["k"])
    records.append_new(df.union(df.selectExpr("k + 1", "v")), str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    records.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "csv")).collect() if r.value[0] != "k") == ["1,2.0000", "2,3.1416"]
    t = spark.createDataFrame([(" ", "u", "TRUE", "1.5", "x")], "patch_id string, datazone string, has_streetview string, bbox_min_lon string, centroid_lat string")
    assert records.tiles(t).first().asDict() == {"patch_id": "u", "datazone": "u", "has_streetview": True, "bbox_min_lon": 1.5, "centroid_lat": None}
    assert records.same_cache(df, {"m": 1}, df, {"m": 1}, "k") and not records.same_cache(df, {"m": 1}, df.limit(1), {"m": 1}, "k")
    assert tables.resolve(["a", "My_Zone"], ["unit"], ["zone"]) == "My_Zone"
    assert tables.select_columns(["b_mean", "a_mean", "x"], ["mean", "x"]) == ["a_mean", "b_mean", "x"]


def test_shapefiles(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = lambda i, b: struct.pack(">2i", i, len(b) // 2) + b
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + record(1, body) + record(2, struct.pack("<i", 0)) + record(3, body))
    field = lambda name, width: name.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([width, 0]) + b"\0" * 14
    rows = [b" z1 x", b" z2 y", b"*z3 w"]
    (tmp_path / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 1, 1, 1, len(rows), 32 + 64 + 1, 5) + b"\0" * 20 + field(b"ID", 3) + field(b"K", 1) + b"\r" + b"".join(rows))
    got = shapes.read_polygons(spark, str(tmp_path)).collect()
    assert [(r.ord, r.fields, len(r.rings[0])) for r in got] == [(0, {"ID": "z1", "K": "x"}, 4)]


def test_config():
    c = config.RunConfig.of({"folds": 3, "ablate": ["ntl"]}, {"folds": None, "use_poi": False})
    assert c.folds == 3 and c.ablate == ("ntl",)
    with pytest.raises(ValueError):
        config.RunConfig.of({"nothing": 1})
    columns, parts = config.feature_blocks(c, {"embedding": ["e0", "e1"], "poi": ["p"], "ego_gap": ["g"]})
    assert columns == ["e0", "e1", "g"] and parts == [("embedding", 0, 2), ("ego_gap", 2, 3)]
    assert [r.name for r in config.chosen([config.RunConfig(name="a"), config.RunConfig(name="b")], ["b"])] == ["b"]
    assert metrics.markdown([{"a": 1}], ["a", "b"]).count("|") == 9


def test_greedy_spacing_takes_all_keys(spark, tmp_path):
    from areasignal import plans

    rng = np.random.default_rng(4)
    keys = [int(k) for k in rng.permutation(np.r_[1:300, 99_990:100_400])]
    rows = [(k, k % 3 if k < 99_990 else 3 + k % 3) for k in keys]  # units whose keys are all small, and all large
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    want = set()
    for unit in range(6):
        taken = []
        for k in sorted(k for k, u in rows if u == unit and k % 10 != 3 and k % 9 != 2):  # not outside the areas, not seen before
            lat, lon = np.radians(55.8 + k % 100 / 1000), np.radians(-4.3 + k % 77 / 500)
            far = lambda q: 2 * 6371000 * np.arcsin(np.sqrt(np.sin((lat - q[1]) / 2) ** 2 + np.cos(lat) * np.cos(q[1]) * np.sin((lon - q[2]) / 2) ** 2))  # noqa: B023, E731
            if len(taken) < 15 and all(far(q) >= 2000 for q in taken):
                want.add((unit, len(taken), k))
                taken.append((k, lat, lon))
    assert {(r.unit_id, r.place, r.at) for r in plans.QUERIES["min_spacing_greedy"](spark, str(tmp_path)).collect()} == want
