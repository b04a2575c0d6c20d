"""Placement, projection, encoders and whole runs."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from areasignal.config import RunConfig
from areasignal.functions import geo
from areasignal.operators import crossval, encode, metrics, perceive, replicates, spatial
from areasignal.sources import shapes


def box(x, y, side=4.0):
    return [[{"x": x + p, "y": y + q} for p, q in ((0.0, 0.0), (side, 0.0), (side, side), (0.0, side))]]


def test_placed_boxes_do_not_meet(spark):
    areas = spark.createDataFrame([("a", 1, box(0.0, 0.0), 2.0, 2.0, -1), ("b", 2, box(3.0, 0.0), 5.0, 2.0, 2)], f"u string, ord int, rings {shapes.RINGS}, cx double, cy double, most int")
    there = spark.createDataFrame([(2.0, 2.0)], "x double, y double")
    got = spatial.placed_boxes(areas, "u", there, 1.0).collect()
    points = [(r.x, r.y) for r in got]
    assert sum(r.u == "b" for r in got) == 2 and sum(r.u == "a" for r in got) >= 3
    assert all(max(abs(p[0] - 2), abs(p[1] - 2)) > 1 for p in points)
    assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) > 1 for i, p in enumerate(points) for q in points[:i])


def test_boxes_taken_are_written_once(spark, monkeypatch):
    areas = spark.createDataFrame([(i, i, box(3.0 * (i % 4), 3.0 * (i // 4)), 3.0 * (i % 4) + 2, 3.0 * (i // 4) + 2, (-1, 2, 3)[i % 3]) for i in range(12)], f"u int, ord int, rings {shapes.RINGS}, cx double, cy double, most int").coalesce(1)
    made = []
    monkeypatch.setattr(spatial, "written", lambda df, real=spatial.written: made.append(real(df)) or made[-1])
    got = spatial.placed_boxes(areas, "u", spark.createDataFrame([(2.0, 2.0)], "x double, y double"), 1.0).collect()
    points = [(r.x, r.y) for r in got]
    assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) > 1 for i, p in enumerate(points) for q in points[:i])
    assert all(sum(r.u == i for r in got) <= 2 + i % 3 - 1 for i in range(12) if i % 3)
    assert sum(t.count() for t in made if "_id" not in t.columns) == len(got)


def test_boxes_are_never_sent_to_the_driver(spark, monkeypatch):
    """Files of candidates are small, but their rows in all cells around are many."""
    areas = spark.createDataFrame([(i, i, box(3.0 * (i % 4), 3.0 * (i // 4)), 3.0 * (i % 4) + 2, 3.0 * (i // 4) + 2, (-1, 2)[i % 2]) for i in range(8)], f"u int, ord int, rings {shapes.RINGS}, cx double, cy double, most int")
    plans = []
    monkeypatch.setattr(spatial, "written", lambda df, real=spatial.written: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or real(df))
    assert spatial.placed_boxes(areas, "u", spark.createDataFrame([(2.0, 2.0)], "x double, y double"), 1.0).count() > 8
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_projection_and_pixels(spark):
    at = geo.national_grid(F.lit(52 + 39 / 60 + 28.8282 / 3600), F.lit(1 + 42 / 60 + 57.8663 / 3600))
    r = spark.range(1).select(at.alias("p"), geo.pixel(F.lit(5.5), F.lit(7.5), 0.0, 10.0, 1.0, 1.0, 5, 5).alias("q")).first()
    assert abs(r.p.x - 651409.9) < 10 and abs(r.p.y - 313177.3) < 10
    assert (r.q.col, r.q.row, r.q.inside) == (5, 2, False)


def test_random_points_are_inside_and_repeat(spark):
    df = spark.createDataFrame([(7, box(0.0, 0.0))], f"u int, rings {shapes.RINGS}")
    draw = lambda: [tuple(r) for r in geo.random_points(df, "u", "rings", 9).orderBy("place").collect()]
    assert draw() == draw() and len(draw()) == 9 and all(0 <= x <= 4 and 0 <= y <= 4 for _, _, x, y in draw())


def test_points_drawn_in_a_plane(spark):
    degrees = [[{"x": x, "y": y} for x, y in ((-4.5, 55.8), (-4.0, 55.8), (-4.0, 56.0), (-4.5, 56.0))]]
    df = spark.createDataFrame([("a", degrees)], f"u string, rings {shapes.RINGS}")
    flat = df.select("u", geo.in_plane(F.col("rings"), False).alias("rings"))
    back = geo.from_web_mercator(F.col("x"), F.col("y"))
    got = [r.p for r in geo.random_points(flat, "u", "rings", 40).select(back.alias("p")).collect()]
    assert len(got) == 40 and all(55.8 <= p.lat <= 56.0 and -4.5 <= p.lon <= -4.0 for p in got)
    assert df.select(geo.in_plane(F.col("rings"), True).alias("r")).first().r[0][0].x == -4.5
    assert spark.range(1).select(geo.web_mercator(F.lit(None).cast("double"), F.lit(1.0)).alias("m")).first().m.y is None


def hashed_vector(text, width, seed=42):
    """Words and pairs of words one by one, as a check on the expression of columns."""
    words = re.findall(r"\w+", text.lower())
    out = np.zeros(width)
    for gram in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = int(hashlib.md5(f"{seed}_{gram}".encode()).hexdigest()[:8], 16)
        out[h // 2 % width] += 1 if h % 2 else -1
    return out / (np.linalg.norm(out) or 1)


def test_encoders(spark):
    df = spark.createDataFrame([("u", "old road", "dim", "road; wide road", "t"), ("v", None, None, None, None)], "u string, sat string, ntl string, sv string, poi_text string")
    got = {r.u: np.array(r.embedding) for r in encode.by_modality(df, "u", encode.encoder("hashed", width=8), 8).collect()}
    assert len(got["u"]) == 32 and abs(np.linalg.norm(got["u"][:8]) - 1) < 1e-9
    want = (np.array(hashed_vector("road", 8)) + np.array(hashed_vector("wide road", 8))) / 2
    assert np.allclose(got["u"][16:24], want)
    assert np.allclose(got["v"][:8], hashed_vector("[no satellite evidence]", 8))
    odd = ["", " ; ", "one", "Ünïcode wörter, ßcharf", "a b a b a b", "x " * 3000, None]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, t string").select("k", encode.hashed(5)(F.col("t")).alias("v"))
    assert all(np.allclose(r.v, hashed_vector(odd[r.k] or "", 5)) for r in df.collect())
    with pytest.raises(ValueError):
        encode.encoder("none")
    m = spark.range(1).select(encode.masked_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(0), F.lit(1)))).first()[0]
    assert m == [3.0, 4.0]


def test_runs_by_settings(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 5, float(x), float(2 * x + y / 10), [float(z) for z in rng.normal(size=8)]) for i, (x, y) in enumerate(rng.normal(size=(80, 2)))]
    units = spark.createDataFrame(rows, "u int, fold int, x0 double, t double, e array<double>")
    edges = spark.createDataFrame([(a, b) for a in range(80) for b in (a - 1, a + 1) if 0 <= b < 80], "src int, dst int")
    for settings in ({"use_embedding": False}, {"ablate": ["sat"], "pca_components": 3}, {"regressor": "elastic", "use_embedding": False, "use_neighbour_mean": True}):
        made = crossval.run(RunConfig.of(settings), units, "u", ["t"], edges, {"poi": ["x0"]}, ("e", 2))
        assert made.count() == 80
        s = {r.domain: r for r in crossval.summary(made, units, "u", ["t"]).collect()}
        assert s["pooled"].rho > 0.8 and s["t"].n == 80
    with pytest.raises(ValueError):
        crossval.run(RunConfig.of({"regressor": "none", "use_embedding": False}), units, "u", ["t"], edges, {"poi": ["x0"]})


def test_stand_ins(spark):
    images = spark.createDataFrame([("u", "a/0.png"), ("u", "a/1.png")], "u string, path string")
    got = perceive.perceived(images, "u", "path", perceive.stand_in_phrases(["road", "tree", "sky"]), perceive.stand_in_phrases(["none"])).collect()
    assert all(1 <= len(r.phrases) <= 3 for r in got)
    old = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "k int, v array<string>")
    new = spark.createDataFrame([(2, ["b"]), (1, ["z"])], "k int, v array<string>")
    assert sorted((r.k, r.v) for r in perceive.backfilled(old, "k", new, "v").collect()) == [(1, ["a"]), (2, ["b"]), (3, [])]


def test_manifests(tmp_path):
    from areasignal import config

    at = tmp_path / "runs.json"
    at.write_text('{"defaults": {"folds": 3}, "runs": [{"name": "a"}, {"name": "b", "ablate": ["ntl"], "folds": 4}], "paths": {"oof": "out/oof.jsonl", "far": "s3://x/y"}}')
    runs, paths = config.manifest(str(at))
    assert [(r.name, r.folds, r.ablate) for r in runs] == [("a", 3, ()), ("b", 4, ("ntl",))]
    assert paths == {"oof": str(tmp_path / "out/oof.jsonl"), "far": "s3://x/y"} and config.manifest(str(at), "/b")[1]["oof"] == "/b/out/oof.jsonl"
    assert [r.name for r in config.chosen(runs, ["b"])] == ["b"] and config.even(4) == 4
    assert RunConfig.of(config.DIAGNOSTICS).use_coordinates
    for bad in (0, 3, -2):
        with pytest.raises(ValueError):
            config.even(bad)


def test_prompts_and_bytes(spark):
    from areasignal.functions import text
    from areasignal.sources import records

    spec = {"cracks": "pavement", "bins": "litter"}
    df = spark.createDataFrame([("satellite: a", "p"), ("POI: x", "p"), ("b", None)], "e string, p string")
    full = [r[0] for r in df.select(text.indicator_prompt("Score.", F.col("e"), spec, F.col("p"))).collect()]
    assert "satellite: a\nPOI: p\n" in full[0] and "POI: p" not in full[1] and "- cracks: pavement\n- bins: litter" in full[2]
    assert "- cracks\n- bins" in df.select(text.indicator_prompt("Score.", F.col("e"), spec, minimal=True)).first()[0]
    raw = spark.createDataFrame([(b"\xff\xd8\xff\xe0aa",), (b"\x89PNG\r\n\x1a\n1",), (b"GIF",), (b"",), (None,)], "b binary")
    assert [r[0] for r in raw.select(records.image_state(F.col("b"))).collect()] == ["ok", "ok", "corrupt", "corrupt", "missing"]


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    from areasignal import session

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="share"):
        session.shared_folder(Session())


def test_scaler_is_saved(spark, tmp_path):
    from areasignal.operators import tables

    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("b", "z", 5), ("c", "w", 1)], "u string, k string, n int")
    made = tables.CountScaler(2).fit(df, "u", "k", "n")
    made.save(spark, str(tmp_path / "s"))
    again = tables.CountScaler.load(spark, str(tmp_path / "s"))
    assert again.columns == made.columns and again.moments == made.moments
    assert sorted(map(tuple, again.transform(df, "u", "k", "n").collect())) == sorted(map(tuple, made.transform(df, "u", "k", "n").collect()))


def test_equal_values_of_several_tasks_are_constant(spark):
    """The deviation of equal values isn't 0 where means are merged from tasks of such sizes."""
    rows = spark.range(0, 2000, 1, 7).select((F.col("id") % 5).cast("double").alias("y"), (F.lit(5.457391304347826) + 0 * F.col("id")).alias("p"))
    assert rows.agg(F.stddev_pop("p")).first()[0] > 0
    assert tuple(rows.agg(metrics.correlation(F.col("y"), F.col("p")), metrics.r_squared(F.col("p"), F.col("y"))).first()) == (None, None)


def test_signs_round_the_exact_binary_value(spark, con):
    values = [0.03125, -0.03125, 0.09375, 1.00005, 2.00015, 0.00005, -0.00001, 123456.78905, 1e-9, 0.0]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", metrics.signed(F.col("v")).alias("s"))
    want = {v: con.execute("SELECT printf('%+.4f', ?::DOUBLE)", [v]).fetchall()[0][0] for v in values}
    assert dict(rows.collect()) == {**want, None: None}


def test_sorted_entries_are_written_in_small_rows(spark, monkeypatch):
    seen, written = [], replicates.written
    monkeypatch.setattr(replicates, "written", lambda df: seen.append(written(df)) or seen[-1])
    units = spark.range(1500).select(F.col("id").alias("u"), (F.col("id") % 7).cast("double").alias("v"))
    made = replicates.permuted(units, "u", "v", [], 200, spatial._order(1))
    rows = made.limit(3).collect()
    assert len(rows) == 3 and all(len(r.v) == 8 * 200 for r in rows)
    largest = [df.agg(F.max(F.length("entries"))).first()[0] for df in seen if "entries" in df.columns]
    assert largest and max(largest) < 1 << 20


def test_random_points_are_drawn_by_many_tasks(spark, monkeypatch):
    seen, written = [], geo.written
    monkeypatch.setattr(geo, "written", lambda df: seen.append(df.rdd.getNumPartitions()) or written(df))
    shapes_ = spark.createDataFrame([(i, box(float(i), 0.0, 1.0)) for i in range(40)], f"u long, rings {shapes.RINGS}").coalesce(1)
    made = geo.random_points(shapes_, "u", "rings", 3).collect()
    assert seen[0] >= 4 and {(r.u, r.place) for r in made} == {(i, j) for i in range(40) for j in range(3)}
    assert all(r.u <= r.x <= r.u + 1 and 0 <= r.y <= 1 for r in made)


def test_draws_and_orders_are_hashed_by_many_tasks(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(replicates, "_moved", lambda df, *a, real=replicates._moved: moved.append(df.rdd.getNumPartitions()) or real(df, *a))
    units = spark.range(50).select(F.col("id").alias("u"), F.col("id").cast("double").alias("z")).coalesce(1)
    drawn = lambda b, i, n: (b * 7 + i * 3) % n
    w = {r.u: np.frombuffer(r.w, np.int16) for r in replicates.draw_weights(units, "u", 5, drawn).collect()}
    assert all(sum(w[u][b] for u in w) == 50 and w[u][b] == sum((b * 7 + i * 3) % 50 == u for i in range(50)) for u in w for b in range(5))
    replicates.permuted(units, "u", "z", [], 3, lambda b, u: geo.hashed_unit(F.lit(1), b, u)).count()
    assert min(moved[:2]) >= 4 * spark.sparkContext.defaultParallelism
