"""Sinks that are stopped between two steps lose and mix nothing; quantiles and boxes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areasignal.operators import spatial, tables
from areasignal.sources import records


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", [1, 2])
def test_replacement_stopped_between_renames(spark, tmp_path, monkeypatch, step):
    at, rows = str(tmp_path / "t"), lambda v: spark.range(3).select(F.lit(v).alias("v"))
    read = lambda: {r.v for r in spark.read.schema("v int").json(at).collect()}
    records.replace(rows(1), at)
    real, calls = records._renamed, []

    def renamed(*args):
        calls.append(args)
        if len(calls) == step:
            raise Stop
        real(*args)

    monkeypatch.setattr(records, "_renamed", renamed)
    with pytest.raises(Stop):
        records.replace(rows(2), at)
    monkeypatch.setattr(records, "_renamed", real)
    records.recovered(spark, at)
    assert read() == ({1} if step == 1 else {2})
    records.replace(rows(3), at)
    assert read() == {3} and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()


def test_old_table_comes_back_if_the_new_one_is_not_whole(spark, tmp_path):
    at = tmp_path / "t"
    records.replace(spark.range(2).select(F.lit(1).alias("v")), str(at))
    at.rename(tmp_path / "t.old")
    (tmp_path / "t.new").mkdir()  # a write that failed
    records.recovered(spark, str(at))
    assert spark.read.schema("v int").json(str(at)).count() == 2 and not (tmp_path / "t.old").exists()


def test_cache_stopped_after_its_rows(spark, tmp_path, monkeypatch):
    """Rows of new settings never pass for those of the old."""
    at, wanted = str(tmp_path / "cache"), spark.range(4).select("id")
    made = lambda mark: lambda w: w.withColumn("mark", F.lit(mark))
    records.cached(at, wanted, "id", {"m": 1}, made("one"))
    monkeypatch.setattr(records, "write_summary", lambda *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):
        records.cached(at, wanted, "id", {"m": 2}, made("two"))
    monkeypatch.undo()
    found, used = records.cached(at, wanted, "id", {"m": 1}, made("one again"))
    assert not used and {r.mark for r in found.collect()} == {"one again"}


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 501), (None, 40)) for v in rng.integers(0, 60, n)] + [("c", 7.0)] * 900 + [("c", None), ("d", None), ("c", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"low": 0.0, "some": 0.025, "mid": 0.5, "more": 0.9, "high": 1.0}
    got = {r.k: [r[n] for n in shares] for r in tables.quantiles(df, "v", shares, ["k"]).collect()}
    want = {k: np.quantile([v for j, v in rows if j == k and v is not None and v == v], list(shares.values())) for k in ("a", "b", "c", None)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    whole = tables.quantiles(df, "v", shares).first()
    assert np.allclose(list(whole), np.quantile([v for _, v in rows if v is not None and v == v], list(shares.values())))
    assert tables.quantile_bounds(df.where("v < 0"), "v") == []


def test_boxes_that_meet(spark):
    rng = np.random.default_rng(2)
    box = lambda n: [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in rng.integers(0, 30, (n, 4)) * [1, 1, 0.1, 0.1]]
    a, b = box(60), box(25)
    frame = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, box struct<min_x double, min_y double, max_x double, max_y double>")
    got = {r.id: r.met for r in spatial.meeting(frame(a), frame(b + b[:3]), "id", 2.0).collect()}
    assert got == {i: any(p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3] for q in b) for i, p in enumerate(a)}


def test_spacing_in_rounds_is_the_sequential_rule(spark, monkeypatch):
    """One unit has nearly all points; rounds of few candidates give what one pass gives."""
    import math

    monkeypatch.setattr(spatial, "HEAD", 3)
    rng = np.random.default_rng(5)
    rows = [(0 if i % 40 else 1 + i % 3, int(k), 55.8 + float(a), -4.3 + float(b)) for i, (k, a, b) in enumerate(zip(rng.permutation(900), rng.random(900) / 10, rng.random(900) / 10))]
    rows += [(0, 5000, 55.85, -4.25), (0, 5000, 55.85, -4.25), (9, 1, None, 1.0)]

    def metres(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))

    for most, apart in ((5, 900.0), (60, 700.0), (1000, 400.0)):
        want = {}
        for p in sorted(r for r in rows if r[2] is not None):
            mine = want.setdefault(p[0], [])
            if len(mine) < most and all(metres(a, p) >= apart for a in mine):
                mine.append(p)
        df = spark.createDataFrame(rows, "u int, k int, lat double, lon double").repartition(5)
        got = {r.u: [x.k for x in r.accepted] for r in spatial.spaced(df, "u", "k", apart, most).collect()}
        assert got == {u: [p[1] for p in ps] for u, ps in want.items()}
