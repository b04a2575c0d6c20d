"""Boosted trees against an independent fit that looks for splits among rows, and against jobs."""

import math

import numpy as np
import pytest

from areasignal.operators import boosting as B


def frame(spark, n=300, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    y = np.round(np.stack([2 * (x[:, 0] > 0) + x[:, 1] + rng.normal(size=n) / 4, np.sin(2 * x[:, 2]) - x[:, 0] * (x[:, 3] > 0.5)], 1), 3)
    rows = [(i, i % 3, *(None if i % 41 == 0 and j == 1 else float(v) for j, v in enumerate(x[i])), *map(float, y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, fold int, " + ", ".join(f"x{j} double" for j in range(d)) + ", a double, b double"), rows


def independent(rows, d, t, fold, s, early, cuts):
    """Plain leaf-wise boosting of one model over rows: each split from all cuts, errors in doubles."""
    train = [r for r in rows if r[1] != fold]
    grow, aside = [r for r in train if not early[r[0]]], [r for r in train if early[r[0]]]
    y = lambda r: r[2 + d + t]
    key = lambda r, j: -math.inf if r[2 + j] is None else r[2 + j]
    base = sum(map(y, train)) / len(train)
    score = {r[0]: base for r in rows}
    errors, best, kept = [sum((score[r[0]] - y(r)) ** 2 for r in aside)], 0, dict(score)
    for round_ in range(s.rounds):
        leaves = [grow]
        score_of = lambda p: sum(score[r[0]] - y(r) for r in p) ** 2 / (len(p) + s.l2)

        def split(p):
            found = None
            for j in range(d):
                for v in [-math.inf, *cuts[j]]:
                    left, right = [r for r in p if key(r, j) <= v], [r for r in p if key(r, j) > v]
                    if min(len(left), len(right)) >= s.least:
                        gain = score_of(left) + score_of(right) - score_of(p)
                        if gain > 1e-10 and (found is None or gain > found[0] + 1e-9):
                            found = gain, left, right, j, v
            return found

        paths, options = [[]], [split(grow)]
        while len(leaves) < s.leaves and any(options):
            i = max((o[0], -k) for k, o in enumerate(options) if o)[1] * -1
            _, left, right, j, v = options[i]
            leaves[i : i + 1], paths[i : i + 1], options[i : i + 1] = [left, right], [paths[i] + [(j, v, True)], paths[i] + [(j, v, False)]], [split(left), split(right)]
        values = [-sum(score[r[0]] - y(r) for r in p) / (len(p) + s.l2) * s.rate for p in leaves]
        for r in rows:
            score[r[0]] += next(v for p, v in zip(paths, values) if all((key(r, j) <= c) == go for j, c, go in p))
        errors.append(sum((score[r[0]] - y(r)) ** 2 for r in aside))
        if errors[-1] < errors[best]:
            best, kept = round_ + 1, dict(score)
        if round_ + 1 - best >= s.patience:
            break
    return {r[0]: kept[r[0]] for r in rows if r[1] == fold}, best


@pytest.fixture(scope="module")
def settings():
    return B.Settings(rounds=60, rate=0.2, leaves=6, least=10, features=1.0, rows=1.0, patience=8)


def test_same_as_an_independent_fit(spark, settings):
    df, rows = frame(spark)
    made = B.fitted(df, "id", "fold", ["x0", "x1", "x2", "x3"], ["a", "b"], settings)
    aside = {r.unit: r.aside for r in B.binned(df, "id", "fold", ["x0", "x1", "x2", "x3"], ["a", "b"], settings).rows.collect()}
    got = {r.id: (r.pred_a, r.pred_b) for r in made.predict(df, "id", "fold", ["x0", "x1", "x2", "x3"]).collect()}
    stopped = {(m.fold, m.target): len(m.trees) for m in made.models}
    for fold in range(3):
        for t in range(2):
            want, rounds = independent(rows, 4, t, fold, settings, aside, made.cuts)
            assert stopped[fold, t] == rounds and 0 < rounds
            assert all(abs(got[i][t] - v) < 1e-5 for i, v in want.items())
    assert any(n < settings.rounds for n in stopped.values())


def test_jobs_and_tasks_grow_the_same_trees(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP_ROUNDS", 2)
    df, _ = frame(spark, 200)
    s = B.Settings(rounds=5, rate=0.3, leaves=5, least=8, bins=20, patience=4)
    a = B.fitted(df, "id", "fold", ["x0", "x1", "x2", "x3"], ["a", "b"], s)
    b = B.fitted(df.repartition(5), "id", "fold", ["x0", "x1", "x2", "x3"], ["a", "b"], s, local_bytes=0)
    assert [B._packed(0, m) for m in a.models] == [B._packed(0, m) for m in b.models] and any(m.trees for m in a.models)


def test_each_model_has_a_task_of_its_own(spark):
    df, _ = frame(spark, 200)
    s = B.Settings(rounds=2, least=8)
    data = B.binned(df, "id", "fold", ["x0", "x1"], ["a", "b"], s)
    spark.sparkContext.setJobGroup("own tasks", "")
    assert len(B._fitted_in_tasks(data, B._models(data, 2, s), s)) == 6
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(i) for j in status.getJobIdsForGroup("own tasks") for i in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 6 in [x.numTasks for x in stages if x]


def test_sums_of_large_gradients_are_whole(spark):
    """Two gradients of 2**52 and many of 1 add up to more than doubles count one by one."""
    n, big = 4000, 2.0**52
    y = np.concatenate([[-big, -big], np.full(n - 2, -1.0)])[:, None]
    m = B.Model(1, 0, 0.0, 1.0)
    rows = np.zeros(n, int), np.arange(n), np.zeros(n, bool), np.ones((n, 1), np.int16), y
    _, totals = B._Growing(m, B.Settings(rows=1.0), big, *rows).evaluate([(0, [0])], True)
    assert totals[0][0] == 2**53 + n - 2
    growing = B._Growing(m, B.Settings(rows=1.0), big, *rows)
    growing.evaluate([(0, [0])], True)
    assert int(growing.sums[0][0][0, 1]) == 2**53 + n - 2


def test_saved_and_loaded(spark, tmp_path):
    df, _ = frame(spark, 120)
    a = B.fitted(df, "id", "fold", ["x0", "x1"], ["a"], B.Settings(rounds=4, least=5))
    a.save(spark, str(tmp_path))
    b = B.Boosted.load(spark, str(tmp_path))
    rows = lambda m: sorted(map(tuple, m.predict(df, "id", "fold", ["x0", "x1"]).collect()))
    assert rows(a) == rows(b) and b.targets == ["a"]


def test_edge_rows(spark):
    shape = "id long, fold int, x0 double, x1 double, a double"
    fit = lambda rows: sorted(map(tuple, B.boosted_oof(spark.createDataFrame(rows, shape), "id", "fold", ["x0", "x1"], ["a"], B.Settings(rounds=3, least=1)).collect()))
    assert fit([]) == []
    only = fit([(1, 0, 1.0, None, 2.0), (2, 0, None, None, 3.0)])
    assert [r[0] for r in only] == [1, 2]
    mixed = fit([(i, i % 2, None if i % 3 else float(i), 1.0, None if i % 7 == 0 else float(i % 5)) for i in range(40)])
    assert len(mixed) == 40 and all(math.isfinite(r[2]) for r in mixed)
