import zlib

import numpy as np
from pyspark.sql import functions as F

from areasignal.llm import quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([q == r.predicted for q, r in held]) > 0.95
    good, bad = ([r.score for q, r in held if q == x] for x in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.in_fold(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, turned)


def test_columns_score_as_the_rules_do(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    model = quality.fit_rules(x, y)
    assert 0 < len(model.rules) <= 64
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATS))
    got = np.array([r[0] for r in df.select(model.score()).collect()])
    assert np.allclose(got, model.predict(x))
    assert ((got > 0.5) == y).mean() > 0.97


def plain_statistics(text):
    """The statistics counted one by one, byte by byte."""
    raw = (text or "").encode()
    if not raw:
        return (0.0,) * len(quality.STATS)
    chars = [chr(b) for b in raw]
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()] or [b""]
    count = lambda test: sum(map(test, chars))
    upper, digit, space = (lambda c: "A" <= c <= "Z"), (lambda c: "0" <= c <= "9"), (lambda c: c in " \t\n\v\f\r")
    letter = lambda c: upper(c) or "a" <= c <= "z" or ord(c) >= 128
    n, w, k = len(raw), max(1, len(words)), len(lines)
    lengths = [len(x) for x in lines]
    mean = sum(lengths) / k
    spread = (sum((x - mean) ** 2 for x in lengths) / k) ** 0.5
    return (
        len(text), len(words), k, (n - count(space)) / w, count(letter) / n, count(upper) / max(1, count(letter)), count(digit) / n, count(space) / n, count(lambda c: c in "#$%&*+<=>@\\^_`{|}~") / n, count(lambda c: c in ".,;:?!") / n,
        count(lambda c: c == "|") / w, count(lambda c: c == "!") / w, sum(chr(x[-1]) in "#$%&*+<=>@\\^_`{|}~!" for x in words) / w, 1 - len(set(lines)) / k, 1 - len(set(words)) / w, max(map(lines.count, lines)) / k if k > 1 else 0.0, mean, spread / max(1.0, mean),
        sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / k, sum(len(x) < 3 for x in words) / w,
    )


def test_scores_against_brute_force(spark):
    """Each document's score from its statistics counted one by one and its rules tested one by one."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) <= 64
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    for r in docs.collect():
        stats, z = plain_statistics(r.text), model.bias
        for rule in model.rules:
            if all(stats[j] > t if above else stats[j] <= t for j, above, t in rule.tests):
                z += rule.weight
        score = 1 / (1 + np.exp(-z))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)


def test_weights_are_the_lasso_optimum():
    """Conditions of the optimum: no gradient of a kept rule's weight but the penalty's, against its sign; none of the bias."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.STATS)))
    y = (rng.random(3000) < 1 / (1 + np.exp(-6 * ((x[:, 1] > 0.4) & (x[:, 2] > 0.3)) + 3))).astype(float)
    penalty = 1e-3
    model = quality.fit_rules(x, y, penalty=penalty)
    left = model.predict(x) - y
    assert abs(left.mean()) < 2e-3
    for rule in model.rules:
        gradient = float((rule.fires(x) * left).mean()) - float(rule.fires(x).mean() * left.mean())
        assert abs(gradient + np.sign(rule.weight) * penalty / 10) < 5e-4, (gradient, rule.weight)


def test_one_class_and_none():
    x = np.zeros((5, len(quality.STATS)))
    assert quality.fit_rules(x, np.ones(5)).predict(x)[0] > 0.5
    assert quality.fit_rules(x[:0], np.ones(0)).predict(x)[0] == 0.5


def test_edge_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, None), (None, 1), (8, 0), (8, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score_quality(none, model).collect() == []
    assert quality.train(none, labels).rules == () and quality.train(docs, labels.limit(0)).rules == ()
    assert quality.kept(docs, model).columns == docs.columns
    assert quality.kept(docs, quality.RuleEnsemble((), 3.0)).count() == 11
    assert quality.statistics(None) == quality.statistics("") == (0.0,) * len(quality.STATS)
