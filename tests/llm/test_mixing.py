import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from areasignal.llm import mixing


def water(sizes, weights, most=3.0):
    """Targets by taking off what is above its bound, again and again."""
    left, total, out = set(sizes), float(sum(sizes.values())), {}
    while left:
        level = total / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > most * sizes[s]}
        for s in over or left:
            out[s] = most * sizes[s] if over else level * weights[s]
        if not over:
            break
        total -= sum(most * sizes[s] for s in over)
        left -= over
    return out


def check(rows, got):
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    want = water({s: size[s] for s in size if size[s]}, {s: 1.0 + i % 3 for i, s in enumerate(order)})
    taken, largest = Counter(), defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want.get(r.source, 0)) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.n * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want.get(s, 0)) <= largest[s] + 1e-6


def test_targets_and_reruns(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(1, 60), f"s{rnd.choice([0] * 6 + list(range(9)))}") for i in range(6000)] + [(9000, "one two", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    check(rows, got)
    again = mixing.copies(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_pivot_keeps_the_weighted_sum():
    rnd = random.Random(2)
    for _ in range(200):
        size = [rnd.randrange(1, 50) for _ in range(30)]
        mass = [rnd.random() for _ in range(30)]
        before = sum(s * m for s, m in zip(size, mass))
        left = mixing.pivot(mass, size, [rnd.random() for _ in range(30)])
        assert all(m in (0.0, 1.0) or i == left for i, m in enumerate(mass))
        assert abs(sum(s * m for s, m in zip(size, mass)) - before) < 1e-6


def test_settling_keeps_the_weighted_sum_and_leaves_a_small_one():
    rnd = random.Random(7)
    for _ in range(200):
        n = rnd.randrange(20, 60)
        size = [rnd.randrange(1, 20) for _ in range(n)] + [rnd.randrange(60, 100)]
        mass = [rnd.uniform(0.2, 0.8) for _ in size]
        before = sum(s * m for s, m in zip(size, mass))
        left = mixing.settled(mass, size, [rnd.random() for _ in size])
        assert all(m in (0.0, 1.0) or i == left for i, m in enumerate(mass))
        assert abs(sum(s * m for s, m in zip(size, mass)) - before) < 1e-6 and (left < 0 or size[left] < 20)


def test_settling_keeps_expectations():
    rnd, n = random.Random(5), 4000
    p, size, sums = [0.2, 0.7, 0.5, 0.9, 0.35, 0.6, 0.4], [3, 8, 1, 5, 19, 2, 2], [0.0] * 7
    for _ in range(n):
        mass = list(p)
        mixing.settled(mass, size, [rnd.random() for _ in p])
        sums = [a + b for a, b in zip(sums, mass)]
    assert all(abs(s / n - q) < 0.04 for s, q in zip(sums, p))


def test_the_last_one_is_made_up_for():
    rnd = random.Random(9)
    for _ in range(300):
        size = [rnd.randrange(1, 30) for _ in range(30)] + [2000]
        mass = [0.08] * 31
        before = sum(s * m for s, m in zip(size, mass))
        left = mixing.settled(mass, size, [rnd.random() for _ in size])
        if left >= 0:
            mixing.ended(mass, size, left, rnd.random())
        assert set(mass) <= {0.0, 1.0} and abs(sum(s * m for s, m in zip(size, mass)) - before) <= 30


def test_sources_come_near_their_targets(spark):
    """Sizes that differ much: no source misses its target by 2 in 100, though one document may have a third of it."""
    rnd = random.Random(8)
    rows = [(i, "w " * int(20 * rnd.paretovariate(1.1)), f"s{i % 7}") for i in range(700)] + [(9000 + k, "w " * 4000, f"s{k}") for k in range(7)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.02 * t for s, t in target.items())


def test_pivot_keeps_expectations():
    rnd, n = random.Random(4), 4000
    p, size, sums = [0.2, 0.7, 0.5, 0.9, 0.35], [3, 8, 1, 5, 9], [0.0] * 5
    for _ in range(n):
        mass = list(p)
        mixing.pivot(mass, size, [rnd.random() for _ in p])
        sums = [a + b for a, b in zip(sums, mass)]
    assert all(abs(s / n - q) < 0.04 for s, q in zip(sums, p))


def test_edge_rows(docs, none):
    got = mixing.copies(docs).collect()
    assert len(got) == 11
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    assert mixing.copies(none).collect() == [] and mixing.mixed(none).collect() == []
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.id] += r.n
    assert Counter(r.doc_id for r in mix.collect()) == +want
    assert mix.where(F.col("doc_id") == 6).count() == want[6]


def test_clashing_names(docs):
    names = ("__id", "__body", "__n", "__rows", "__key", "__copy", "mass", "node")
    out = mixing.mixed(docs.select("doc_id", "text", "source", *(F.lit("mine").alias(c) for c in names)))
    assert out.columns == ["doc_id", "text", "source", *names] and {tuple(r)[3:] for r in out.collect()} == {("mine",) * len(names)}


def test_repeated_rows_are_one_item(spark):
    rows = [(1, "a b c", "s")] * 500 + [(2, "d e", "s"), (3, "f", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(df).collect()
    check(rows, got)
    n = [r.n for r in got if r.id == 1]
    assert len(n) == 500 and max(n) - min(n) <= 1
