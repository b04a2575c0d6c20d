import numpy as np

from areasignal.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, id string, n string"


def brute(rows, k, every):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, []).append([int(np.floor(64 * float(np.float32(x)))) for x in v])
    out = []
    for i in q:
        if i % every == 0:
            for v in {tuple(x) for x in q[i]}:
                scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j in q if j != i for w in q[j])
                out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, "s", 1, "i", "n") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, k, every).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8)) * 2
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=8))]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # ties
    assert run(spark, rows) == brute(rows, 20, 20)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SHARD", 512)  # several shards of about 64 vectors
    assert run(spark, rows) == brute(rows, 20, 20)


def test_edge_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [nan, 1.0]), (60, [float("inf"), 1.0]), (80, [None, 1.0]), (100, []), (120, [0.5]), (None, [1.0, 1.0]), (3, [-1.0, 0.3, 5.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows, 20, 20)
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []
    assert run(spark, [(20, [1.0]), (1, [2.0])]) == [(20, 1, 1, 8192)]


def test_components_of_any_size(spark):
    big = [(0, [1e30, -1e20, 3.0]), (20, [1e30, 2.0, -1e9]), (1, [1e-30, 7.0, 2.0]), (2, [3e12, 1e12, 5.0]), (3, [-1e38, 1.0, 1.0])]
    most = (1 << 63) - 1
    near = {(q, i): max(-most - 1, min(most, s)) for q, _, i, s in brute(big, 20, 20)}
    want = [(q, r + 1, i, -s) for q in (0, 20) for r, (s, i) in enumerate(sorted((-s, i) for (a, i), s in near.items() if a == q))]
    assert run(spark, big) == want


def test_stops_on_proof():
    """A vector ahead of all others by its largest components is proven before the small ones are added."""
    rng = np.random.default_rng(3)
    q = np.rint(rng.normal(size=(4000, 16)))
    q[:30] *= 50
    index, seen = topk.Index(np.arange(4000), q), []
    best = topk.Index._best
    query = q[:1].copy()
    index._best = lambda rows, x, k: seen.append(len(rows)) or best(index, rows, x, k)
    (ids, scores), = index.search(query, np.array([0]), 5)
    exact = q @ query[0]
    exact[0] = -np.inf
    assert scores == sorted(exact.tolist(), reverse=True)[:5] and seen[0] < 400
    lists = [v for segment in index.segments for v in segment]
    assert sum(len(at) for _, at, _ in lists) == np.count_nonzero(q)
