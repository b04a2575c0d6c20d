import hashlib
import math
from fractions import Fraction

import numpy as np

from areasignal.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, error string"


def brute(rows, entries=256, rounds=4):
    keep = [(i, [math.floor(1024 * Fraction(float(np.float32(x)))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in keep), default=0) // 4) * 4
    size = width // 4
    keep = [(i, v + [0] * (width - len(v)), l) for i, v, l in keep]
    order = sorted(range(len(keep)), key=lambda r: (keep[r][0] is None, keep[r][0] or 0, keep[r][1]))[:entries]
    parts = [[v[p * size : (p + 1) * size] for _, v, _ in keep] for p in range(4)]
    books = [[parts[p][r] for r in order] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            of = [nearest(x, books[p])[1] for x in parts[p]]
            for k in range(len(books[p])):
                mine = [x for x, o in zip(parts[p], of) if o == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[nearest(x, books[p]) for p in range(4) for x in [parts[p][r]]] for r in range(len(keep))]
    errors = [sum(d for d, _ in row) for row in last]
    most = (1 << 63) - 1
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = {l: min(most, sum(min(most, e) for e, (_, _, m) in zip(errors, keep) if m == l)) for _, _, l in keep}
    return sorted(((i, "".join(f"{k:02x}" for _, k in row), min(most, e), by[l], digest) for (i, _, l), row, e in zip(keep, last, errors)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, l, "i", "c", "e") for i, v, l in rows], SCHEMA)
    return sorted((tuple(r) for r in V.codes(df).collect()), key=repr)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8)) / 4
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=8) / 16], None if i % 3 else i % 7) for i in range(700)]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(V, "ENTRIES", 24)
    tied = rows[:200] + [(1000 + i, [0.25 * (i % 3)] * 8, 1) for i in range(50)]
    assert run(spark, tied) == brute(tied, 24)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (2, None, 1), (3, [nan, 1.0], None), (4, [inf], 2), (5, [None, 1.0], 2), (6, [], None), (None, [0.5, -0.1], None), (7, [-0.3] * 6, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    assert run(spark, [(1, [], None), (2, [], None)]) == brute([(1, [], None), (2, [], None)])


def test_components_of_any_size(spark):
    rows = [(1, [1e30, -1e20, 3.0, 0.5], 1), (2, [3e38, 2.0, -1e9, 1.0], 1), (3, [1e-30, 7e6, 2.0, 1.0], None), (4, [3e12, 1e12, 5.0, 1.0], None), (5, [40000.5, 1.0, 2.0, 3.0], None)]
    assert run(spark, rows) == brute(rows)


def test_bounds_leave_out_groups_and_nothing_else():
    rng = np.random.default_rng(2)
    points = np.floor(1024 * np.repeat(rng.normal(size=(40, 16)), 60, 0) + rng.normal(size=(2400, 16)) * 20)
    entries = points[:: 2400 // 256][:256].copy()
    groups = V.grouped(entries)
    a = V.Assigner(entries, groups)
    code, least, low = a.first(points)
    for _ in range(4):
        before, entries = entries, np.array([np.floor(points[code == k].mean(0)) if (code == k).any() else e for k, e in enumerate(entries)])
        a = V.Assigner(entries, groups, before)
        code, least, low = a.again(points, code, low)
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (least == d.min(1)).all()
        assert a.scanned < 0.6 * d.size
        others = np.sqrt(np.where(np.arange(len(entries))[None] == code[:, None], np.inf, d))
        assert all((low[:, g] <= others[:, groups == g].min(1)).all() for g in range(groups.max() + 1))


def test_decoded():
    books = [np.array([[1024.0], [512.0]])] * 4
    assert V.decoded("00010001", books) == [1.0, 0.5, 1.0, 0.5]
