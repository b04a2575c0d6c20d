import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from areasignal.llm import simhash


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reached(ids, fps, bits=4):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_fingerprints():
    for t in (None, "", " \t", "one", "A b C", "x y z w", "Ä ä Wort\x85wort mehr Worte hier", "the cat sat on the mat " * 40):
        assert simhash.fingerprint(t) == brute(t)


def test_every_link_meets_at_an_anchor():
    rnd = random.Random(5)
    a = [rnd.getrandbits(64) for _ in range(400)] + [0, 2**64 - 1]
    b = [x ^ sum(1 << i for i in rnd.sample(range(64), k % 5)) for k, x in enumerate(a)]
    sets = []
    for side in (a, b):
        keys, owner = simhash.anchors(np.array(side, np.uint64))
        sets.append([set(keys[owner == i].tolist()) for i in range(len(side))])
    assert all(x & y for x, y in zip(*sets))
    assert max(map(len, sets[0])) <= 34


def test_components_against_brute_force(spark):
    rnd = random.Random(3)
    fps = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        fps.append(x)
        for _ in range(rnd.randrange(12)):  # chains of links
            x ^= sum(1 << i for i in rnd.sample(range(64), rnd.randrange(1, 5)))
            fps.append(x)
    centre = rnd.getrandbits(64)
    fps += [centre ^ (1 << i) ^ (1 << j) for i in range(0, 20) for j in range(20, 26)]  # one large run at an anchor
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    ids = sorted(set(fps))
    want = reached(ids, ids)
    named = {}
    for f, w in zip(ids, want):
        key = int(np.uint64(f).astype(np.int64))
        named.setdefault(w, set()).add(roots.get(key, key))
    assert all(len(x) == 1 for x in named.values())
    assert len({next(iter(x)) for x in named.values()}) == len(named)


def test_edge_rows(docs, none):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [brute(r.text) for r in rows]
    want = sorted(((r.doc_id, f, c) for r, f, c in zip(rows, fps, reached([r.doc_id for r in rows], fps))), key=str)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.without_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == 7 and texts.count("short") == 1  # of nine texts, two are copies and three empty
    assert simhash.without_duplicates(none).collect() == []


def shingles5(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_edited_copies_are_grouped_and_others_left_alone(spark):
    rnd = random.Random(8)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(5000)]
    rows, likeness = [], {}
    for i in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randrange(60, 500))]
        rows.append((10 * i, " ".join(text)))
        copy = list(text)
        for _ in range(rnd.randrange(0, 1 + len(text) // 50)):
            copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
        rows.append((10 * i + 1, " ".join(copy)))
        a, b = shingles5(rows[-2][1]), shingles5(rows[-1][1])
        likeness[10 * i + 1] = len(a & b) / len(a | b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    near = [i for i, x in likeness.items() if x >= 0.8]
    assert len(near) > 60 and sum(got[i] == i - 1 for i in near) >= 0.98 * len(near)
    assert all(got[i] == i for i, _ in rows if i % 10 == 0)  # no text is taken for a copy of an earlier one
    kept = {r.doc_id for r in simhash.without_duplicates(df).collect()}
    assert kept == set(got.values())


def test_large_group_of_edited_copies(spark):
    rnd = random.Random(9)
    text = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        copy = list(text)
        for _ in range(4):
            copy[rnd.randrange(300)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.similar_groups(df).collect()} == {0}


def test_hex(spark):
    assert spark.range(1).select(simhash.hex64(F.lit(-2))).first()[0] == "fffffffffffffffe"


def test_cut_and_extended_copies_by_exact_similarity(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(0, 1200, 2):
        text = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(20, 300))]
        share = rnd.uniform(0.5, 0.98)  # below 0.8 the two aren't near duplicates, from there on they are
        cut = text[: int(len(text) * share)] if i % 4 else text + [f"y{rnd.randrange(10**6)}" for _ in range(int(len(text) * (1 / share - 1)))]
        rows += [(i, " ".join(text)), (i + 1, " ".join(cut))]
        a, b = shingles5(rows[-2][1]), shingles5(rows[-1][1])
        want[i], want[i + 1] = i, i if len(a & b) >= 0.8 * len(a | b) else i + 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == want
    assert {r.doc_id for r in simhash.without_duplicates(df).collect()} == set(want.values())


def test_large_groups_against_brute_force(spark):
    rnd = random.Random(12)
    texts = []
    for size, edits in ((120, 2), (120, 5), (60, 9)):  # near copies of which many pairs lie below 0.8
        base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(copy))
    sets = [shingles5(t) for t in texts]
    least = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if least[i] != least[j] and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((least[i], least[j]))
                least = [x if z == y else z for z in least]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == dict(enumerate(least))


def test_clashing_names(docs):
    names = ("__id", "__body", "__key", "__name", "__text", "fp", "keys")
    out = simhash.without_duplicates(docs.select("doc_id", "text", *(F.lit("mine").alias(c) for c in names)))
    assert out.columns == ["doc_id", "text", *names] and {tuple(r)[2:] for r in out.collect()} == {("mine",) * len(names)}


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_long_runs_at_an_anchor(spark, monkeypatch, most):
    """Held in one task or dealt anew: many fingerprints that share a half, some of which chain within 4 bits in the other one."""
    monkeypatch.setattr(simhash, "LONG_RUN", most)
    rnd = random.Random(6)
    half, fps = rnd.getrandbits(32) << 32, set()
    for _ in range(150):
        x = rnd.getrandbits(32)
        fps.add(half | x)
        for _ in range(rnd.randrange(3)):
            x ^= sum(1 << i for i in rnd.sample(range(32), rnd.randrange(1, 5)))
            fps.add(half | x)
    ids = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in ids]
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    named = {}
    for f, w in zip(signed, reached(ids, ids)):
        named.setdefault(w, set()).add(roots.get(f, f))
    assert all(len(x) == 1 for x in named.values()) and len({next(iter(x)) for x in named.values()}) == len(named)


def test_parts_of_long_runs(spark, monkeypatch):
    """A run split into many parts gives the components that all pairs give."""
    monkeypatch.setattr(simhash, "PART", 16)
    rnd = random.Random(14)
    base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
    texts = []
    for edits in [1] * 60 + [4] * 60:
        copy = list(base)
        for _ in range(edits):
            copy[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    sets, least = [shingles5(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if least[i] != least[j] and len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((least[i], least[j]))
                least = [x if z == y else z for z in least]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()} == dict(enumerate(least))
