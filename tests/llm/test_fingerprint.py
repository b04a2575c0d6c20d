import hashlib
import random

import numpy as np

from areasignal.llm import fingerprint as fp

WORDS = [f"w{i}" for i in range(3000)]


def sets(text):
    w = text.lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def made(text):
    return fp.fingerprint(fp.shingles(text))


def test_likeness_is_unbiased():
    rnd, errors = random.Random(1), []
    for k in range(120):
        n = rnd.choice([3, 6, 12, 60, 400])
        a = [rnd.choice(WORDS) for _ in range(n)]
        b = list(a)
        for _ in range(rnd.randrange(0, max(1, n // 8) + 1)):
            b[rnd.randrange(n)] = rnd.choice(WORDS)
        x, y = " ".join(a), " ".join(b)
        errors.append((n, fp.likeness(made(x), made(y)) - jaccard(sets(x), sets(y))))
    all_, large = (np.array([e for n, e in errors if n >= least]) for least in (0, 60))
    assert abs(all_.mean()) < 0.02 and np.abs(all_).mean() < 0.04
    assert np.abs(large).max() < 0.12  # a dozen shingles fill few bins, so single estimates are wider there


def test_texts_of_one_shingle_do_not_agree_by_chance():
    prints = [made(f"only {i}") for i in range(80)]
    assert max(fp.likeness(prints[i], prints[j]) for i in range(80) for j in range(i)) < 0.2


def test_equal_and_empty():
    assert fp.packed(made("A b c")) == fp.packed(made("a  B\tc")) and len(fp.packed(made("x"))) == fp.BINS
    assert fp.packed(made("")) == "0" * fp.BINS
    assert fp.likeness(made(""), made("")) == 1.0 and fp.likeness(made(""), made("a")) == 0.0
    assert fp.edited("abcde", "xyz") == "abcxy" and fp.edited("abcdef", "x") == "abcx" and fp.edited("", "x") == ""


def test_rows_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i * 3 - 50, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 40)))) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        new, r = fp.edited(text, following), got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == fp.packed(made(text)) and r.edited_fingerprint == fp.packed(made(new))
        assert r.near_edited == fp.likeness(made(text), made(new)) and r.near_next == fp.likeness(made(text), made(following))


def test_edge_rows(spark, docs, none):
    got = fp.fingerprints(docs).collect()
    assert len(got) == 11 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.doc_id) for r in docs.collect())
    first, last = texts[0], texts[-1]
    assert by[last[1]].edited_sha256 == hashlib.sha256(fp.edited(last[0][2], first[0][2]).encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(fp.edited(first[0][2], texts[1][0][2]).encode()).hexdigest()
    assert fp.fingerprints(none).collect() == []
    one = fp.fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
