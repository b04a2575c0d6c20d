import math
import zlib
from collections import Counter

import numpy as np

from areasignal.llm import langid


def brute(train, text):
    """Bits of a text under one language's tree, from counts kept whole."""
    counts = {}
    for t in train:
        raw = b"   " + langid.folded(t).tobytes()
        for i in range(3, len(raw)):
            for k in range(4):
                counts.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    raw, total = b"   " + langid.folded(text).tobytes(), 0.0
    for i in range(3, len(raw)):
        bits, k = 0.0, 3
        while k >= 0:
            c = counts.get(raw[i - k : i])
            if c:
                n, d = sum(c.values()), len(c)
                if raw[i] in c:
                    bits += math.log2((n + d) / c[raw[i]])
                    break
                bits += math.log2((n + d) / d)
            k -= 1
        else:
            bits += 8.0
        total += bits
    return total


def built(texts, docs):
    rows = [(lang, g, n) for lang, grams, times in langid._grams(texts) for g, n in zip(grams.tolist(), times.tolist())]
    return langid.build([r[0] for r in rows], *(np.array([r[i] for r in rows], np.int64) for i in (1, 2)), docs)


def test_code_lengths_against_brute_force():
    train = {"a": ["the cat sat on the mat", "the hat and the cat", "once"], "b": ["le chat est sur le tapis", "la tête du chat", "кот сидит", "猫は座る"]}
    trees = built([(lang, t) for lang in train for t in train[lang]], {"a": 2, "b": 2})
    for text in ("the cat", "le chat la", "zzz", "", "Cat THE 42", "кот и пёс", "\x00\x7f", "on the on the mat"):
        got = (trees.lengths([text])[0] - trees.prior) / langid.UNITS
        want = [brute(train[x], text) for x in ("a", "b")]
        assert np.allclose(got, want, atol=0.01 * max(1, len(text.encode()))), (text, got, want)


def test_places_of_numbers():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 32, 5000))
    places = langid._Places(keys)
    asked = np.concatenate([keys, keys + 1])
    want = [int(np.searchsorted(keys, x)) if x in set(keys.tolist()) else len(keys) for x in asked.tolist()]
    assert places.of(asked).tolist() == want and langid._Places(keys[:0]).of(asked[:2]).tolist() == [0, 0]


def test_long_texts_go_on_with_their_context(monkeypatch):
    trees = built([("a", "one two three four " * 9)], {"a": 1})
    text = "one three two five " * 50
    whole = trees.lengths([text, "x", text])
    monkeypatch.setattr(langid, "AT_ONCE", 64)
    assert (trees.lengths([text, "x", text]) == whole).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.train(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.97


def test_edge_rows(docs, none):
    trees = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, trees).collect()}
    assert langid.predict(docs, trees).count() == 11
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (3, 4, 5))
    assert all(got[i].lang_pred in ("en", "de") and 0 < got[i].score <= 1 for i in (1, 2, 6, 7, 8, None))
    assert langid.train(none) is None
    assert langid.predict(none, None).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
