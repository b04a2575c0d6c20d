import random
import re

import pytest

from areasignal.llm import pii

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()]
    for i in range(len(d) - 2, -1, -2):
        d[i] = d[i] * 2 - 9 * (d[i] > 4)
    return 12 <= len(d) <= 19 and sum(d) % 10 == 0


def brute(text):
    holds = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), luhn, lambda s: 9 <= sum(c.isdigit() for c in s) <= 15)
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if holds[k](m[0]))


def test_plain_patterns_against_regular_expressions(spark, docs):
    rng = random.Random(1)
    pieces = ["a@b.co", "@", ".", "_", "1", "22", "255", "256", "4111111111111111", "+1", " ", "-", "(", ")", "x", "é", "🙂", "user", "007.1.2.3", "+49 30 123456", "%", "a.b-c"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        base, found = pii.identifiers(text)
        assert base == brute(text) and set(base) <= set(found), text
    got = {(r["doc_id"], tuple(map(tuple, r["base"]))) for r in pii.scan_personal(docs).collect()}
    assert got == {(r["doc_id"], tuple(brute(r["text"]))) for r in docs.collect()}


@pytest.mark.parametrize(("kind", "text"), [
    ("email", "john [at] example [dot] com"), ("email", "john.smith(at)example(dot)co(dot)uk"), ("email", "jane at example dot org"), ("email", "jоhn@exаmple.com"), ("email", "jo​hn@exa­mple.com"),
    ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "a&#64;b&#46;com"), ("email", "jane @ example . org"), ("email", "jane_at_example_dot_org"), ("email", "JANE {AT} EXAMPLE {DOT} ORG"), ("email", "𝒋𝒂𝒏𝒆@example.com"),
    ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192[.]168[.]0[.]1"), ("ip", "１９２．１６８．０．１"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"), ("card", "٤١١١١١١١١١١١١١١١"), ("card", "4111–1111–1111–1111"),
    ("phone", "plus four nine three zero one two three four five six seven"), ("phone", "＋49 30 1234567"), ("phone", "plus four nine double three one two three four five six"),
])
def test_disguises_are_mapped_back(kind, text):
    for before, after in (("", ""), ("Über 🙂 das: ", " und so weiter."), ("x, ", " (y)")):
        whole = before + text + after
        base, found = pii.identifiers(whole)
        assert (len(before), pii.KINDS.index(kind), len(before) + len(text)) in found and base == brute(whole)


@pytest.mark.parametrize("text", ["Look at example.com for more.", "Meet me at two. Then go.", "Наш адрес почта на сайте.", "un deux trois", "one two three", "It was at and. He said dot by dot.", "Version 1.2.3.400 of 2024-01-02", "éèà @ home", "&#64; alone", "x" * 1000])
def test_clean_texts_stay(text):
    assert pii.identifiers(text)[1] == brute(text) == []


def test_numbers_side_by_side():
    text = "call +1 (826) 555-4081 190.137.223.204 or 4111111111111111 4111111111111111"
    assert [text[s:e] for s, _, e in pii.identifiers(text)[1]] == ["+1 (826) 555-4081", "190.137.223.204", "4111111111111111", "4111111111111111"]


def test_maps_compose():
    m = pii.Mapped("abcdef").rewritten([(1, 3, "X"), (4, 5, "")])
    assert m.text == "aXdf" and [m.source(i, i + 1) for i in range(4)] == [(0, 1), (1, 3), (3, 4), (5, 6)] and m.source(0, 4) == (0, 6)
    n = m.rewritten([(0, 2, "YZ")])
    assert n.text == "YZdf" and n.source(0, 1) == (0, 3) and n.source(1, 3) == (0, 4)


def test_masked(spark, docs, none):
    df = spark.createDataFrame([(1, "mail jane [at] x [dot] org or 10.0.0.1", "c1"), (2, None, None), (3, "clean", "c0")], "c1 int, text string, c0 string")
    assert [tuple(r) for r in pii.masked(df).orderBy("c1").collect()] == [(1, "mail <EMAIL> or <IP>", "c1"), (2, None, None), (3, "clean", "c0")]
    assert pii.masked(none).count() == pii.scan_personal(none).count() == 0


def test_long_texts_take_time_in_step():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "one " * 60_000, "@" * 200_000):
        pii.identifiers(text)


@pytest.mark.parametrize("text", ["one two three four sİx", "uno sİx, nueve, cinq", "TRİPLE one two three four", "zwei trİple sıx sept one"])
def test_letters_that_patterns_take_for_ascii_ones(text):
    base, found = pii.identifiers(text + " a@b.co")
    assert base == brute(text + " a@b.co") and set(base) <= set(found)
