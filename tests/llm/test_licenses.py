import random
import re

from areasignal.llm import licenses as lic

A = lic.automaton()


def base(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), sorted((i, p) for p in lic.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


TEXTS = [
    None, "", "MIT License", "the (MIT)\nLicense, mit-license mit licenses", "Apache License; General Public\tLicense. GNU General Public License, version 3", "mit license apache license mit license", "é mit license mit license mit license",
    "mit mit license license", "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "general public license " * 50,
]


def test_base_against_brute_force():
    for t in TEXTS:
        got = lic.scan(t, A)
        n, places = base(t)
        assert got["n_words"] == n and [p for p in got["places"] if p[1] in lic.BASE] == places
        assert {lic.BASE[p] for _, p in places} <= set(got["labels"]) and 0 <= got["score"] <= 1


def test_shunting_yard():
    assert lic.to_postfix("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert lic.to_postfix("(MIT or GPL-2.0-only WITH Classpath-exception-2.0) and ISC */") == ["mit", "gpl-2.0-only", "classpath-exception-2.0", "with", "or", "isc", "and"]
    assert lic.to_postfix("MIT; see below") == ["mit"]
    for bad in ("", "OR MIT", "(MIT", "MIT AND", "()"):
        assert lic.to_postfix(bad) is None
    assert lic.evaluate(lic.to_postfix("MIT OR GPL-3.0")) == ({"mit", "gpl-3.0"}, True)
    assert lic.evaluate(lic.to_postfix("MIT AND GPL-3.0"))[1] is False
    assert lic.evaluate(lic.to_postfix("GPL-2.0+ WITH x-exception"))[0] == {"gpl-2.0 with x-exception"}
    got = lic.scan("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */ rest", A)
    assert got["expressions"] == ["mit apache-2.0 or"] and got["permissive"] and got["score"] == 1.0 and got["labels"] == ["apache-2.0", "mit"]


def expression(rng, depth):
    """A random expression as text, its licences and whether a choice of permissive ones is allowed, by recursion."""
    kind = rng.choice(["name", "or", "and", "with"]) if depth else "name"
    if kind == "name":
        name = rng.choice(["MIT", "GPL-3.0", "Apache-2.0", "ISC", "AGPL-3.0", "LGPL-2.1+"])
        plain = name.lower().rstrip("+")
        return name, {plain}, plain in lic.PERMISSIVE
    left = expression(rng, depth - 1)
    if kind == "with":
        return f"({left[0]}) WITH an-exception", {f"{x} with an-exception" for x in left[1]}, left[2]
    right = expression(rng, depth - 1)
    return f"({left[0]}) {kind.upper()} ({right[0]})", left[1] | right[1], left[2] or right[2] if kind == "or" else left[2] and right[2]


def test_expressions_against_recursion():
    rng = random.Random(4)
    for _ in range(300):
        text, names, permissive = expression(rng, 4)
        assert lic.evaluate(lic.to_postfix(text)) == (names, permissive), text
    assert lic.evaluate(lic.to_postfix("a WITH (b WITH c)")) == ({"a with b with c"}, False)
    assert lic.evaluate(lic.to_postfix("a WITH (b OR c)")) is None


def tags(text):
    """Labels of identifier tags by splitting at operators: of expressions without parentheses, on one line."""
    out = set()
    for line in re.split(r"[\r\n]", text or ""):
        for part in re.split(r"spdx-license-identifier[ \t]*:?", line, flags=re.I)[1:]:
            for name in re.split(r"\s+(?:or|and)\s+", part.strip(), flags=re.I):
                first = re.match(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", name)
                if first is None:
                    break
                name_ = first[0].lower().rstrip(".:").rstrip("+")
                out |= {name_} if lic.known(name_) else set()
                if first[0] != name:
                    break
    return out


def test_query_against_brute_force(spark):
    rng = random.Random(6)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "see", "LICENSE", "BSD-3-Clause", "x", "LicenseRef-mine", "CC-BY-SA-4.0", "foo-1.0"]
    rows = []
    for i in range(300):
        tail = f" {rng.choice(['OR', 'and'])} ".join(rng.choices(names, k=rng.randint(0, 4))) + rng.choice(["", " */", " see file", "; more", " (c) me"])
        rows.append((i, rng.choice(["", "some words\n", "// "]) + f"SPDX-License-Identifier: {tail}\n" + rng.choice(["", "MIT License and more words", "code();"])))
    got = {r.doc_id: r for r in lic.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        n, places = base(text)
        assert got[i].n_words == n and set(got[i].labels) == tags(text) | {lic.BASE[p] for _, p in places}, text
        assert (got[i].score > 0) == bool(got[i].labels) and 0 <= got[i].score <= 1


def test_tags_of_more_lines_and_junk():
    of = lambda t: lic.scan(t, A)
    assert of("SPDX-License-Identifier: see LICENSE file")["labels"] == [] and of("SPDX-License-Identifier: see LICENSE file")["score"] == 0
    assert of("// SPDX-License-Identifier: MIT OR\n//   Apache-2.0\nint x;")["labels"] == ["apache-2.0", "mit"]
    assert of(" * SPDX-License-Identifier: (MIT\r\n *   AND ISC)\r\n * more")["expressions"] == ["mit isc and"]
    assert of("# SPDX-License-Identifier: MIT\n# OR ISC\nimport x")["labels"] == ["isc", "mit"]
    assert of("# SPDX-License-Identifier: MIT\nISC here")["labels"] == ["mit"]
    assert of("SPDX-License-Identifier: MIT OR\nSPDX-License-Identifier: ISC")["labels"] == ["isc", "mit"]
    cut, whole = of("SPDX-License-Identifier: MIT OR"), of("SPDX-License-Identifier: MIT")
    assert cut["labels"] == ["mit"] and 0 < cut["score"] < whole["score"] == 1.0
    assert lic.parsed("(MIT OR (ISC AND") == (["mit", "isc", "or"], False)
    assert lic.known("gpl-2.0-only with classpath-exception-2.0") and not lic.known("gpl-2.0 with mit") and not lic.known("the")


def test_long_tags_take_time_in_step():
    for tail in ("(" * 200_000, "MIT OR " * 50_000, "MIT\n" * 50_000, "MIT OR\n" * 50_000, "SPDX-License-Identifier: MIT OR\n" * 10_000, "#" * 200_000, "\n" * 200_000):
        lic.scan("SPDX-License-Identifier: " + tail, A)


def test_edge_rows(docs, none):
    got = lic.scan_licenses(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 11 and all(r.n_words == base(texts[r.doc_id])[0] for r in got)
    assert lic.scan_licenses(none).collect() == []
