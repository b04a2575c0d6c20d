import hashlib
import re

from pyspark.sql import functions as F

from areasignal.llm import secrets

A = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "AKIA" + "ABCDEFGH12345678"
HEXES = "0123456789abcdef01234567"


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in A.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TEXTS = [
    None, "", "nothing", f"é{KEY}", f"token = '{HEXES}' password: abc secret:token:abcdefgh1", f"🙂🙂 API_KEY=x{HEXES} {HEXES}{HEXES} g{HEXES}", "api-key: none token=short",
    f"Passwd : \"{HEXES}\" AKIA AKIAX {KEY}Z{KEY}", "TOKEN==abcdefgh password=secret=token=qwerty1", "token:\n'abcdefghij' K" + "K" + "=abcdefgh", "paſſword=abcdefgh", "aKIA1 " + "f" * 23 + " " + "f" * 24,
    "ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3gH6", "token = q7w8e9r0t1y2u3i4o5p6 " * 300,
]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, f"o{i}/r", "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, live string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(TEXTS):
        want = base(t)
        assert [(s.start, s.kind, s.end) for s in got[i].base] == want
        assert {(s.start, s.kind, s.end) for s in got[i].found} >= set(want)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
    text = secrets.scan_secrets(df).where("doc_id = 3").select(secrets.spans_text(F.col("base")).alias("s")).first().s
    assert text == f"access:1:{1 + len(KEY)}"
    assert any(s.kind == 3 for s in got[12].found)


def test_copied_examples_and_live_values(spark):
    live, copied = "9f8e7d6c5b4a39281706f5e4", "1a2b3c4d5e6f708192a3b4c5"
    rows = [(i, f"here token = {copied} there", f"owner{i}/repo") for i in range(5)] + [(9, f"my token = {live} end", "owner9/repo"), (10, f"my token = {live} end", "owner9/other"), (11, "token = yourtokenexample1234", "z/z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert all(got[i].n_live == 0 and got[i].n_example == 2 for i in range(5))
    assert all(got[i].n_live == 2 and got[i].n_example == 0 for i in (9, 10)) and got[11].n_live == 0
    hidden = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert hidden[9] == "my token = <SECRET> end" and hidden[3] == rows[3][1] and hidden[11] == rows[-1][1]


def test_repositories_of_one_owner(spark):
    """A value in more repositories than max_repos is a copied template's, though one owner has them all."""
    value, other = "9f8e7d6c5b4a39281706f5e4", "1a2b3c4d5e6f708192a3b4c5"
    rows = [(i, f"token = {value}", f"one/repo{i}") for i in range(6)] + [(10 + i, f"token = {other}", f"two/repo{i % 3}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert got[0].n_live == 0 and got[0].n_example == 2 and {(s.owners, s.repos) for s in got[0].ownership} == {(1, 6)}
    assert got[10].n_live == 2 and {(s.owners, s.repos, s.live) for s in got[10].ownership} == {(1, 3, True)}
    assert {r.n_live for r in secrets.scan_secrets(df, max_repos=2).collect()} == {0}


def test_no_value_is_written(spark, monkeypatch):
    tables, write = [], secrets.written
    monkeypatch.setattr(secrets, "written", lambda df, **more: tables.append(write(df, **more)) or tables[-1])
    value = "9f8e7d6c5b4a39281706f5e4"
    secrets.scan_secrets(spark.createDataFrame([(1, f"token = {value}", "a/b")], "doc_id long, text string, source string")).collect()
    assert tables and not any(value in str(r) for t in tables for r in t.collect())


def test_edge_rows(docs, none):
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == 11
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all([(s.start, s.kind, s.end) for s in r.base] == base(texts[r.doc_id]) for r in got)
    assert secrets.scan_secrets(none).collect() == [] and secrets.redacted(none).collect() == []
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and out.count() == 11
    clash = docs.select("doc_id", "text", "source", *(F.lit("mine").alias(c) for c in ("__id", "__body", "__spans", "__row", "__source")))
    assert {tuple(r)[3:] for r in secrets.redacted(clash).collect()} == {("mine",) * 5}
    assert out.where("doc_id = 9").first().text == 'token = "<SECRET>" and more'
    assert hashlib.sha256(b"").hexdigest() == secrets.scan_secrets(docs).where("doc_id = 8").select(F.sha2(secrets.spans_text(F.col("base")), 256).alias("h")).first().h


def test_no_python_on_executors(docs):
    plan = secrets.scan_secrets(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
