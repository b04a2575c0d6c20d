"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areasignal.llm import bpe, conversations, fingerprint, html_layout, langid, licenses, mixing, pii, quality, secrets, simhash, topk, vector_codes

#: The rank file and the pre-token pattern of the BPE queries.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_oph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's fingerprint, its edited text's and the likeness of neighbours. A null text is empty; null ids come first."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document. A null text weighs 0; a null source is the last one; repeated rows share their copies evenly."""
    rows = mixing.copies(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.col("n").alias("copies"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of each text as digests. A null or empty text has no ids and the digest of nothing."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), RANKS, PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each text. Null and empty texts are scored by statistics of 0; documents without labels are scored too."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each text. Null texts and those without letters are `und` with score 0; null languages teach nothing."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each text. A null text has none; a null source is one unnamed owner."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"), secrets.spans_text(F.col("found")).alias("spans"), "n_live", "n_example")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of each text. A null text has no words, no places and empty labels."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["phrase"].isin(*licenses.BASE))
    words = F.transform(base, lambda p: p["word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", "permissive")


def op8_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of each page, laid out. A null or empty page has an empty text."""
    return html_layout.extract_text(table(spark, sf_dir, "pages"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's fingerprint and component. Null and wordless texts have fingerprint 0 and are linked like any other."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of each query. Vectors that are null or not finite, and null ids, take no part."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's code and errors. Vectors that are null or not finite take no part; a null id is a row like any other."""
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, gaps and the cheapest edits of each conversation, after damage. Null ids are one conversation."""
    hurt = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repaired(hurt, alive=F.col("alive")))


def op13_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each text, plain and disguised. A null text has none."""
    found = pii.scan_personal(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, pii.KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda s, k=k: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_oph_fingerprint, op2_source_mix, op3_byte_bpe, op4_quality_rules, op5_ppm_language, op6_secret_scan, op7_license_scan, op8_html_layout, op9_simhash_dedup, op10_impact_topk, op11_yinyang_codes, op12_turn_repair, op13_pii_spans)}
ORACLES: dict[str, str] = {
    "op10_impact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v AS a JOIN v AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20
    """,
    "op11_yinyang_codes": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (
            SELECT *, list_dot_product(c, c) AS cc FROM (SELECT r, k AS part, q[k * (len(q) // 4) + 1 : (k + 1) * (len(q) // 4)] AS c FROM v, range(4) AS t(k))
        ), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, c, cc FROM p WHERE r <= 256),
        {rounds}
        e AS MATERIALIZED (SELECT r, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r),
        w AS (SELECT v.vec_id, e.code, e.error, v.label FROM v JOIN e USING (r)),
        l AS (SELECT label, sum(error)::BIGINT AS label_error FROM w GROUP BY label),
        h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM b4))
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM w JOIN l ON w.label IS NOT DISTINCT FROM l.label, h
    """,
    "op12_turn_repair": r"""
        WITH RECURSIVE tab AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS x(i)
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS key FROM conversations
        ), hit AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, key), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS how FROM keyed, tab
        ), rows_ AS MATERIALIZED (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM (
                SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                FROM hit, range(2) AS c(copy) WHERE how <> 0 AND (copy = 0 OR how = 3))
        ), f AS MATERIALIZED (
            SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair, count(*) OVER (PARTITION BY conv_id) AS n,
                CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault
            FROM rows_
        ), back AS (
            SELECT DISTINCT conv_id, n + 1 AS i, 0 AS c0, 4 AS c1, 2 AS c2, 0 AS c3 FROM f
            UNION ALL
            SELECT conv_id, i, least(e0, 2 + e2, 4 + e3), least(e1, 2 + e2, 4 + e3), least(e2, 2 + e3), least(e3, 2 + e2) FROM (
                SELECT f.conv_id, f.i, f.fault IN ('b', 'd') AS gone, (f.fault = 't')::INTEGER AS t,
                    least(3 + c0, CASE WHEN gone THEN 999999999 ELSE t + least(2 + c2, CASE ini WHEN 's' THEN c1 WHEN 'u' THEN c2 ELSE 999999999 END) END) AS e0,
                    least(3 + c1, CASE WHEN gone THEN 999999999 ELSE t + least(2 + c2, CASE ini WHEN 'u' THEN c2 ELSE 999999999 END) END) AS e1,
                    least(3 + c2, CASE WHEN gone THEN 999999999 ELSE t + least(2 + c3, CASE ini WHEN 'a' THEN c3 ELSE 999999999 END) END) AS e2,
                    least(3 + c3, CASE WHEN gone THEN 999999999 ELSE t + least(2 + c2, CASE ini WHEN 'u' THEN c2 ELSE 999999999 END) END) AS e3
                FROM back JOIN f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.i = back.i - 1)
        ), cost AS MATERIALIZED (SELECT conv_id, i, [c0, c1, c2, c3] AS c FROM back),
        steps AS MATERIALIZED (SELECT a.conv_id, a.i, a.c, b.c AS d, f.ini, f.fault, f.role, f.text FROM cost AS a LEFT JOIN cost AS b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = a.i + 1
            LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id AND f.i = a.i
        ), walk AS (
            SELECT DISTINCT conv_id, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM f
            UNION ALL
            SELECT conv_id, CASE edit WHEN 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE due END, audit || edit,
                CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, name || ':' || text) ELSE list_append(lines, name || ':') END
            FROM (
                SELECT w.*, z.role, z.text, CASE q WHEN 3 THEN 4 ELSE 3 END AS due, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END AS name,
                    CASE WHEN q = 1 AND ini = 's' THEN 2 WHEN q <> 3 AND ini = 'u' THEN 3 WHEN q = 3 AND ini = 'a' THEN 4 END AS kept, (fault = 't')::INTEGER AS t,
                    CASE WHEN d IS NOT NULL AND 3 + d[q] = c[q] THEN 'D' WHEN 2 + c[due] = c[q] THEN 'I' WHEN fault IN ('o', 't') AND kept IS NOT NULL AND t + d[kept] = c[q] THEN 'K'
                        WHEN fault IN ('o', 't') AND 2 + t + d[due] = c[q] THEN 'R' END AS edit
                FROM walk AS w JOIN steps AS z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i)
            WHERE edit IS NOT NULL
        ), done AS (
            SELECT w.conv_id, w.audit, array_to_string(w.lines, chr(10)) AS body FROM walk AS w JOIN steps AS z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i WHERE z.d IS NULL AND z.c[w.q] = 0
        ), facts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate, count_if(fault = 't')::BIGINT AS truncated,
                count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM f GROUP BY conv_id
        )
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(cost.c[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id
            LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN cost ON cost.conv_id IS NOT DISTINCT FROM o.conv_id AND cost.i = 1
    """,
}

#: One of Lloyd's rounds for the SQL above: nearest entries (by distance, then index), then the floors of means.
_ASSIGN = "a{n} AS MATERIALIZED (SELECT r, part, c, m % 256 AS entry, m // 256 AS d FROM (SELECT p.r, p.part, any_value(p.c) AS c, min((p.cc - 2 * list_dot_product(p.c, b.c) + b.cc)::BIGINT * 256 + b.entry) AS m FROM p JOIN b{n} AS b ON p.part = b.part GROUP BY p.r, p.part)),"
_UPDATE = (
    "m{n} AS (SELECT part, entry, list(floor(s / k) ORDER BY pos) AS c FROM (SELECT part, entry, pos, sum(x) AS s, count(*) AS k FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM a{o}) GROUP BY part, entry, pos) GROUP BY part, entry),\n"
    "b{n} AS MATERIALIZED (SELECT part, entry, c, list_dot_product(c, c) AS cc FROM (SELECT o.part, o.entry, coalesce(m{n}.c, o.c) AS c FROM b{o} AS o LEFT JOIN m{n} ON m{n}.part = o.part AND m{n}.entry = o.entry)),"
)
ORACLES["op11_yinyang_codes"] = ORACLES["op11_yinyang_codes"].replace("{rounds}", "\n".join(_ASSIGN.format(n=n) + ("\n" + _UPDATE.format(n=n + 1, o=n) if n < 4 else "") for n in range(5)))
