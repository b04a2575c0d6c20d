from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from areasignal.llm import bpe, mixing, quality, secrets, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    one = steps["quality classifier"](spark, docs, DATA).cache()
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in quality.score_quality(docs, model).collect() if r.predicted == 1}
    assert {r.doc_id for r in one.collect()} == want and sorted(one.columns) == sorted(start)
    two = steps["near-dedup"](spark, one, DATA).cache()
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(one).collect()}
    assert {r.doc_id for r in two.collect()} == set(groups.values())
    three = steps["secret scan"](spark, two, DATA).cache()
    before, after = ({r.doc_id: r for r in d.collect()} for d in (two, three))
    live = {r.doc_id: r.n_live for r in secrets.scan_secrets(two).collect()}
    for i, r in after.items():
        assert (r.text != before[i].text) == (live[i] > 0) and r.n_chars == len(r.text)
    four = steps["source mix"](spark, three, DATA).cache()
    taken = {r.id: r.n for r in mixing.copies(three).collect()}
    assert Counter(r.doc_id for r in four.collect()) == +Counter(taken) and sorted(four.columns) == sorted(start)
    five = steps["byte BPE"](spark, four, DATA).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = {i: library.encode_ordinary(r.text) for i, r in after.items()}
    assert len(five) == four.count() and all(r.ids == ids[r.doc_id] for r in five)
    assert corpus_pipeline.run(spark, DATA).agg(F.count("*"), F.sum("n_tokens")).first() == (len(five), sum(r.n_tokens for r in five))


def test_edge_rows(spark, docs, none):
    plain = list(corpus_pipeline.COLUMNS)
    for start, n in ((docs, 11), (none, 0)):
        d = start.select(*plain)
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, DATA).cache()
            assert d.count() <= 3 * n
            if name != "byte BPE":
                assert sorted(d.columns) == sorted(plain)
