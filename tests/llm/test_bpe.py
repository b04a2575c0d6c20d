import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from areasignal.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_perfect_hash_is_minimal():
    h = CODEC.hash
    assert None not in h.keys and len(h.keys) == len(RANKS)
    assert all(h.find(k) == i for k, i in RANKS.items())
    assert h.find(b"no such token at all") == -1
    assert bpe.PerfectHash({}).find(b"a") == -1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = ("  word  \n\n\t tail's 123abc" * 400) + "x" * 3000 + "   end"
    whole = LIBRARY.encode_ordinary(text)
    for width in (37, 256, 1001):
        monkeypatch.setattr(bpe, "AT_ONCE", width)
        assert CODEC.encode(text) == whole


def test_edge_rows(docs, none):
    got = bpe.encode_texts(docs, PATH, P.PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256")).collect()
    assert len(got) == 11
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        want = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode_texts(none, PATH, P.PATTERN).collect() == []
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH, P.PATTERN), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in docs.collect())
