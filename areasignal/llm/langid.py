"""Language ID by prediction by partial matching: exact code lengths under each language's frozen byte context tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, in_fold, kind_of

#: Longest context in bytes, units of a bit, bytes scored at once.
ORDER, UNITS, AT_ONCE = 3, 256, 1 << 20
#: Bits of a byte that no context of a language predicts; the longest code length of one byte.
FLAT, MOST = 8.0, 32767
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("0") : ord("9") + 1] = ord("0")
_FOLD[[9, 10, 11, 12, 13]] = 32


def folded(text: str | None) -> np.ndarray:
    """UTF-8 bytes of the lower-cased text, digits and white space made alike."""
    return _FOLD[np.frombuffer((text or "").lower().encode(), np.uint8)]


class _Places:
    """The place of each of some distinct numbers, by a table that is asked for many at once; of any other one, the last."""

    def __init__(self, keys: np.ndarray) -> None:
        self.none = len(keys)
        self.bits = max(1, int(2 * len(keys) + 1).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.full(size, -1, np.int64), np.full(size, self.none, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.at[slot[put]] = keys[left[put]], left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, slot = left[rest], slot[rest] + 1 & size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        hit = held == keys
        out = np.where(hit, self.at[slot], np.int32(self.none))
        left = np.flatnonzero(~hit & (held >= 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & len(self.keys) - 1
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.at[slot[same]]
            on = ~same & (held >= 0)
            left, slot = left[on], slot[on]
        return out


@dataclass
class Trees:
    """Frozen trees of several languages.

    grams[k], cost[k]: the byte sequences of length k + 1 seen in any language (the last byte after a context of k bytes), and
    each language's code length of that byte there, in 1/UNITS bits. contexts[k], escape[k]: the contexts of k bytes, and what
    each language pays there for a byte that it hasn't seen after it, before it goes on with the shorter context. A context or
    sequence not seen at all has the last row: an escape of 0. prior: each language's, in the same unit.
    """

    langs: list[str]
    grams: list[_Places]
    cost: list[np.ndarray]
    contexts: list[_Places]
    escape: list[np.ndarray]
    prior: np.ndarray

    def costs(self, keys: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Code lengths by language of the last byte of each number's low k + 1 bytes, after the ones before it."""
        keys = keys & (1 << 8 * (k + 1)) - 1
        at = self.grams[k].of(keys)
        out = self.cost[k][at]
        if k and len(new := np.flatnonzero(at == self.grams[k].none)):
            out[new] = np.minimum(self.escape[k][self.contexts[k].of(keys[new] >> 8)] + self.costs(keys[new], k - 1), MOST)
        return out

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Code lengths by text and language: sums of whole numbers, so exact and alike wherever they are added."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        part, owners, size = [], [], 0

        def flush() -> None:
            if not part:
                return
            s = np.concatenate(part).astype(np.int64)
            keys = s[ORDER:].copy()
            for j in range(1, ORDER + 1):
                keys |= s[ORDER - j : len(s) - j] << 8 * j
            ends = np.cumsum([len(p) for p in part])
            starts = ends - [len(p) for p in part]
            cost = self.costs(keys)
            for k, a, b in zip(owners, starts, ends - ORDER):
                out[k] += cost[a:b].sum(axis=0, dtype=np.int64)
            part.clear(), owners.clear()

        for k, text in enumerate(texts):
            s = folded(text)
            for i in range(0, len(s), AT_ONCE):  # a long text goes on with the context it had
                part.append(np.concatenate([np.full(ORDER, 32, np.uint8) if not i else s[i - ORDER : i], s[i : i + AT_ONCE]]))
                owners.append(k)
                size += len(part[-1])
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        return out + self.prior


def _grams(texts: list[tuple[str, str]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each language its byte sequences of lengths 1 to ORDER + 1, as numbers with a leading 1 byte, and their counts."""
    by: dict[str, list[np.ndarray]] = {}
    for lang, text in texts:
        raw = np.concatenate([np.full(ORDER, 32, np.uint8), folded(text)]).astype(np.int64)
        n = len(raw) - ORDER
        key = raw[ORDER:].copy()
        found = by.setdefault(lang, [])
        found.append(key + (1 << 8))
        for j in range(1, ORDER + 1):
            key = key | raw[ORDER - j : ORDER - j + n] << 8 * j
            found.append(key + (1 << 8 * (j + 1)))
    for lang, found in by.items():
        yield lang, *np.unique(np.concatenate(found), return_counts=True)


def gram_counts(df: DataFrame) -> DataFrame:
    """lang, gram and n of a table of lang and text: each task adds up its own, then counts are summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for lang, keys, times in _grams(list(zip(*(batch.column(j).slice(at, 512).to_pylist() for j in (0, 1))))):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    return arrow_map(df.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, docs: dict[str, int]) -> Trees | None:
    """Trees from columns of language, gram and count. Escapes are by method C: a context seen n times with d different next
    bytes gives a seen one its count of n + d, and what is not seen d of n + d times its share in the shorter context."""
    langs = sorted(docs)
    if not langs:
        return None
    index = {x: i for i, x in enumerate(langs)}
    of = np.array([index[x] for x in lang], np.int64)
    grams, cost, contexts, escape = [], [], [], []
    bits, keys = np.full((1, len(langs)), FLAT), np.zeros(1, np.int64)  # of the shorter sequences, and these
    for k in range(ORDER + 1):
        here = (gram >> 8 * (k + 1)) == 1
        new, at = np.unique(gram[here] - (1 << 8 * (k + 1)), return_inverse=True)
        seen = np.zeros((len(new), len(langs)), np.int64)
        np.add.at(seen, (at, of[here]), n[here])
        before, ctx = np.unique(new >> 8, return_inverse=True)
        total, kinds = np.zeros((len(before), len(langs)), np.int64), np.zeros((len(before), len(langs)), np.int64)
        np.add.at(total, ctx, seen)
        np.add.at(kinds, ctx, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            shorter = bits[np.searchsorted(keys, new & (1 << 8 * k) - 1)] if k else np.full((len(new), len(langs)), FLAT)
            made = np.where(seen > 0, np.log2((total[ctx] + kinds[ctx]) / seen), out[ctx] + shorter)
        whole = lambda x: np.minimum(np.rint(x * UNITS), MOST).astype(np.int16)
        # what no language has seen after the empty context costs its escape and FLAT; after a longer one, nothing yet
        none = out + FLAT if k == 0 and len(out) else np.full((1, len(langs)), FLAT if k == 0 else 0.0)
        grams.append(_Places(new))
        cost.append(np.vstack([whole(made), whole(none)]))
        contexts.append(_Places(before))
        escape.append(np.vstack([whole(out), np.zeros((1, len(langs)), np.int16)]).astype(np.int32))
        bits, keys = made, new
    prior = np.rint([-np.log2(docs[x] / sum(docs.values())) * UNITS for x in langs]).astype(np.int64)
    return Trees(langs, grams, cost, contexts, escape, prior)


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_lang: int = 1500, in_all: int = 24_000) -> Trees | None:
    """Fits on documents with a language that aren't held out (`in_fold`): about per_lang of each language, those least by a
    hash of the id, but about in_all of all languages. Those two bounds keep the counts that reach the driver and the tables
    that are broadcast at some MB whatever the size of the corpus; of the sample, all counts are kept. None without documents.

    Languages are a short closed list (codes): their names and numbers of documents are collected.
    """
    rows = df.where(F.col(lang_col).isNotNull() & ~in_fold(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not docs:
        return None
    each = min(per_lang, in_all / len(docs))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(docs.items()) for x in (k, min(1.0, each / n)))), F.col("lang"))
    found = gram_counts(rows.where(place < share)).toArrow()
    return build(found["lang"].to_pylist(), *(found[c].to_numpy() for c in ("gram", "n")), docs)


def predict(df: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id_col, held_out, lang_pred (the language with the least code length, the first by name of
    several) and score (its share of 2 ** -bits over all languages, bits taken of at most 64 bytes of average cost).

    A null text, one without letters, and any text without trees is `und` with score 0. Other columns don't matter.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                langs, scores = ["und"] * len(texts), [0.0] * len(texts)
                if t is not None:
                    cost = t.lengths(texts)
                    best = cost.argmin(axis=1)
                    size = np.array([max(1, len(x or "")) for x in texts])
                    over = (cost - cost.min(axis=1, keepdims=True)) / UNITS * np.minimum(1, 64 / size)[:, None]
                    share = 1 / (2.0**-over).sum(axis=1)
                    for k, x in enumerate(texts):
                        if x and _LETTER.search(x):
                            langs[k], scores[k] = t.langs[best[k]], float(share[k])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_col, "lang_pred", "score"])

    found = arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind_of(df, id_col)}, lang_pred string, score double")
    return found.select(id_col, in_fold(F.col(id_col)).alias("held_out"), "lang_pred", "score")
