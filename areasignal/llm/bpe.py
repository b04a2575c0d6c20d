"""Byte-level BPE: a minimal perfect hash over the vocabulary, and merges by a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from areasignal.llm.common import arrow_map, kind_of

#: Half of the pre-tokens whose ids one worker remembers, and characters of a text that are cut into pre-tokens at once.
REMEMBERED, AT_ONCE = 150_000, 1 << 20
LOW = (1 << 32) - 1


class PerfectHash:
    """A minimal perfect hash of n keys onto 0..n-1 by hash and displace; a lookup compares the key at its slot.

    Buckets are placed from the largest to the smallest: a bucket of several keys by the first displacement that
    puts all of them on free slots, a bucket of one key straight onto a slot that is left.
    """

    def __init__(self, ids: dict[bytes, int]) -> None:
        self.n, self.buckets = len(ids), max(1, len(ids) // 3)
        for self.seed in range(64):
            if self._place(ids):
                return
        raise ValueError("no seed separates the keys")

    def _place(self, ids: dict[bytes, int]) -> bool:
        n, groups = self.n, [[] for _ in range(self.buckets)]
        for key in ids:
            h = xxhash.xxh64_intdigest(key, self.seed)
            groups[h % self.buckets].append((h & LOW, h >> 32 | 1, key))
        self.keys, self.ids, self.shift = [None] * n, [0] * n, [0] * self.buckets
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for at, b in enumerate(order):
            if len(groups[b]) < 2:
                break
            for d in range(4 * n):
                slots = {(x + d * y) % n for x, y, _ in groups[b]}
                if len(slots) == len(groups[b]) and all(self.keys[s] is None for s in slots):
                    break
            else:
                return False
            self.shift[b] = d
            for x, y, key in groups[b]:
                self.keys[(x + d * y) % n], self.ids[(x + d * y) % n] = key, ids[key]
        else:
            at = len(order)
        free = (s for s in range(n) if self.keys[s] is None)
        for b in order[at:]:
            for _, _, key in groups[b]:
                s = next(free)
                self.shift[b], self.keys[s], self.ids[s] = -s - 1, key, ids[key]
        return True

    def find(self, key: bytes) -> int:
        """The key's id, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else ((h & LOW) + d * (h >> 32 | 1)) % self.n
        return self.ids[s] if self.keys[s] == key else -1


class Codec:
    """Encodes and decodes by ranks (bytes to id; all 256 single bytes are needed) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern, self.hash = pattern, PerfectHash(ranks)
        self.bytes_of = {i: key for key, i in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"single bytes without a rank: {missing[:9]}")
        self._wake()

    def _wake(self) -> None:
        self.cut, self.text_of, self.memo = regex.compile(self.pattern), {i: str(i) for i in self.bytes_of}, _Memo(self)
        self.rank = {key: i for i, key in self.bytes_of.items()}.get  # of pairs that merge

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cut", "text_of", "memo", "rank")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._wake()

    def ids_of(self, piece: bytes) -> tuple[int, ...]:
        """Of one pre-token: its own id by the perfect hash, or the ids that the merges leave."""
        i = self.hash.find(piece)
        return (i,) if i >= 0 else self._merged(piece)

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        n, rank = len(piece), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by the start of each part; after: also its end
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:  # one of the two parts has gone or grown
                continue
            after[mid], after[i] = -1, end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (left := before[i]) >= 0 and (r := rank(piece[left:end])) is not None:
                heappush(heap, (r, left, end))
        out, i = [], 0
        while i < n:
            end = after[i]
            out.append(rank(piece[i:end]))
            i = end
        return tuple(out)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in lists; a long text is cut so that no list depends on where."""
        at, width = 0, AT_ONCE
        while len(text) - at > width:
            part = self.cut.findall(text, at, at + width)
            if len(part) < 4:  # one pre-token longer than the cut
                width *= 2
                continue
            del part[-2:]
            yield part
            at, width = at + sum(map(len, part)), AT_ONCE
        yield self.cut.findall(text, at) if at else self.cut.findall(text)

    def encode(self, text: str) -> list[int]:
        get = self.memo.__getitem__
        return list(chain.from_iterable(chain.from_iterable(map(get, part) for part in self.pieces(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of the decimal ids, joined by commas."""
        return hashlib.sha256(",".join(map(self.text_of.__getitem__, ids)).encode()).hexdigest()


class _Memo(dict):
    """The ids of pre-tokens seen lately, in two generations of bounded size."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.codec.ids_of(piece.encode())
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: What encode_texts can return besides the id: name to type.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, and decodes the ids again where a decoded output is asked for.

    Returns id_col and the outputs asked for, a row for each input row: repeated rows give repeated results, a null
    id stays null, other columns don't matter. A null text is an empty one: no ids. The rank file is read by the
    driver; its tables (a few MB for 50,000 tokens, whatever the corpus) are broadcast.
    """
    codec = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec.value
        kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = {k: [] for k in outputs}
                for text in batch.column(1):
                    ids = c.encode(text.as_py() or "")
                    plain = c.decode(ids) if "decoded" in out or "decoded_sha256" in out else b""
                    for k, to in out.items():
                        to.append(np.array(ids, np.int32) if k == "ids" else len(ids) if k == "n_tokens" else c.digest(ids) if k == "ids_sha256" else plain.decode() if k == "decoded" else hashlib.sha256(plain).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], [id_col, *outputs])

    return arrow_map(df.select(id_col, text_col), run, ", ".join([f"`{id_col}` {kind_of(df, id_col)}", *(f"{k} {OUTPUTS[k]}" for k in outputs)]))


def decode_ids(df: DataFrame, ranks_path: str, pattern: str = "", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Turns arrays of ids back into texts: id_col and text. Null ids give a null text; bytes that aren't UTF-8 (of
    ids cut short) become replacement characters."""
    codec = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else codec.value.decode(x.as_py()).decode(errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return arrow_map(df.select(id_col, ids_col), run, f"`{id_col}` {kind_of(df, id_col)}, text string")
