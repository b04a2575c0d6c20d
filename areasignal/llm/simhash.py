"""SimHash near-dedup by anchor-point covering: fingerprints meet at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, kind_of, written

#: Words of a shingle, differing bits of a link, seed of the hash.
WORDS, BITS, SEED = 4, 4, 42
#: Of similar texts: words of a shingle; bands of so many permutations each, of which one must agree for a pair to be compared.
NEAR_WORDS, BANDS, ROWS = 5, 32, 7
#: Members of a part of a long run.
PART = 4096
#: Runs of fingerprints at one anchor up to this length are compared pair by pair, longer ones by blocks of bits.
SHORT_RUN = 32
#: Fingerprints of one anchor that a task holds; more are dealt anew.
LONG_RUN = 1 << 16
_BIT = np.array([[v >> (7 - b) & 1 for b in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64; 0 without words."""
    parts = (text or "").encode().lower().split()  # bytes: lower-cases A-Z alone and splits at ASCII white space alone
    if not parts:
        return 0
    k = min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    line, h = b" ".join(parts), xxhash.xxh64_intdigest
    starts = (ends - lengths)[: len(parts) - k + 1].tolist()
    hashes = np.array([h(line[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())], np.uint64)
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        ones = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BIT for j in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col and fp (the 64 bits as a signed long) of each row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind_of(df, id_col)}, fp long")


def shingles(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of so many words (one of all words if there are fewer)."""
    parts_of = (text or "").encode().lower().split()
    if not parts_of:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_SEEN.__getitem__, parts_of), np.uint64, len(parts_of))
    n, k = max(1, len(h) - words + 1), min(words, len(h))
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ out >> np.uint64(29))


_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: of the least values of its ROWS permutations over the shingles."""
    if not len(found):
        return np.empty(0, np.int64)
    x, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        y = (x[at : at + 512] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint32(1))
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(least, y.min(axis=1), out=least)
    made = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        made = (made ^ made >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + column
    return (made ^ made >> np.uint64(32)).view(np.int64)


class _Words(dict):
    """Hashes of words seen lately; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_SEEN = _Words()


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Of the Hamming code of length 31 (bit i-1 has position i): 0 for a code word, else the position of the bit to flip."""
    out = np.zeros(len(x), np.int64)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << j
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of each fingerprint (a row of 64-bit parts), and the index of its fingerprint for each anchor.

    Anchors of a 32-bit half are the words of the code [31, 26] with each value of the 32nd bit: every half lies within its
    covering radius of 1 from one. Two halves at distance 2 or less have a point midway, within 1 of both, whose anchor is
    within 1 + 1 of both. So each half goes to all anchors that are nearest to a point within 1 of it, 17 at most, and
    fingerprints meet if any half differs in at most 2 bits: all of one part that differ in at most 4.
    """
    fps = fps.reshape(len(fps), -1).view(np.uint64)
    keys, owners = [], []
    index = np.arange(len(fps))
    for half in range(2 * fps.shape[1]):
        bits = (fps[:, half // 2] >> np.uint64(32 * (half % 2))).astype(np.int64) & 0xFFFFFFFF
        x, last = bits & 0x7FFFFFFF, bits >> 31
        s = _syndrome(x)
        home = np.where(s > 0, x ^ (1 << np.maximum(s - 1, 0)), x)
        tag = half << 33
        keys += [tag | last << 32 | home, tag | (1 - last) << 32 | home]
        owners += [index, index]
        far = np.nonzero(s)[0]
        for i in range(1, 32):  # code words two flips away: of bits i and i ^ s
            j = s[far] ^ i
            ok = (j > i) & (j < 32)
            at = far[ok]
            keys.append(tag | last[at] << 32 | x[at] ^ (1 << (i - 1)) ^ (1 << (j[ok] - 1)))
            owners.append(at)
    return np.concatenate(keys), np.concatenate(owners)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of two parts."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _search(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all fingerprints of a run that chains of links connect: each new member, found from another one."""
    out, left = [], fps
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            near = _apart(left, queue[0]) <= bits
            found = left[near]
            out.append((np.repeat(queue.pop(0)[None, :], len(found), axis=0), found))
            queue.extend(found)
            left = left[~near]
    return out


def _short(key: np.ndarray, fps: np.ndarray, most: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links among the members of each run of equal keys of at most so many members."""
    out = []
    for k in range(1, most):
        if len(key) <= k or not (same := key[k:] == key[:-k]).any():
            break
        at = np.flatnonzero(same)
        near = _apart(fps[at], fps[at + k]) <= bits
        out.append((fps[at][near], fps[at + k][near]))
    return out


def _long(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what lies within so many bits in a long run: cut into one block of bits more than may differ, two
    such fingerprints agree in a whole block, so only those are compared; by search where many agree in that too."""
    out, blocks = [], bits + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for low, high in zip(edges, edges[1:]):
        key = fps[:, 0] >> np.uint64(low) & np.uint64((1 << high - low) - 1)
        order = np.argsort(key, kind="stable")
        key, part = key[order], fps[order]
        bounds = np.flatnonzero(np.diff(key)) + 1
        starts, lengths = np.r_[0, bounds], np.diff(np.r_[0, bounds, len(key)])
        for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
            out += _search(part[s : s + n], bits)
        keep = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
        out += _short(key[keep], part[keep], SHORT_RUN, bits)
    return out


def _links(anchor: np.ndarray, fps: np.ndarray, bits: int) -> np.ndarray:
    """Pairs of fingerprints (by their first part) at one anchor, in sorted runs, that connect what lies within so many bits."""
    bounds = np.flatnonzero(np.diff(anchor)) + 1
    starts, lengths = np.r_[0, bounds], np.diff(np.r_[0, bounds, len(anchor)])
    pairs = []
    for s, n in zip(starts[lengths > SHORT_RUN], lengths[lengths > SHORT_RUN]):
        pairs += _long(fps[s : s + n], bits)
    keep = np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths)
    pairs += _short(anchor[keep], fps[keep], SHORT_RUN, bits)
    if not pairs:
        return np.empty((0, 2), np.int64)
    x, y = (np.ascontiguousarray(np.concatenate([p[i] for p in pairs])[:, 0]).view(np.int64) for i in (0, 1))
    both = np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)
    return _forest(np.unique(both[both[:, 0] < both[:, 1]], axis=0))


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect what the given ones connect: each node but the least of its component with that one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for u, v in pairs.tolist():
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    found = [(r, x) for x in root if (r := find(x)) != x]
    return np.array(found, np.int64).reshape(-1, 2)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (u < v) of the distinct nodes.fp that connect fingerprints which differ in at most `bits` bits.

    All links of up to 4 differing bits are found. Each fingerprint goes to at most 17 anchors a half whatever its group's
    size; what meets at an anchor is streamed in order and compared there, so no task emits all pairs of a large group. A run
    of more than LONG_RUN at one anchor isn't held: its members pass on and meet again by blocks of their other half.
    """
    if bits > BITS:
        raise ValueError("the covering is of 4 differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2048):
                keys, owner = anchors(part := fps[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owner])], ["anchor", "fp"])

    def found(a: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = _links(a, f.view(np.uint64), bits)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["key", "u", "v"])

    def passed(a: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 4096):
            keys, owner = _dealt(a[at : at + 4096], f[at : at + 4096, 0].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(f[at : at + 4096, 0][owner]), pa.nulls(len(keys), pa.int64())], ["key", "u", "v"])

    def meet(most: int | None):
        """Compares runs of equal keys, held until the next key comes; of one of more than `most` members, all are passed on."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, long = [], 0, None  # rows of the last key; the key that is known as long
            for batch in batches:
                a, f = batch.column(0).to_numpy(zero_copy_only=False), np.stack([batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
                if not len(a):
                    continue
                if long is not None:
                    k = int(np.searchsorted(a, long, "right"))
                    yield from passed(a[:k], f[:k])
                    a, f = a[k:], f[k:]
                    if not len(a):
                        continue
                    long = None
                cut = np.searchsorted(a, a[-1])
                if cut or held and held[-1][0][-1] != a[-1]:  # what is held and comes before the batch's last key is whole
                    held.append((a[:cut], f[:cut]))
                    yield from found(*(np.concatenate(x) for x in zip(*held)))
                    held, n = [], 0
                held.append((a[cut:], f[cut:]))
                n += len(a) - cut
                if most is not None and n > most:
                    same = [np.concatenate(x) for x in zip(*held)]
                    k = int(np.searchsorted(same[0], a[-1]))  # rows of other keys before it are none: they went with the cut
                    yield from passed(same[0][k:], same[1][k:])
                    held, n, long = [], 0, a[-1]
            if held:
                yield from found(*(np.concatenate(x) for x in zip(*held)))

        return run

    schema = "key long, u long, v long"
    spread_out = arrow_map(nodes.select("fp"), spread, "anchor long, fp long")
    met = written(arrow_map(spread_out.repartition("anchor").sortWithinPartitions("anchor"), meet(LONG_RUN), schema))
    again = met.where("key IS NOT NULL").select("key", "u")
    more = arrow_map(again.repartition("key").sortWithinPartitions("key"), meet(None), schema)
    return met.where("key IS NULL").union(more).select("u", "v").distinct()


def _dealt(anchor: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which members of a long run at an anchor meet again, and the member of each.

    The half that isn't the anchor's is cut into six blocks; of two members that differ in at most 4 bits at least two blocks
    agree. So each member has a key for each two of them: about 11 bits, by which the run is split into some 1,500 parts.
    """
    half = (fps >> np.where(anchor >> 33 == 0, 32, 0).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    cuts = [32 * i // 6 for i in range(7)]
    blocks = [half >> np.uint64(a) & np.uint64((1 << b - a) - 1) for a, b in zip(cuts, cuts[1:])]
    keys = []
    for n, (i, j) in enumerate(combinations(range(6), 2)):
        made = anchor.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (blocks[i] << np.uint64(10) | blocks[j] << np.uint64(4) | np.uint64(n))
        made = (made ^ made >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append((made ^ made >> np.uint64(29)).view(np.int64))
    return np.concatenate(keys), np.tile(np.arange(len(fps)), len(keys))


def components(edges: DataFrame) -> DataFrame:
    """node and root, one root for each connected component of the edges (u, v; a written table), for every node of an edge.

    Contraction: every node is replaced by the least of itself and its neighbours, until no edge is left. Node
    numbers are hashes, so a constant share of the nodes goes in each round, whatever the shape of the component.
    Each round's tables are written to the shared folder; nothing is collected.
    """
    roots = None
    while n := edges.count():
        both = edges.union(edges.select("v", "u"))
        to = written(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("to")), rows=2 * n)
        if roots is None:
            roots, of = to.select("node", F.col("to").alias("root")), 2 * n
        else:
            roots = written(roots.join(to.withColumnRenamed("node", "root").hint("merge"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), rows=of)
        u = edges.join(to.select(F.col("node").alias("u"), F.col("to").alias("a")).hint("merge"), "u").select("v", "a")
        ends = u.join(to.select(F.col("node").alias("v"), F.col("to").alias("b")).hint("merge"), "v").where("a <> b")
        edges = written(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), rows=n)
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, words: int = WORDS) -> DataFrame:
    """id_col, fp and component_id (the least id reachable over links of at most `bits` differing bits) of each row.

    Repeated rows and texts have one fingerprint and so one component. A null or empty text has fingerprint 0 and is
    linked like any other. A null id is never a component's name unless all its ids are null. Other columns don't matter.
    """
    return _grouped(fingerprints(df, id_col, text_col, words), id_col, bits)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fp and component_id as near_duplicates, over links of similarity 0.8 or more of five-word shingles.

    fp is of the set of shingles. Candidates are what `links` finds at the anchors of the texts' SimHash, and, as texts of that
    similarity differ in more bits than the covering reaches, pairs that agree in a band of MinHash: a pair of similarity
    0.8 is missed by (1 - 0.8 ** ROWS) ** BANDS, 5 in 10,000, whatever was edited, cut off or put on, more alike ones more
    rarely. Only candidates whose texts have that similarity, counted exactly, are links.

    Runs of more than SHORT_RUN texts in a band are split into parts of about PART. There, texts are linked with a hub in the
    middle of the part, and hubs of all parts with each other; then what is still outside a run's largest component streams
    past every part, and what bitmaps can't prove to be less similar is compared by text. So no task holds a large run or
    makes all its pairs, and no link is left out.
    """
    docs = written(_sketched(df, id_col, text_col))
    total = docs.count()
    pick = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "body"))
    first = docs.groupBy("fp").agg(pick.alias("pick"), *(F.any_value(c).alias(c) for c in ("n", "keys", "sim", "bits")))
    nodes = written(first.select("fp", F.col("pick.id").alias("least"), "pick.body", "n", "keys", "sim", "bits"), rows=total)
    met = written(arrow_map(nodes.select(F.explode("keys").alias("key"), "fp", "n").repartition("key").sortWithinPartitions("key", "fp"), _runs, "key long, u long, v long"))
    sized, pairs = nodes.select("fp", "n", "bits"), met.where("v IS NOT NULL").select("u", "v").union(_by_simhash(nodes))
    members = met.where("v IS NULL").select("key", F.col("u").alias("fp"))
    some = members.count()
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    long = written(members.join(parts, "key").join(sized, "fp").select("key", "parts", part.alias("part"), "fp", "n", "bits"), rows=some)
    if some:
        stars = written(_by_group(long, F.xxhash64("key", "part"), _stars, "key long, u long, v long"), rows=2 * some)
        hubs = stars.select("key", F.col("u").alias("fp")).distinct().join(sized, "fp")
        pairs = pairs.union(stars.select("u", "v")).union(_by_group(hubs, F.col("key"), _stars, "key long, u long, v long").select("u", "v"))
    pairs = written(pairs.distinct(), rows=met.count() + 2 * total + 4 * some)
    edges = _alike(df, id_col, text_col, nodes, pairs)
    roots = components(edges)
    if some:
        rooted = written(long.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), rows=some)
        main = rooted.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
        outside = rooted.join(main, "key").where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = rooted.withColumn("asks", F.lit(0)).unionByName(outside.drop("main").withColumn("asks", F.lit(1)))
        rest = written(_by_group(both, F.xxhash64("key", "part"), _across, "u long, v long", ("asks", "root")).distinct().join(pairs, ["u", "v"], "left_anti"))
        if rest.take(1):
            edges = edges.union(_alike(df, id_col, text_col, nodes, rest))
            roots = components(written(edges, rows=edges.count()))
    return _named(docs, nodes, roots, id_col, total)


def _simhash(found: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes; 0 without any."""
    if not len(found):
        return 0
    octets = found.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BIT for j in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(octets)).tobytes(), "big")


def parities(found: np.ndarray) -> bytes:
    """A bitmap of a set of hashes: whether an odd number of them falls on each place. It has 256 bits or four a hash and
    more, a power of two. Two sets differ in at least as many hashes as their bitmaps, folded to one width, in bits."""
    size = max(256, 1 << (4 * len(found)).bit_length())
    odd = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _folded(bits: np.ndarray) -> np.ndarray:
    """Rows of bitmaps (of 64-bit words) at half their width."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def _sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, body (a hash of the text), fp (of the set of shingles; 0 without words), n (its size), sim (its SimHash), bits
    (its parities) and keys (of its bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            keys = [band_keys(x) for x in sets]
            longs = [np.array([f(x) for x in sets], np.uint64).view(np.int64) for f in (lambda x: xxhash.xxh3_64_intdigest(x.tobytes()) if len(x) else 0, len, _simhash)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, longs), pa.array(map(parities, sets), pa.binary()), lists], [id_col, "body", "fp", "n", "sim", "bits", "keys"])

    rows = df.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"))
    return arrow_map(rows, run, f"`{id_col}` {kind_of(df, id_col)}, body long, fp long, n long, sim long, bits binary, keys array<long>")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash is one or linked at the anchors: the least node of each value stands for the others."""
    least = nodes.where("n > 0").groupBy("sim").agg(F.min("fp").alias("u"))
    same = nodes.where("n > 0").join(least, "sim").where("fp <> u").select("u", F.col("fp").alias("v"))
    near = links(least.select(F.col("sim").alias("fp")))
    of = lambda c: least.select(F.col("sim").alias(c), F.col("u").alias(f"of_{c}"))
    found = near.join(of("u"), "u").join(of("v"), "v").select(F.least("of_u", "of_v").alias("u"), F.greatest("of_u", "of_v").alias("v"))
    return same.union(found)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows key, fp and n sorted by key: all pairs of short runs whose sizes allow the similarity (no key), and the members
    of longer ones (no v), which are passed on as they come."""

    def pairs(key: np.ndarray, fp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        us, vs = [], []
        for k in range(1, SHORT_RUN):
            if len(key) <= k or not (same := key[k:] == key[:-k]).any():
                break
            i = np.flatnonzero(same)
            i = i[(5 * np.minimum(n[i], n[i + k]) >= 4 * np.maximum(n[i], n[i + k])) & (fp[i] != fp[i + k])]
            us.append(np.minimum(fp[i], fp[i + k]))
            vs.append(np.maximum(fp[i], fp[i + k]))
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (us, vs))
        return pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.array(u), pa.array(v)], ["key", "u", "v"])

    def members(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.nulls(len(key), pa.int64())], ["key", "u", "v"])

    held, long = [np.empty(0, np.int64)] * 3, None  # the last key's rows that were not passed on; the key that is known as long
    for batch in batches:
        rows = [np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns)]
        if not len(rows[0]):
            continue
        last = len(rows[0]) - int(np.searchsorted(rows[0], rows[0][-1]))
        starts = np.r_[0, np.flatnonzero(np.diff(rows[0])) + 1]
        lengths = np.diff(np.r_[starts, len(rows[0])])
        many = np.repeat((lengths > SHORT_RUN) | (rows[0][starts] == long), lengths) if long is not None else np.repeat(lengths > SHORT_RUN, lengths)
        wait = np.zeros(len(many), bool) if many[-1] else np.arange(len(many)) >= len(many) - last
        yield members(rows[0][many], rows[1][many])
        yield pairs(*(c[~many & ~wait] for c in rows))
        long = int(rows[0][-1]) if many[-1] else None
        held = [c[wait] for c in rows]
    yield pairs(*held)


def _by_group(rows: DataFrame, group: Column, fn: Callable[[Iterator[dict]], Iterator[list]], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """What fn yields (columns of longs) of the rows of each group, which come in batches: columns by name, in order of the
    columns in more."""
    names = [x.split()[0] for x in schema.split(", ")]
    columns = ["group", *more, "key", "fp", "n", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict]:
            for batch in batches:
                key = batch.column(0).to_numpy(zero_copy_only=False)
                bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
                for a, b in zip(bounds, bounds[1:]):
                    if a < b:
                        yield {c: batch.column(i)[a:b].to_numpy(zero_copy_only=False) for i, c in enumerate(columns)}

        for _, group_parts in groupby(parts(), key=lambda p: int(p["group"][0])):
            for found in fn(group_parts):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names)

    chosen = rows.select(group.alias("group"), *more, "key", "fp", "n", "bits")
    return arrow_map(chosen.repartition("group").sortWithinPartitions("group", *more[:1]), run, schema)


def _joined(parts: Iterator[dict]) -> dict:
    held = list(parts)
    return {c: np.concatenate([p[c] for p in held]) for c in held[0]}


class _Bitmaps:
    """Members of a part by the width of their bitmaps, which are compared with those of that width or twice that."""

    def __init__(self, rows: dict) -> None:
        self.rows, widths = rows, np.array([len(x) for x in rows["bits"]])
        self.own = {w: (at := np.flatnonzero(widths == w), np.frombuffer(b"".join(rows["bits"][at]), np.uint64).reshape(-1, w // 8)) for w in np.unique(widths).tolist()}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and bitmaps of this width of the members that have it or twice that."""
        places, bits = self.own.get(width, (np.empty(0, np.int64), np.empty((0, width // 8), np.uint64)))
        if 2 * width in self.own:
            more, wide = self.own[2 * width]
            return np.r_[places, more], np.vstack([bits, _folded(wide)])
        return places, bits


def _may(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose bitmaps differ so may share 0.8 of their union: 9 * shared >= 4 * (n + m)."""
    return 9 * apart <= n + m


def _stars(parts: Iterator[dict]) -> Iterator[list]:
    """key, hub and member: each member that may be similar with the one nearest to what most bitmaps have; then what is left
    in the same way, until a hub finds none."""
    rows = _joined(parts)
    bitmaps, fp, n = _Bitmaps(rows), rows["fp"], rows["n"]
    for width in bitmaps.own:
        places, bits = bitmaps.at(width)
        while len(places) > 1:
            most = np.zeros(bits.shape[1] * 64, np.int64)
            for i in range(0, len(bits), 1024):
                most += np.unpackbits(bits[i : i + 1024].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
            middle = np.packbits(2 * most > len(bits)).view(np.uint64)
            hub = int(_apart(bits, middle[None, :]).argmin())
            near = _may(n[places], n[places[hub]], _apart(bits, bits[hub][None, :]))
            near[hub] = False
            if not near.any():
                break
            u, v = fp[places[hub]], fp[places[near]]
            yield [np.full(len(v), rows["key"][0]), np.full(len(v), u), v]
            near[hub] = True
            places, bits = places[~near], bits[~near]


def _across(parts: Iterator[dict]) -> Iterator[list]:
    """Pairs of the part's own members (asks 0, which come first) and those outside the run's largest component (asks 1), of
    different components, that may be similar."""
    own: list[dict] = []
    bitmaps = None
    for part in parts:
        asks = part["asks"] == 1
        if not asks.all():
            own.append({c: v[~asks] for c, v in part.items()})
        if not asks.any() or not own:
            continue
        if bitmaps is None:
            rows = _joined(own)
            bitmaps, fp, n, root = _Bitmaps(rows), rows["fp"], rows["n"], rows["root"]
            at = {w: bitmaps.at(w) for w in {x for w in bitmaps.own for x in (w // 2, w)} if w >= 32}
        us, vs = [], []
        for i in np.flatnonzero(asks):
            mine = np.frombuffer(part["bits"][i], np.uint64)[None, :]
            for width, bits in ((8 * mine.shape[1], mine), (4 * mine.shape[1], _folded(mine))):
                if width == 8 * mine.shape[1]:
                    places, others = at.get(width, (np.empty(0, np.int64), np.empty((0, 1), np.uint64)))
                else:
                    places, others = bitmaps.own.get(width, (np.empty(0, np.int64), np.empty((0, 1), np.uint64)))
                if len(places):
                    ok = places[_may(n[places], part["n"][i], _apart(others, bits)) & (root[places] != part["root"][i])]
                    us.append(np.minimum(fp[ok], part["fp"][i]))
                    vs.append(np.maximum(fp[ok], part["fp"][i]))
        if us:
            yield [np.concatenate(us), np.concatenate(vs)]


def _bounded(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that bitmaps can't prove to be less similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            apart = np.zeros(len(n), np.int64)
            for i, (a, b) in enumerate(zip(*(batch.column(j).to_pylist() for j in (4, 5)))):
                a, b = (np.frombuffer(x, np.uint64)[None, :] for x in (a, b))
                while a.shape[1] != b.shape[1]:
                    a, b = (a, _folded(b)) if a.shape[1] < b.shape[1] else (_folded(a), b)
                apart[i] = int(np.bitwise_count(a ^ b).sum())
            yield batch.select([0, 1]).filter(pa.array(_may(n, m, apart)))

    of = lambda c: nodes.select(F.col("fp").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"))
    both = pairs.join(of("u").hint("merge"), "u").join(of("v").hint("merge"), "v")
    return arrow_map(both.select("u", "v", "nu", "nv", "bu", "bv"), run, "u long, v long")


def _alike(df: DataFrame, id_col: str, text_col: str, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between texts that share at least 0.8 of the shingles of both: of the pairs given, as many as connect what all of
    them would. First each v is compared with one u; pairs within what that connects needn't be compared, all others are."""
    pairs = written(_bounded(nodes, pairs), rows=pairs.count())
    n = pairs.count()
    needed = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct()
    names = written(nodes.join(needed.hint("merge"), "fp").select("fp", F.col("least").alias("__least"), F.col("body").alias("__body")), rows=2 * n)
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__body"))
    found = rows.join(names.hint("merge"), (rows["__body"] == names["__body"]) & F.col("__id").eqNullSafe(F.col("__least")))
    texts = written(found.select("fp", F.col("__text").alias("text")))
    if texts.count() > names.count():  # rows that are repeated
        texts = written(texts.groupBy("fp").agg(F.any_value("text").alias("text")))
    first = written(pairs.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), rows=n)
    edges = _verified(texts, first)
    root = components(edges)
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")).hint("merge")
    left = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where(F.coalesce("ru", "u") != F.coalesce("rv", "v"))
    left = written(left.select("u", "v").join(first.hint("merge"), ["u", "v"], "left_anti"), rows=n)
    return written(edges.union(_verified(texts, left)), rows=n) if left.take(1) else edges


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose texts (fp, text) share at least 0.8 of the shingles of both.

    Each row that moves has one text: v's goes to u's, whose shingles are held while the texts of its partners stream past; a
    u of more than PART partners is worked on in so many parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.empty(0, np.uint64)
        for batch in batches:
            keep, vs = [], batch.column(1).to_pylist()
            for i, v in enumerate(vs):
                b = shingles(batch.column(2)[i].as_py())
                if v is None:
                    a = b
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 5 * both >= 4 * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    parts = written(pairs.groupBy("u").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), rows=pairs.count())
    parts = parts.hint("merge")  # tables that grow with the texts are dealt by key at every size: plans are those of large inputs
    one = texts.join(parts.withColumnRenamed("u", "fp"), "fp").select(F.col("fp").alias("u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "text")
    sent = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    sent = sent.join(texts.select(F.col("fp").alias("v"), "text").hint("merge"), "v").select("u", "part", "v", "text")
    met = one.union(sent).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return written(arrow_map(met.select("u", "v", "text"), run, "u long, v long"))


def _grouped(fps: DataFrame, id_col: str, bits: int) -> DataFrame:
    docs = written(fps, narrow=True)
    total = docs.count()
    nodes = written(docs.groupBy("fp").agg(F.min(id_col).alias("least")), rows=total)
    return _named(docs, nodes, components(written(links(nodes, bits))), id_col, total)


def _named(docs: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str, total: int) -> DataFrame:
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), rows=total)
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), rows=total)
    named = written(rooted.join(named.hint("merge"), "root").select("fp", "component_id"), rows=total)
    return docs.join(named.hint("merge"), "fp").select(id_col, "fp", "component_id")


def without_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, one of each group of similar_groups: that of the least id (nulls last, then by a hash of the text).

    Only fingerprints and names move but for one shuffle of df by id and hash. Columns are told apart by their place, so any
    names may stand in df. Repeated rows leave one; an empty table gives no rows.
    """
    names = [f"__{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    key, text = (names[df.columns.index(c)] for c in (id_col, text_col))
    body = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    name = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), body.alias("body"))
    groups = similar_groups(plain.select(name.alias("__name"), F.col(text).alias("__text")), "__name", "__text")
    chosen = groups.select("component_id").distinct().select(F.col("component_id.id").alias("__id"), F.col("component_id.body").alias("__body"))
    chosen = written(chosen)
    rows = plain.withColumn("__key", body)
    on = F.col(key).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__body"))
    found = rows.join(chosen.hint("merge"), on)
    if rows.groupBy(key, "__key").count().where("count > 1").join(chosen, on, "left_semi").take(1):
        found = found.dropDuplicates([key, "__key"])
    return found.select(*names).toDF(*df.columns)


def hex64(fp: Column) -> Column:
    """The 16 lower-case hexadecimal digits of a signed long's bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
