"""Repair of conversations: faults of turns, and the cheapest edits that make roles a legal sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, written

#: Turns of one conversation that are worked on at once; longer conversations are cut into blocks of so many.
BLOCK = 256
SPACES = "\x09\x0a\x0b\x0c\x0d\x20"

# Grammar `(s?(ua)+)?`: nothing yet, after the system turn, after a user's turn, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State to the state after each role's initial that may follow.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: State to the initial that an insertion or a new role has there, and its role.
DUE = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
#: Costs of edits, and of a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: More than any cost of a conversation.
NEVER = 1 << 60
ENDS = (0, NEVER, NEVER, 0)

OK, BLANK, DUPLICATE, CUT = range(4)


def _edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits of a turn in a state, in ASCII order."""
    yield "D", DELETE, state
    if fault not in (BLANK, DUPLICATE):
        stays = TRUNCATED if fault == CUT else 0
        if initial in NEXT[state]:
            yield "K", stays, NEXT[state][initial]
        yield "R", REROLE + stays, NEXT[state][DUE[state]]


def _inserting(costs: Sequence[int]) -> list[int]:
    """Costs to go when turns may be inserted first: from any state at most two insertions lead to any that they reach."""
    out = list(costs)
    for _ in range(2):
        out = [min(c, INSERT + out[NEXT[q][DUE[q]]]) for q, c in enumerate(out)]
    return out


def costs_to_go(turns: Sequence[tuple[str, int]], after: Sequence[int] = ENDS) -> list[list[int]]:
    """Costs to go by position and state, from the last turn back; turns are (initial, fault), `after` the costs behind them."""
    out = [_inserting(after)]
    for initial, fault in reversed(turns):
        behind = out[-1]
        out.append(_inserting([min(cost + behind[to] for _, cost, to in _edits(q, initial, fault)) for q in range(4)]))
    return out[::-1]


def walk(turns: Sequence[tuple[str, int]], costs: list[list[int]], state: int, last: bool = True) -> tuple[list[tuple[str, int, str]], int]:
    """The ASCII-least of the cheapest edits from a state: (edit, turn or -1, initial), and the state behind them.

    Each edit taken is cost-tight; its letter fixes the state that follows, so taking the least letter at each step gives the
    least text. What is inserted behind the last turn is left to the next block, unless this is the last.
    """
    out, i = [], 0
    while i < len(turns) or last:
        left = costs[i][state]
        found = {}
        if i < len(turns):
            for edit, cost, to in _edits(state, *turns[i]):
                if cost + costs[i + 1][to] == left:
                    found[edit] = (i, turns[i][0] if edit == "K" else DUE[state], to)
        elif left == 0 or left >= NEVER:
            break
        if INSERT + costs[i][NEXT[state][DUE[state]]] == left:
            found["I"] = (-1, DUE[state], NEXT[state][DUE[state]])
        edit = min(found)
        at, initial, state = found[edit]
        out.append((edit, at, initial))
        i += at >= 0
    return out, state


def truncated(text: str) -> bool:
    return text.rstrip(SPACES)[-1:] not in (".", "!", "?")


def faults(rows: Sequence[dict], seen: Sequence[bytes] = ()) -> tuple[list[int], list[bytes]]:
    """First fault of each turn, and the digests of role and text of the turns that aren't blank; seen: those met before."""
    out, known, own = [], set(seen), []
    for r in rows:
        if not r["text"].strip(SPACES):
            out.append(BLANK)
            continue
        digest = hashlib.sha256(f"{len(r['role'])}:{r['role']}{r['text']}".encode("utf-8", "surrogatepass")).digest()[:16]
        out.append(DUPLICATE if digest in known else CUT if truncated(r["text"]) else OK)
        if digest not in known:
            own.append(digest)
        known.add(digest)
    return out, own


_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_BLOCK = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(_TURN))])
_DONE = pa.schema([
    ("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("distinct", pa.int64()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))),
])
_DDL = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string", pa.binary(): "binary"}


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{', '.join(f'{f.name}: {_ddl(f.type)}' for f in kind)}>"
    return _DDL[kind]


def _schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema)


#: Characters of texts that a batch handed to Spark holds, about.
CHARS = 1 << 22


def _batches(rows: Iterator[dict], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += size(r)
        if chars > CHARS or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def blocks(df: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK turns, in order: conv, part and seq (their order), whole and turns. df: conv, turn, role, text,
    alive (others only keep their conversation).

    Rows are dealt by range of conversation and turn, so a conversation of any length is spread over tasks. whole: the block
    surely holds all turns of its conversation, as others stand before and behind it in its task.
    """

    def cut(batches) -> Iterator[dict]:
        conv, held, seq, started, edge = None, [], 0, False, True

        def block(whole: bool) -> dict:
            return {"conv": conv, "part": part, "seq": seq, "whole": whole, "turns": held}

        part = 0
        for batch in batches:
            for r in batch.to_pylist():
                part = r["part"]
                if started and r["conv"] != conv:
                    yield block(not edge)
                    held, seq, edge = [], seq + 1, False
                elif len(held) >= BLOCK:
                    yield block(False)
                    held, seq, edge = [], seq + 1, True
                conv, started = r["conv"], True
                if r["alive"]:
                    held.append({k: r[k] for k in ("turn", "role", "text")})
        if started:
            yield block(False)

    def run(batches):
        return _batches(cut(batches), _BLOCK, lambda b: sum(len(t["text"]) for t in b["turns"]))

    key = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    ranged = df.select("conv", "turn", "role", "text", "alive").repartitionByRange(*key, F.substring("text", 1, 64))
    return written(arrow_map(ranged.sortWithinPartitions(*key, "text").withColumn("part", F.spark_partition_id()), run, _schema(_BLOCK)))


def _stretch(block: dict, found: list[int], edits: list[tuple[str, int, str]], cost: int) -> dict:
    """What a block adds to its conversation, with its rebuilt turns."""
    rows = block["turns"]
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    rebuilt = [{"edit": e, "turn": rows[i]["turn"] if i >= 0 else None, "role": rows[i]["role"] if e == "K" else ROLES[c], "text": rows[i]["text"] if i >= 0 else ""} for e, i, c in edits if e != "D"]
    return {
        **{k: block[k] for k in ("conv", "part", "seq")}, "whole": block.get("whole", False), "n": len(rows), "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(CUT),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "distinct": len(set(turns)), "first": initials[0] if rows else None, "last": initials[-1] if rows else None,
        "low": min(turns, default=None), "high": max(turns, default=None), "cost": cost, "audit": "".join(e for e, _, _ in edits), "repaired": rebuilt,
    }


def _chars(r: dict) -> int:
    return sum(len(t["text"]) for t in r.get("repaired", r.get("turns", ())))


def _mended_whole(of: DataFrame) -> DataFrame:
    def mend(block: dict) -> dict:
        found, _ = faults(block["turns"])
        turns = [(r["role"][:1], f) for r, f in zip(block["turns"], found)]
        costs = costs_to_go(turns)
        return _stretch(block, found, walk(turns, costs, START)[0], costs[0][START])

    return arrow_map(of, lambda batches: _batches((mend(b) for batch in batches for b in batch.to_pylist()), _DONE, _chars), _schema(_DONE))


#: Between the passes over a long conversation's blocks: faults, their initials, and the costs from each state to each.
_FACTS = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("initials", pa.string()), ("faults", pa.string()), ("through", pa.list_(pa.list_(pa.int64())))])
_AFTER = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("initials", pa.string()), ("faults", pa.string()), ("after", pa.list_(pa.int64())), ("final", pa.bool_()), ("exits", pa.list_(pa.int64()))])
_ENTER = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("faults", pa.string()), ("after", pa.list_(pa.int64())), ("final", pa.bool_()), ("state", pa.int64())])


def _scanned(of: DataFrame, forward: bool, step, schema: pa.Schema) -> DataFrame:
    """A row for each block, in the order of its conversation (or backwards), by step(block, what came before or None): (row, what
    is handed on). A conversation's blocks meet in one task as rows without texts, one for BLOCK turns, and stream through it."""

    def run(batches):
        def rows():
            conv, held, started = None, None, False
            for batch in batches:
                for b in batch.to_pylist():
                    if not started or b["conv"] != conv:
                        conv, held, started = b["conv"], None, True
                    row, held = step(b, held)
                    yield row

        return _batches(rows(), schema, lambda r: BLOCK)

    way = (lambda c: F.col(c).asc_nulls_first()) if forward else (lambda c: F.col(c).desc_nulls_last())
    return written(arrow_map(of.repartition("conv").sortWithinPartitions(*map(way, ("conv", "part", "seq"))), run, _schema(schema)))


def _mended_long(of: DataFrame) -> DataFrame:
    """Conversations of several blocks: a digest's first block makes it a duplicate in later ones; costs go backwards over blocks by
    their costs from state to state, states forwards, and each block's edits are walked where its turns are."""

    def digests(batches):
        for batch in batches:
            rows = [{"conv": b["conv"], "part": b["part"], "seq": b["seq"], "digest": d} for b in batch.to_pylist() for d in faults(b["turns"])[1]]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*list(_BLOCK)[:3], ("digest", pa.binary())]))

    def facts(batches):
        def rows():
            for batch in batches:
                for b in batch.to_pylist():
                    found, _ = faults(b["turns"], b["seen"])
                    turns = [(r["role"][:1], f) for r, f in zip(b["turns"], found)]
                    through = [costs_to_go(turns, [0 if q == to else NEVER for q in range(4)])[0] for to in range(4)]
                    # "?" stands for an empty initial, and for any that no state takes
                    yield {**{k: b[k] for k in ("conv", "part", "seq")}, "initials": "".join(i if i in ("s", "u", "a") else "?" for i, _ in turns), "faults": "".join(map(str, found)), "through": [[through[to][q] for to in range(4)] for q in range(4)]}

        return _batches(rows(), _FACTS, lambda r: BLOCK)

    def back(b: dict, after):
        behind = list(ENDS) if after is None else after
        here = [min(min(a + c for a, c in zip(way, behind)), NEVER) for way in b["through"]]
        turns = list(zip(b["initials"], map(int, b["faults"])))
        costs = costs_to_go(turns, behind)
        exits = [walk(turns, costs, q, after is None)[1] if costs[0][q] < NEVER else q for q in range(4)]
        return {**{k: b[k] for k in ("conv", "part", "seq", "initials", "faults")}, "after": behind, "final": after is None, "exits": exits}, here

    def on(b: dict, state):
        state = START if state is None else state
        return {k: b[k] for k in ("part", "seq", "faults", "after", "final")} | {"state": state}, b["exits"][state]

    def mend(b: dict) -> dict:
        found = list(map(int, b["faults"]))
        turns = [(r["role"][:1], f) for r, f in zip(b["turns"], found)]
        costs = costs_to_go(turns, b["after"])
        edits, state = walk(turns, costs, b["state"], b["final"])
        return _stretch(b, found, edits, costs[0][b["state"]] - (0 if b["final"] else costs[-1][state]))

    at = ["conv", "part", "seq"]
    own = arrow_map(of.select(*at, "turns"), digests, "conv bigint, part int, seq bigint, digest binary")
    first = own.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq")).alias("one"), F.count("*").alias("n")).where("n > 1")
    again = own.join(first.select(F.col("conv").alias("c"), F.col("digest").alias("d"), "one"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where(F.struct("part", "seq") > F.col("one"))
    seen = again.groupBy("part", "seq").agg(F.collect_list("digest").alias("seen"))
    with_seen = of.join(seen, ["part", "seq"], "left").select(*at, "turns", F.coalesce("seen", F.array().cast("array<binary>")).alias("seen"))
    after = _scanned(arrow_map(with_seen, facts, _schema(_FACTS)), False, back, _AFTER)
    enter = _scanned(after, True, on, _ENTER)
    return arrow_map(of.join(enter, ["part", "seq"]).select(*at, "turns", "faults", "after", "final", "state"), lambda batches: _batches((mend(b) for batch in batches for b in batch.to_pylist()), _DONE, _chars), _schema(_DONE))


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", alive: Column | None = None) -> DataFrame:
    """A row for each block of a conversation: conv, part, seq (order), whole, n, blank, duplicate, truncated, illegal (within it), distinct
    turns, first and last initial, low and high turn, cost, audit and repaired: its rebuilt turns (edit, turn, role, text).

    Turns are taken by their number, nulls first, ties by role and text. Null roles and texts are one space. Rows that aren't
    alive (a null counts as not) only keep their conversation, which then may have no edits; a null conversation is one like
    any other. Repeated rows are duplicates. Conversations of up to BLOCK turns are mended where they stand, after one
    shuffle; of longer ones, or those on the edge of a task, blocks also exchange costs and states, without texts.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))).alias("alive"))
    cut = blocks(plain)
    return _mended_whole(cut.where("whole")).union(_mended_long(cut.where("not whole")))


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text and alive: rows damaged by crc32 of `conversation:turn` modulo 20 (0 drops the row, 1 empties its
    text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes it a user's). Nulls are one space, in the key too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    body, role = text(text_col), text(role_col)
    hit = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(how == 4, "user").otherwise(role).alias("role"),
        F.when(how == 1, "").when(how == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"), (how != 0).alias("alive"), F.explode(F.sequence(F.lit(1), F.when(how == 3, 2).otherwise(1))).alias("copy"),
    )
    return hit.drop("copy")


def report(blocks_: DataFrame) -> DataFrame:
    """A row for each conversation of repaired(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Blocks of whole conversations are digested where they are; those of longer ones stream through the task of their
    conversation in order (a SHA-256 can't be put together from parts), each block's lines as one text.
    """
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    fields = ["conv", "part", "seq", "n", "blank", "duplicate", "truncated", "illegal", "distinct", "first", "last", "low", "high", "cost", "audit"]
    out = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def joined(batches):
        def row(s: dict) -> dict:
            gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]
            return {"conv_id": s["conv"], "gaps": gaps, **{k: s[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(s["audit"]), "repaired_sha256": s["digest"].hexdigest()}

        def rows():
            s = None
            for batch in batches:
                for b in batch.to_pylist():
                    if s is None or s["conv"] != b["conv"]:
                        if s is not None:
                            yield row(s)
                        s = {"conv": b["conv"], "low": None, "high": None, "last": None, "distinct": 0, "audit": [], "digest": hashlib.sha256(), "any": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                    for k in ("blank", "duplicate", "truncated", "illegal", "cost", "distinct"):
                        s[k] += b[k]
                    if b["n"]:
                        s["illegal"] += s["last"] is not None and s["last"] + b["first"] not in ("su", "ua", "au")
                        s["last"] = b["last"]
                    if b["low"] is not None:
                        s["distinct"] -= b["low"] == s["high"]
                        s["low"], s["high"] = b["low"] if s["low"] is None else s["low"], b["high"]
                    if b["size"]:
                        s["digest"].update(("\n" if s["any"] else "").encode() + b["lines"].encode())
                        s["any"] = True
                    s["audit"].append(b["audit"])
            if s is not None:
                yield row(s)

        return _batches(rows(), out, lambda r: len(r["audit"]))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    whole = blocks_.where("whole").select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    one = blocks_.where("not whole").select(*fields, lines.alias("lines"), F.size("repaired").alias("size"))
    apart = one.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "seq")
    return whole.union(arrow_map(apart, joined, _schema(out)))


def turns(blocks_: DataFrame) -> DataFrame:
    """The rebuilt turns of repaired(): conv_id, part, seq, at (their order), edit, turn (null if inserted), role, text."""
    return blocks_.select(F.col("conv").alias("conv_id"), "part", "seq", F.posexplode("repaired").alias("at", "t")).select("conv_id", "part", "seq", "at", "t.*")
