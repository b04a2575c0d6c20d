import hashlib
import heapq
import random
import re
import zlib

from areasignal.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, alive string, conv string, part string"
NOISE = ("x", "y", "z")


def damage(rows):
    out = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if how == 0:
            continue
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        out += [(c, t, "user" if how == 4 else r, x)] * (2 if how == 3 else 1)
    return out


def cheapest(turns):
    """Uniform-cost search over whole edit texts: (cost, audit, lines)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles.lstrip("s")[-1:] or roles[-1:]
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        moves = [("I", 2, i, "user", ""), ("I", 2, i, "assistant", "")]
        if i < len(turns):
            fault, role, text = turns[i]
            moves.append(("D", 3, i + 1, None, ""))
            if fault in ("", "t"):
                more = fault == "t"
                moves += [("K", more, i + 1, role, text)] + [("R", 2 + more, i + 1, r, text) for r in ("user", "assistant")]
        for edit, add, to, role, text in moves:
            longer = roles if role is None else roles + role[:1]
            if role is None or (role[:1] and re.fullmatch("s?(ua)*u?", longer)):
                heapq.heappush(heap, (cost + add, audit + edit, to, longer, lines if role is None else (*lines, f"{role}:{text}")))


def brute(rows):
    hurt, out = damage(rows), []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns = set(), []
        for _, _, role, text in mine:
            core = text.strip("\x09\x0a\x0b\x0c\x0d\x20")
            turns.append(("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "", role, text))
            seen.add((role, text))
        at = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest(turns)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        kinds = [t[0] for t in turns]
        out.append((conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, *NOISE) for r in rows], SCHEMA)
    hurt = C.damaged(df)
    return sorted((tuple(r) for r in C.report(C.repaired(hurt, alive=C.F.col("alive"))).collect()), key=repr)


def drawn(seed, sizes):
    rng, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for turn in range(n):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None))
            text = rng.choice(("Yes.", "No!", "And", "  ", "", None, f"It is {turn}.", f"So {turn % 7}?", "Grüße. \n"))
            rows.append((conv if conv % 5 else None, turn * rng.choice((1, 1, 2)) if rng.random() > 0.05 else None, role, text))
    return rows


def test_against_search_over_edit_texts(spark):
    rows = drawn(1, [0, 1, 2, 3, 4, 5, 6, 8, 9, 12] * 4)
    assert run(spark, rows) == brute(rows)


def test_blocks_of_long_conversations(spark, monkeypatch):
    """Costs, states, duplicates, adjacent roles and turns go over the edges of blocks and tasks."""
    monkeypatch.setattr(C, "BLOCK", 3)
    rows = drawn(2, [1, 40, 7, 90, 3, 2, 30])
    assert run(spark, rows) == brute(rows)
    same = [(7, t, "user" if t % 2 == 0 else "assistant", "Again.") for t in range(60)] + [(8, 0, "user", "Hi.")]
    assert run(spark, same) == brute(same)


def test_edge_rows(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 5, "user", "word " * 200_000), (2, 5, "user", "word " * 200_000), (2, 9, "assistant", "End.")]
    assert run(spark, rows) == brute(rows)
    lost = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(lost, 0, "user", "Hi.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_rebuilt_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Who?"), (1, 2, "assistant", "Me")], "conv_id long, turn long, role string, text string")
    got = C.turns(C.repaired(df)).orderBy("part", "seq", "at").select("edit", "turn", "role", "text").collect()
    assert [tuple(r) for r in got] == [("K", 0, "user", "Hi."), ("I", None, "assistant", ""), ("K", 1, "user", "Who?"), ("K", 2, "assistant", "Me")]
