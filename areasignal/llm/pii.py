"""Personal data, disguised or not: transducers normalise a text and keep where each character came from."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areasignal.llm.common import arrow_map, kind_of

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")

# Letters that look like those of ASCII, and words for digits and signs in English, German, French and Spanish.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ω": "w", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "·": ".", "•": ".", "∙": ".",
}
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
TIMES_WORDS = {"double": 2, "triple": 3, "doppel": 2}
PLUS_WORDS, DOT_WORDS, AT_WORDS = ("plus",), ("dot", "punkt", "point", "punto"), ("at", "ät", "arobase", "arroba")
UNSEEN = "­​‌‍⁠﻿"


class Mapped:
    """A text with, for each stretch of it, where that stands in the source.

    Stretches start at `at` and stand at `start` to `end` of the source: copied ones character for character, rewritten ones
    as a whole. Rewrites of rewritten texts are composed, so a span found at the end leads back through all of them.
    """

    def __init__(self, text: str, at: Sequence[int] = (0,), start: Sequence[int] = (0,), end: Sequence[int] | None = None, copied: Sequence[bool] = (True,)):
        self.text, self.at, self.start, self.copied = text, at, start, copied
        self.end = (len(text),) if end is None else end

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source's span of the characters from start to end (exclusive, not empty)."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return (self.start[i] + (start - self.at[i] if self.copied[i] else 0), self.start[j] + end - self.at[j] if self.copied[j] else self.end[j])

    def rewritten(self, edits: Sequence[tuple[int, int, str]]) -> Mapped:
        """With each (start, end, new text) applied: ordered, apart, not empty before."""
        out, at, start, end, copied, here, size = [], [], [], [], [], 0, 0

        def put(piece: str, s: int, e: int, same: bool) -> None:
            nonlocal size
            if piece:
                out.append(piece), at.append(size), start.append(s), end.append(e), copied.append(same)
                size += len(piece)

        def keep(a: int, b: int) -> None:
            i = bisect_right(self.at, a) - 1
            while a < b:
                stop = min(b, self.at[i + 1]) if i + 1 < len(self.at) else b
                if self.copied[i]:
                    s = self.start[i] + a - self.at[i]
                    put(self.text[a:stop], s, s + stop - a, True)
                else:
                    put(self.text[a:stop], self.start[i], self.end[i], False)
                a, i = stop, i + 1

        for a, b, new in edits:
            if here < a:
                keep(here, a)
            if new:
                put(new, *self.source(a, b), False)
            here = b
        if here < len(self.text):
            keep(here, len(self.text))
        return Mapped("".join(out), at or (0,), start or (0,), end or (0,), copied or (True,))


@cache
def lookalikes() -> dict[str, str]:
    """Character to what it looks like: compatible forms and digits of any script by rule, then LOOKALIKES; unseen ones to nothing."""
    out = {}
    for c in map(chr, range(0x80, 0x1FBFA)):
        if 0xD800 <= ord(c) < 0xE000:
            continue
        plain = unicodedata.normalize("NFKC", c)
        if (value := unicodedata.decimal(c, None)) is not None:
            out[c] = str(value)
        elif len(plain) == 1 and " " <= plain <= "~" and c not in "`  ":
            out[c] = plain
    return out | LOOKALIKES | dict.fromkeys(UNSEEN, "")


@cache
def _patterns() -> dict[str, re.Pattern]:
    seen, runs = sorted(map(ord, lookalikes())), []
    for c in seen:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    chars = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)
    words = "|".join(sorted([*DIGIT_WORDS, *TIMES_WORDS], key=lambda w: (-len(w), w)))
    unit = rf"(?:(?:{'|'.join(PLUS_WORDS)}|{'|'.join(DOT_WORDS)}|\+)[ ,-]{{1,3}})?(?:(?:{words})(?![^\W\d_])|[0-9]+)"
    open_, close = r"[ \t]{0,3}[\[({<]{1,2}[ \t]{0,3}", r"[ \t]{0,3}[\])}>]{1,2}[ \t]{0,3}"
    dots = "|".join(DOT_WORDS)
    name, word = r"[A-Za-z0-9_%+-]+", r"[A-Za-z0-9-]+"
    return {
        "char": re.compile(f"[{chars}]"),
        "spoken": re.compile(rf"(?<![^\W_])(?:{'|'.join([*PLUS_WORDS, *DOT_WORDS])})?(?:[ ,-]{{1,3}})?{unit}(?:[ ,-]{{1,3}}{unit}){{3,}}", re.I),
        "spoken_unit": re.compile(rf"(?P<plus>{'|'.join(PLUS_WORDS)}|\+)|(?P<dot>{'|'.join(DOT_WORDS)})|(?P<times>{'|'.join(TIMES_WORDS)})|(?P<word>{'|'.join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))})|(?P<digits>[0-9]+)", re.I),
        "entity": re.compile(r"&(?:#0{0,4}(?:64|46);|#[xX]0{0,4}(?:40|2[eE]);|commat;|period;)|%40"),
        "hidden": re.compile(rf"[\[({{<][ \t]{{0,3}}(?:[@.]|{'|'.join((*AT_WORDS, *DOT_WORDS))})[ \t]{{0,3}}[\])}}>]|[_-](?:at|dot)[_-]"),
        "hidden_sign": re.compile(rf"(?:{open_}(?:@|{'|'.join(AT_WORDS)}){close})|(?:{open_}(?:\.|{'|'.join(DOT_WORDS)}){close})|(?<=[A-Za-z0-9])[_-](?:at|dot)[_-](?=[A-Za-z0-9])", re.I),
        "said_at": re.compile(
            rf"(?<![A-Za-z0-9._%+-]){name}(?:(?: (?:{dots}) |\.){name}){{0,8}} (?:{'|'.join(AT_WORDS)}) {word}(?: (?:{dots}) {word}){{0,8}} (?:{dots}) [A-Za-z]{{2,24}}(?![A-Za-z0-9])"
            rf"|(?<![A-Za-z0-9._%+-]){name}(?:(?: (?:{dots}) |\.){name}){{0,8}} ?@ ?{word}(?:(?: (?:{dots}) | ?\. ?){word}){{0,8}}(?: (?:{dots}) | ?\. ?)[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I
        ),
        "said_sign": re.compile(rf" (?P<at>{'|'.join(AT_WORDS)}) | (?:{dots}) | ?(?P<sign>@) ?| ?\. ?", re.I),
    }


def _unmasked(m: Mapped) -> Mapped:
    """Lookalikes put to ASCII: signs and digits each for itself, letters only where the whole word becomes ASCII (real words of
    another script have letters that look like none of ASCII, and stay)."""
    p, table = _patterns(), lookalikes()
    edits, text, here = [], m.text, 0
    for hit in p["char"].finditer(text):
        if hit.start() < here:
            continue
        a, b = hit.span()
        if text[a].isalpha() or text[a] in UNSEEN:
            # the run of letters and unseen characters around it; what stands before `here` was looked at with its own run
            while a > here and (text[a - 1].isalpha() or text[a - 1] in UNSEEN):
                a -= 1
            while b < len(text) and (text[b].isalpha() or text[b] in UNSEEN):
                b += 1
            letters = all(c.isascii() or c in table for c in text[a:b])
            edits += [(a + i, a + i + 1, table[c]) for i, c in enumerate(text[a:b]) if c in table and (letters or c in UNSEEN)]
        else:
            edits.append((a, b, table[text[a]]))
        here = b
    return m.rewritten(edits) if edits else m


def _signs(m: Mapped, low: str) -> Mapped:
    """[at], (dot), _at_ and entities put to @ and full stops."""
    p = _patterns()
    if ("&" in low or "%40" in low) and p["entity"].search(m.text):
        m = m.rewritten([(*h.span(), "@" if h[0] == "%40" or h[0].lower() in ("&commat;",) or h[0][1:-1].lstrip("#xX0") in ("64", "40") else ".") for h in p["entity"].finditer(m.text)])
    edits = []
    for h in p["hidden_sign"].finditer(m.text) if p["hidden"].search(low) else ():
        core = h[0].strip(" \t[](){}<>_-").lower()
        edits.append((*h.span(), "@" if core == "@" or core in AT_WORDS else "."))
    return m.rewritten(edits) if edits else m


_SPELLED = frozenset(DIGIT_WORDS)
#: What the patterns take for an ASCII letter in either case, and lower() leaves apart from it.
_FOLDED = str.maketrans({"\u0307": "", "ı": "i", "ſ": "s"})


def _spoken(m: Mapped, low: str) -> Mapped:
    """Runs of four or more spelled digits, with plus and dots between them, put to digits; at least two must be words."""
    p = _patterns()
    spelled = [w in _SPELLED for w in low.translate({44: " ", 45: " "}).split()]
    if sum(spelled) < 2 or not p["spoken"].search(low):
        return m
    edits = []
    for h in p["spoken"].finditer(m.text):
        new, times, said, last = [], 1, 0, h.start()
        for u in p["spoken_unit"].finditer(m.text, h.start(), h.end()):
            if u["plus"]:
                new.append("+")
            elif u["dot"]:
                new.append(".")
            elif u["times"]:
                times = TIMES_WORDS[u["times"].lower().translate(_FOLDED)]
                continue
            else:
                said += u["word"] is not None
                new.append((str(DIGIT_WORDS[u["word"].lower().translate(_FOLDED)]) if u["word"] else u["digits"]) * times)
            times, last = 1, u.end()
        if said >= 2:
            first = re.match(r"[ ,-]*", h[0]).end()
            edits.append((h.start() + first, last, "".join(new)))
    return m.rewritten(edits) if edits else m


def _said(m: Mapped, low: str) -> Mapped:
    """`name at host dot end` put to an address, and spaces or words of full stops around those of an @. The word at alone, with
    a plain full stop, is prose."""
    p = _patterns()
    if "@" not in m.text and not (any(f" {w} " in low for w in AT_WORDS) and any(f" {w} " in low for w in DOT_WORDS)):
        return m
    edits = []
    for h in p["said_at"].finditer(m.text):
        edits += [(*s.span(), "@" if s["at"] or s["sign"] else ".") for s in p["said_sign"].finditer(m.text, h.start(), h.end()) if " " in s[0]]
    return m.rewritten(edits) if edits else m


def deobfuscated(text: str) -> Mapped:
    """The text normalised by all transducers, one after the other."""
    m = _unmasked(Mapped(text))
    for step in (_signs, _spoken, _said):
        m = step(m, m.text.lower())
    return m


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUPS = re.compile(r"[^ ]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`; from each @ backwards, so long runs are read once."""
    here, i = 0, text.find("@")
    while i >= 0:
        s = i
        while s > here and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, i + 1) if s < i else None
        if m:
            yield s, m.end()
        here = m.end() if m else i + 1
        i = text.find("@", here)


def _ip(found: str) -> bool:
    return all(len(p) <= 3 or not p.lstrip("0")[3:] for p in found.split(".")) and all(int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _card(found: str) -> bool:
    digits = [int(c) for c in reversed(found) if c.isdigit()]
    return 12 <= len(digits) <= 19 and (sum(digits[::2]) + sum(d // 5 + 2 * d % 10 for d in digits[1::2])) % 10 == 0


def _phone(found: str) -> bool:
    return 9 <= sum(map(str.isdigit, found)) <= 15


def _found(text: str, more: bool = False) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of all matches. more: of a match that fails, also the longest leading groups, apart by spaces, that
    pass, and what follows them: numbers that stand side by side are one match of the plain patterns."""
    yield from ((s, 0, e) for s, e in _emails(text))
    yield from ((*m.span()[:1], 1, m.end()) for m in _IP.finditer(text) if _ip(m[0]))
    for kind, pattern, holds in ((2, _CARD, _card), (3, _PHONE, _phone)):
        for m in pattern.finditer(text):
            if holds(m[0]):
                yield m.start(), kind, m.end()
            elif more and " " in m[0]:
                yield from ((m.start() + s, kind, m.start() + e) for s, e in _parts(m[0], holds, kind == 2))


def _parts(run: str, holds, again: bool) -> Iterator[tuple[int, int]]:
    """The longest leading groups of a run that pass, no longer than 40 characters; again: and so on from each later group."""
    groups, i = [m.span() for m in _GROUPS.finditer(run)], 0
    counts = [sum(map(str.isdigit, run[a:b])) for a, b in groups]
    while i < len(groups):
        s, j, n, best = groups[i][0], i, 0, None
        while j < len(groups) and groups[j][1] - s <= 40 and (n := n + counts[j]) <= 19:
            if n >= 9 and run[groups[j][1] - 1].isdigit() and holds(run[s : groups[j][1]]):
                best = j
            j += 1
        if best is not None:
            yield s, groups[best][1]
        if not again:
            return
        i = i + 1 if best is None else best + 1


_DIGITS = re.compile(r"[0-9]")


def identifiers(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) in code points, sorted: of the base patterns in the text, and of those and disguised ones together.

    A disguised one is left out if a base span of its kind covers it; a null text is empty.
    """
    if not text:
        return [], []
    m = deobfuscated(text)
    base = sorted(_found(text)) if "@" in text or _DIGITS.search(text) else []
    if m.text == text and not base and "@" not in text and not _DIGITS.search(text):
        return [], []
    more = {(s, k, e) for a, k, b in _found(m.text, True) for s, e in [m.source(a, b)]} - set(base)
    by = {k: [(s, e) for s, j, e in base if j == k] for k in range(len(KINDS))}

    def covered(s: int, k: int, e: int) -> bool:
        i = bisect_right(by[k], (s, len(text) + 1)) - 1
        return i >= 0 and by[k][i][1] >= e

    return base, sorted(base + [x for x in more if not covered(*x)])


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def scan_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id_col, base and found (arrays of structs start, kind, end; sorted, kinds numbered as KINDS).

    Spans are in code points of the source, the end exclusive. base are the plain patterns' matches; found has those and what
    was disguised: by lookalike or unseen characters, spelled digits, words or brackets for @ and full stops, or by another
    number beside it. A null or empty text has none. Repeated rows have equal results; other columns don't matter. One pass
    over the texts, no shuffle; a task holds one batch of texts.
    """

    def run(batches):
        for batch in batches:
            spans = [identifiers(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("start", "kind", "end"), s)) for s in part[i]] for part in spans], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "base", "found"])

    span = "array<struct<start:bigint,kind:int,end:bigint>>"
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind_of(df, id_col)}, base {span}, found {span}")


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each identifier in the texts replaced by its kind in angle brackets, overlapping ones as one; nulls stay."""
    at = df.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        out, here = [], 0
        for s, k, e in identifiers(text)[1]:
            if s >= here:
                out += [text[here:s], f"<{KINDS[k].upper()}>"]
            here = max(here, e)
        return text if text is None or not out else "".join(out) + text[here:]

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return arrow_map(plain, run, ", ".join(f"c{i} {t.dataType.simpleString()}" for i, t in enumerate(df.schema))).toDF(*df.columns)
