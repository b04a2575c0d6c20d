"""License scans: Aho-Corasick over the words for tags and notices; a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from areasignal.llm.common import arrow_map, kind_of

# Phrases of the base and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further notices, as words, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by 4 0": "cc-by-4.0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: The words of an identifier tag; the expression is in the rest of the line.
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier[ \t]*:?", re.I | re.A)
#: Tokens of an expression; a line break with what comments start and end lines with is one too.
_TOKEN = re.compile(r"[ \t]*(?:(?P<line>[ \t*/#;%!-]*(?:\r\n?|\n)(?:[ \t]*(?:/?\*+(?!/)|//+|#+|;+|%+|--+|!|<!--|\"{3}|'{3}))?[ \t]*)|(?P<token>[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*))", re.A)
# Names of licences in public use (lower-case), families of names by version, and what exceptions are called.
NAMES = set(
    "0bsd aal adsl afl apl artistic apache bitstream-vera blessing boost bsd bsl bsd-source-code cc-pdm-1.0 cc0-1.0 cnri-python curl eccl ecos-2.0 etalab-2.0 fair freeimage ftl fsfap fsful hpnd icu ijg imagemagick "
    "info-zip intel isc json latex2e libpng libpng-2.0 libtiff lppl mit mit-0 mit-cmu mit-modern-variant miros mulanpsl-2.0 naist-2003 ncsa netcdf ntp ofl openssl pddl-1.0 php postgresql psf qpl-1.0 ruby sissl sleepycat "
    "smlnj ssh-openssh sspl-1.0 tcl tmate unicode-tou unlicense vim vsl-1.0 w3c wtfpl x11 xfree86-1.1 xnet zlib zlib-acknowledgement zed zend-2.0 beerware gpl lgpl agpl mpl epl".split()
)
FAMILIES = re.compile(
    r"(?:a|l)?gpl-?v?[1-3](?:\.[0-9])?(?:-only|-or-later)?|gfdl-1\.[1-3](?:-(?:no-)?invariants)?(?:-only|-or-later)?|(?:apache|mpl|epl|eupl|cddl|cpl|osl|afl|apsl|artistic|ecl|bsl|busl|ms|oclc|odbl|odc-by|ofl|lppl|python|psf|php|zpl|cecill|eudatagrid|ipl|rpl|spl|unicode-dfs|upl|nosl|lpl|ogl-uk)-[0-9]+(?:\.[0-9]+){0,2}(?:[a-z]|-[a-z0-9-]+)?"
    r"|bsd-[0-4]-clause(?:-[a-z0-9-]+)?|cc-by(?:-nc)?(?:-(?:nd|sa))?-[1-4]\.[0-9](?:-[a-z]{2,4})?|unicode-(?:3\.0|dfs-20[0-9]{2})|w3c-[0-9]{8}|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+"
)
EXCEPTION = re.compile(r"(?:[a-z0-9.+-]*exception[a-z0-9.-]*|[a-z0-9.+-]+-(?:linking|bootstrapping|note|syscall-note|interface|loophole)[a-z0-9.-]*|additionref-[a-z0-9.-]+)(?: with .*)?")
# How tightly operators bind; licences of two kinds.
BINDS = {"or": 1, "and": 2, "with": 3}
PERMISSIVE = {"mit", "apache-2.0", "apache", "bsd-2-clause", "bsd-3-clause", "bsd", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "0bsd", "bsl-1.0"}
#: A-Z lower-cased, digits, letters and bytes from 128 kept, all else a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def known(name: str) -> bool:
    """Whether a name (lower-case, perhaps `with` an exception) is a licence's."""
    name, _, exception = name.partition(" with ")
    return (name in NAMES or FAMILIES.fullmatch(name) is not None) and (not exception or EXCEPTION.fullmatch(exception) is not None)


def parsed(text: str, at: int = 0) -> tuple[list[str], bool] | None:
    """Shunting-yard: names (lower-cased) and operators of the expression at a place, operands first, and whether it is whole;
    None if there is none.

    `with` binds tighter than `and`, that tighter than `or`; all group from the left. An expression goes on over line breaks
    and the marks of comment lines while it is open, or if the next line starts with an operator; it ends at other text. Of
    one that is cut off, what is there counts: open parentheses are closed, operators without a right side left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, depth, broken = False, 0, False
    while m := _TOKEN.match(text, at):
        at = m.end()
        if m["line"] is not None:
            broken = True
            continue
        token = m["token"].lower()
        if broken and operand and not depth and token not in BINDS:
            break
        if token == "(":
            if operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if not operand or not depth:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
            depth -= 1
        elif token in BINDS:
            if not operand:
                break
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        else:
            if operand or token.startswith("spdx-license-identifier"):
                break
            out.append(token.rstrip(".:"))
            operand = True
        broken = False
    if not out:
        return None
    whole = operand and not depth
    while not operand:  # what stands before the last operator is an operand
        operand = stack.pop() in BINDS
    return out + [x for x in reversed(stack) if x != "("], whole


def to_postfix(text: str) -> list[str] | None:
    """A whole expression's names and operators, operands first; None if it isn't one."""
    found = parsed(text)
    return found[0] if found and found[1] else None


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """The licences named, and whether some choice allowed by the expression has permissive licences alone. What stands
    after `with` is the name of an exception; None if more than one name stands there."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token not in BINDS:
            name = token.rstrip("+")
            stack.append(({name}, name in PERMISSIVE))
            continue
        (right, right_ok), (left, left_ok) = stack.pop(), stack.pop()
        if token == "with":
            if len(right) != 1:
                return None
            stack.append(({f"{x} with {y}" for x in left for y in right}, left_ok))
        else:
            stack.append((left | right, left_ok or right_ok if token == "or" else left_ok and right_ok))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Finds all phrases between spaces, overlapping ones too."""
    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, a: ahocorasick.Automaton) -> dict:
    """n_words, places (start in words and phrase, in order), labels, expressions, permissive and score of a whole text.

    A tag counts if its expression names a licence that is known; unknown names are no labels. The score is that of the
    strongest evidence, raised by the share of words that evidence covers: of an expression the share of its names that are
    known, times 0.7 if it is cut off; of a phrase of n words 1 - 1 / (n + 1).
    """
    words = (text or "").encode().translate(_WORDS).split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")  # a character a byte: positions hold, and the phrases are ASCII
    places, at, index = [], 0, 0
    for end, phrase in a.iter(line):
        start = end - len(phrase) - 1  # of the space before it
        if start < at:
            index -= line.count(" ", start, at)
        else:
            index += line.count(" ", at, start)
        at = start
        places.append((index, phrase))
    labels = {BASE.get(p) or NOTICES.get(p) for _, p in places} | {NOTICES[p] for _, p in places if p in NOTICES}
    labels.discard(None)
    expressions, permissive, strength = [], None, 0.0
    if any(p == TAG for _, p in places):
        for m in _TAG.finditer(text):
            postfix, whole = parsed(text, m.end()) or ([], False)
            found = evaluate(postfix) if postfix else None
            names = {x for x in found[0] if known(x)} if found else set()
            if names:
                expressions.append(" ".join(postfix))
                labels |= names
                allowed = found[1] and names == found[0]
                permissive = allowed if permissive is None else permissive and allowed
                strength = max(strength, len(names) / len(found[0]) * (1.0 if whole else 0.7))
    said = [(i, len(p.split())) for i, p in places if p != TAG or expressions]
    covered, upto = 0, 0
    for i, n in sorted(said):
        covered, upto = covered + max(0, i + n - max(upto, i)), max(upto, i + n)
    strength = max([strength, *(1 - 1 / (1 + len(p.split())) for _, p in places if p != TAG)])
    score = 1 - (1 - strength) * (1 - covered / len(words)) if words else 0.0
    return {"n_words": len(words), "places": sorted(places), "labels": sorted(labels), "expressions": expressions, "permissive": permissive, "score": score}


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: id_col, n_words, places (array of word, phrase: all that were found, by word), base_labels
    and labels (sorted arrays), expressions (postfix), permissive (null without an expression), score.

    A null text is empty: no words, empty arrays, score 0. Repeated rows give repeated results; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        place = pa.struct([("word", pa.int64()), ("phrase", pa.string())])
        kinds = {"n_words": pa.int64(), "places": pa.list_(place), "base_labels": pa.list_(pa.string()), "labels": pa.list_(pa.string()), "expressions": pa.list_(pa.string()), "permissive": pa.bool_(), "score": pa.float64()}
        for batch in batches:
            found = [scan(x.as_py(), a) for x in batch.column(1)]
            for r in found:
                r["base_labels"] = sorted({BASE[p] for _, p in r["places"] if p in BASE})
                r["places"] = [{"word": w, "phrase": p} for w, p in r["places"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in found], t) for k, t in kinds.items())], [id_col, *kinds])

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind_of(df, id_col)}, n_words long, places array<struct<word:long,phrase:string>>, base_labels array<string>, labels array<string>, expressions array<string>, permissive boolean, score double")
