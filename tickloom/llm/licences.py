"""Operator 7, licence scans: Aho-Corasick over words, and SPDX expressions by shunting yard.

A text becomes its words (see ``words_of``) joined by single blanks; one automaton finds all
identifier tags and notice phrases between word bounds in one pass. Where a tag stands, the
expressions that follow it in the text are parsed: and/or/with and parentheses become reverse
Polish by the shunting-yard rule (with binds tightest, then and, then or) and are evaluated
to the licences named and to how free the best choice is (or takes the freer side, and the
stricter one). A malformed expression labels nothing.

Edge cases: a null or empty text has no words, no places and score 0; overlapping and repeated
places all count; repeated rows get equal rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import map_batches, utf8

#: Phrases that the contract fixes, with their labels; fixed values.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method's own; fixed values.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "mit",
    "released under the mit": "mit",
    "apache software license": "apache",
    "gnu gpl": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "artistic license": "artistic",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "gnu free documentation license": "gfdl",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "python software foundation license": "psf",
    "zlib license": "zlib",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: SPDX families: how an identifier begins, its label, and how free it is (2 permissive, 1 weak copyleft, 0 strong); fixed values.
FAMILIES = (
    ("mit", "mit", 2), ("apache", "apache", 2), ("bsd", "bsd", 2), ("0bsd", "bsd", 2), ("isc", "isc", 2), ("bsl", "bsl", 2),
    ("unlicense", "unlicense", 2), ("zlib", "zlib", 2), ("cc0", "cc", 2), ("cc-by", "cc", 1), ("lgpl", "lgpl", 1), ("mpl", "mpl", 1),
    ("epl", "epl", 1), ("agpl", "agpl", 0), ("gpl", "gpl", 0), ("artistic", "artistic", 2), ("afl", "afl", 2), ("cddl", "cddl", 1),
    ("cecill", "cecill", 0), ("eupl", "eupl", 0), ("gfdl", "gfdl", 0), ("odbl", "odbl", 1), ("ofl", "ofl", 1), ("osl", "osl", 0),
    ("postgresql", "postgresql", 2), ("psf", "psf", 2), ("python", "psf", 2), ("ruby", "ruby", 2), ("unicode", "unicode", 2), ("wtfpl", "wtfpl", 2), ("x11", "mit", 2),
)
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: What follows a tag, to the end of its line or the line's next tag.
_EXPRESSION = re.compile(rb"(?i)spdx-license-identifier[ \t]*:[ \t]*((?:(?!spdx-license-identifier[ \t]*:)[^\r\n])+)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def words_of(text: bytes) -> bytes:
    """Lower-cased words (ASCII letters and digits, all of UTF-8 beyond ASCII) joined by single blanks."""
    return b" ".join(text.translate(_WORDS).split())


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: labels named, exceptions named, and how free its best choice is."""

    labels: frozenset[str]
    exceptions: frozenset[str]
    freedom: int


def _licence(name: str) -> Terms:
    low = name.lower()
    for begin, label, free in FAMILIES:
        if low.startswith(begin):
            return Terms(frozenset([label]), frozenset(), free)
    return Terms(frozenset(["other"]), frozenset(), 0)


def reverse_polish(expression: str) -> list[str] | None:
    """Shunting yard; None if the expression is malformed. A trailing comment mark ends it."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(re.split(r"\*/|-->|#|//", expression)[0]):
        low = token.lower()
        if low in _BINDS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                break  # running text after the expression
            out.append(token)
            operand = True
    if not operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(expression: str) -> Terms | None:
    polish = reverse_polish(expression)
    if polish is None:
        return None
    stack: list[tuple[str | None, Terms]] = []
    for token in polish:
        if token not in _BINDS:
            stack.append((token, _licence(token)))
            continue
        if len(stack) < 2:
            return None
        (name, b), (_, a) = stack.pop(), stack.pop()
        if token == "with":
            if name is None:
                return None
            stack.append((None, Terms(a.labels, a.exceptions | {name.lower()}, min(2, a.freedom + 1))))
        else:
            pick = max if token == "or" else min
            stack.append((None, Terms(a.labels | b.labels, a.exceptions | b.exceptions, pick(a.freedom, b.freedom))))
    return stack[0][1] if len(stack) == 1 else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
        a.add_word(f" {phrase} ", (phrase in BASE_PHRASES, label, len(phrase) + 1))
    a.add_word(f" {TAG} ", (False, "", len(TAG) + 1))
    a.make_automaton()
    return a


def scan(text: bytes, a: ahocorasick.Automaton) -> dict:
    """All findings of one text: contract columns, and each expression's own result."""
    words = words_of(text)
    n_words = words.count(b" ") + 1 if words else 0
    starts, base, own, tagged = [], set(), set(), False
    for end, (is_base, label, size) in a.iter(f" {words.decode('latin-1')} "):
        if is_base:
            starts.append(end - size)
            base.add(label)
        elif label:
            own.add(label)
        else:
            tagged = True
    expressions = []
    if tagged:
        for m in _EXPRESSION.finditer(text):
            source = m[1].decode("utf-8", "replace").strip()
            got = evaluate(source)
            if got:
                expressions.append((source, got))
                own |= got.labels
    first = last = None
    if starts:
        first, last = (words[:x].count(b" ") for x in (min(starts), max(starts)))
    hits = len(starts) + len(own)
    score = 1.0 if expressions else 1 - 0.5**hits
    return {
        "n_words": n_words, "n_base": len(starts), "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | own)), "score": score, "expressions": [e for e, _ in expressions],
        "exceptions": ",".join(sorted(set().union(*[t.exceptions for _, t in expressions]))), "freedom": min((t.freedom for _, t in expressions), default=None),
    }


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, exceptions string, freedom int"


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the findings of every whole text."""
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.string(), pa.int32()]
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def make():
        a = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan(t or b"", a) for t in utf8(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names=["doc_id", *names])

        return step

    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op7_licence_scan(docs: DataFrame) -> DataFrame:
    """The thin query."""
    return scan_documents(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "exceptions", "freedom")
