"""Licence statements in texts: one pass of an Aho-Corasick automaton, and licence expressions.

Texts are lowered (A-Z) and reduced to words joined by single blanks, so that a phrase is
found wherever its words stand next to each other. Where an identifier tag is found, the
expression behind it is read from the text itself and evaluated by a shunting-yard parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.llm import words as W
from tablewright.llm.shared import ids_and_texts, ship

#: Fixed phrases and labels that every scan counts as base places.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, their labels, and how sure each makes that the text states a licence.
NOTICES = {
    "licensed under the apache license": ("apache", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license": ("gpl", 0.7),
    "gnu lesser general public license": ("lgpl", 0.8),
    "gnu affero general public license": ("agpl", 0.8),
    "mozilla public license": ("mpl", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "released into the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
TAG = "spdx license identifier"
BASE_SURE, TAG_SURE = 0.9, 0.95

#: Identifiers of expressions (lower case, without -only, -or-later and +), their labels,
#: and whether the licence lets a copy be used without conditions on derived works.
IDENTIFIERS = {
    "mit": ("mit", True), "apache-2.0": ("apache-2", True), "bsd-2-clause": ("bsd", True), "bsd-3-clause": ("bsd", True),
    "isc": ("isc", True), "cc0-1.0": ("public-domain", True), "unlicense": ("public-domain", True),
    "cc-by-4.0": ("cc-by", True), "cc-by-nc-4.0": ("cc-by-nc", False), "gpl-2.0": ("gpl-2", False), "gpl-3.0": ("gpl-3", False),
    "lgpl-2.1": ("lgpl", False), "lgpl-3.0": ("lgpl", False), "agpl-3.0": ("agpl", False), "mpl-2.0": ("mpl", False),
}
#: Exceptions that lift the conditions for works that only link to the licensed one.
LINKING = {"classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "font-exception-2.0"}

#: Words that say that nothing is stated.
NOTHING = {"noassertion", "none"}

_EXPRESSION = re.compile(r"spdx[^0-9a-z\n]+license[^0-9a-z\n]+identifier[ \t]*:?[ \t]*([^\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[0-9A-Za-z.+-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def _stem(token: str) -> str:
    return re.sub(r"-only$|-or-later$|\+$", "", token)


def _is_name(token: str, before: str | None, alone: bool) -> bool:
    """Whether a word names a licence, or behind `with` an exception.

    Unknown licences have the form of an identifier (a digit, a hyphen, a reference of one's own) or
    are all that stands on the line.
    """
    if before == "with":
        return token in LINKING or "exception" in token
    if token in NOTHING or token in LINKING:
        return False
    return _stem(token) in IDENTIFIERS or any(c.isdigit() for c in token) or "-" in token.strip("-") or alone


def parse(expression: str) -> tuple[set[str], bool | None, int]:
    """Labels, free use and length of the longest leading expression; (set(), None, 0) without one.

    Free use: all parts of an `and`, any part of an `or`; an exception for linking makes its
    licence free. Reading stops at the first token that can't continue the expression; brackets
    still open there are closed.
    """
    tokens, depth, wants, count = [], 0, True, 0
    for match in _TOKEN.finditer(expression):
        token = match[0].lower()
        if expression[count : match.start()].strip():
            break
        if token == "(" and wants:
            depth += 1
        elif token == ")" and not wants and depth:
            depth -= 1
        elif token in _RANK and not wants:
            wants = True
        elif token not in _RANK and token not in "()" and wants and _is_name(token, tokens[-1] if tokens else None, expression.strip() == match[0]):
            wants = False
        else:
            break
        tokens.append(token)
        count = match.end()
    while tokens and (tokens[-1] in _RANK or tokens[-1] == "("):
        depth -= tokens.pop() == "("
    if not tokens:
        return set(), None, 0
    tokens += [")"] * depth
    output, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while waiting[-1] != "(":
                output.append(waiting.pop())
            waiting.pop()
        elif token in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[token]:
                output.append(waiting.pop())
            waiting.append(token)
        else:
            output.append(token)
    output += reversed(waiting)
    values: list[tuple[set[str], bool]] = []
    for token in output:
        if token in _RANK:
            b, a = values.pop(), values.pop()
            free = a[1] and b[1] if token == "and" else a[1] or b[1]
            values.append((a[0] if token == "with" else a[0] | b[0], free))
        elif token in LINKING or "exception" in token:
            values.append((set(), token in LINKING))
        else:
            name = _stem(token)
            label, free = IDENTIFIERS.get(name, (name, False))
            values.append(({label} if label else set(), free))
    return (*values[0], count)


@cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    entries = {p: (p, label, BASE_SURE, True) for p, label in BASE.items()}
    entries |= {p: (p, label, sure, False) for p, (label, sure) in NOTICES.items() if p not in BASE}
    entries[TAG] = (TAG, None, TAG_SURE, False)
    for phrase, entry in entries.items():
        machine.add_word(f" {phrase} ", entry)
    machine.make_automaton()
    return machine


_MAP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def scan(text: str | None) -> tuple:
    """The result columns of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.translate(_MAP).split(b" ")
    found = [w for w in found if w]
    joined = (b" " + b" ".join(found) + b" ").decode("utf-8", "surrogatepass")
    base, labels, unsure, places, free, tagged = set(), set(), 1.0, [], None, False
    for end, (phrase, label, sure, is_base) in _automaton().iter(joined):
        if phrase == TAG:
            tagged = True
            continue
        labels.add(label)
        unsure *= 1.0 - sure
        if is_base:
            base.add(label)
            places.append(joined.count(" ", 0, end - len(phrase) - 1))
    if tagged:
        for match in _EXPRESSION.finditer(text or ""):
            named, one, length = parse(match[1])
            if length:
                labels |= named
                unsure *= 1.0 - TAG_SURE
                free = one if free is None else free and one
    first, last = (min(places), max(places)) if places else (None, None)
    return len(found), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - unsure, free


_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("free_use", pa.bool_()),
]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.pieces(batches):
        rows = [scan(t) for t in W.column(batch, "text").to_pylist()]
        arrays = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_FIELDS)]
        yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), *arrays], ["doc_id", *[n for n, _ in _FIELDS]])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: word and place counts, labels, score and free_use.

    Missing and empty texts have no words, empty label strings, missing places and score 0.
    score: probability that at least one of the found statements is right. free_use: of the
    tagged expressions, missing without one. Each row stands for itself, also repeated rows
    and rows without an id; other columns are not read; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    return ids_and_texts(docs, id_col, text_col).mapInArrow(
        _scanned, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, free_use boolean")
