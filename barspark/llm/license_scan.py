"""Licences named in texts: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over the words;
a shunting-yard parser evaluates the expression behind a tag.

Words are what is left of a text when ASCII other than letters and digits is blank; a phrase's words stand one after the
other, whatever is between them. The value of an expression is the set of identifiers that it names and how much they
restrict: of licences joined by ``or`` the less restricting one counts, of those joined by ``and`` the more restricting one,
and ``with`` an exception a licence restricts less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Phrase to label. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of this module's own.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "boost software license": "bsl",
    "artistic license": "artistic",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved": "proprietary",
}
#: An expression follows these, after a colon or an equals sign.
TAGS = ("spdx license identifier", "license expression")
#: How much a licence restricts, of 100, by the longest beginning of its name that is listed.
LEVELS = {
    "cc0": 10, "unlicense": 10, "public-domain": 10, "0bsd": 10, "mit": 20, "bsd": 20, "isc": 20, "zlib": 20, "bsl": 20, "apache": 20, "cc-by": 20,
    "artistic": 30, "lgpl": 50, "mpl": 50, "epl": 50, "eupl": 60, "cc-by-sa": 60, "gpl": 80, "agpl": 90, "cc-by-nc": 90, "cc-by-nd": 90, "proprietary": 100,
}
#: Of licences that aren't listed, and what an exception takes off down to the least.
UNKNOWN, EXCEPTION, LEAST = 70, 30, 20

_BLANK = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_ASSIGNED = re.compile(rb"[ \t\"']*[:=][ \t\"']*")
_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9.+-]+)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def level_of(label: str) -> int:
    known = [name for name in LEVELS if label == name or label.startswith((name + "-", name + "+"))]
    return LEVELS[max(known, key=len)] if known else UNKNOWN


def postfix(tokens: list[str]) -> list[str]:
    """The longest well-formed beginning of an expression in postfix order; empty if there is none."""
    open_, wants, whole = 0, True, 0
    for i, token in enumerate(tokens):
        after_with = i > 0 and tokens[i - 1] == "with"
        if token == "(":
            ok, open_ = wants and not after_with, open_ + 1
        elif token == ")":
            ok, open_ = not wants and open_ > 0, open_ - 1
        elif token in _BINDS:
            ok, wants = not wants, True
        else:
            ok, wants = wants, False
        if not ok:
            break
        if not wants and not open_:
            whole = i + 1
    out: list[str] = []
    held: list[str] = []
    for token in tokens[:whole]:
        if token == "(":
            held.append(token)
        elif token == ")":
            while (top := held.pop()) != "(":
                out.append(top)
        elif token in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
        else:
            out.append(token)
    return out + held[::-1]


def evaluate(tokens: list[str]) -> tuple[frozenset[str], int] | None:
    """The identifiers of an expression and how much it restricts; None if it isn't one."""
    stack: list[tuple[set[str], int]] = []
    for token in postfix(tokens):
        if token not in _BINDS:
            stack.append(({token}, level_of(token)))
            continue
        right, left = stack.pop(), stack[-1]
        left[0].update(right[0])  # identifiers gather in one set, however long the expression
        if token == "with":
            level = left[1] if left[1] <= LEAST else max(left[1] - EXCEPTION, LEAST)
        else:
            level = min(left[1], right[1]) if token == "or" else max(left[1], right[1])
        stack[-1] = (left[0], level)
    return (frozenset(stack[0][0]), stack[0][1]) if stack else None


def expression_at(text: bytes, at: int) -> list[str]:
    """Tokens behind a tag that ends at ``at``, in lower case, up to the first character that no expression has."""
    begin, tokens = _ASSIGNED.match(text, at), []
    if begin:
        at = begin.end()
        while found := _TOKEN.match(text, at):
            tokens.append(found[1].decode().lower())
            at = found.end()
    return tokens


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """All phrases and tags between blanks: (kind, words, label)."""
    made = ahocorasick.Automaton()
    wanted: dict[str, list[tuple[str, int, str]]] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            wanted.setdefault(phrase, []).append((kind, phrase.count(" ") + 1, label))
    for phrase, entries in wanted.items():
        made.add_word(f" {phrase} ", (len(phrase) + 2, entries))
    made.make_automaton()
    return made


def found_in(text: bytes) -> tuple[int, list[tuple[str, int, str, int]]]:
    """The number of words, and (kind, first word, label, level) of every place, in order; an expression gives a row for
    each of its identifiers, all with the level of the whole."""
    blank = text.translate(_BLANK)
    words = blank.split()
    line = b" ".join([b"", *words, b""]).decode("latin-1")  # a character a byte
    places: list[tuple[str, int, str, int]] = []
    ends = None
    counted, word = 0, -1
    for start, entries in sorted(((end + 1 - size, entries) for end, (size, entries) in automaton().iter(line)), key=lambda x: x[0]):
        word += line.count(" ", counted, start + 1)
        counted = start + 1
        for kind, n, label in entries:
            if kind != "tag":
                places.append((kind, word, label, level_of(label)))
                continue
            if ends is None:
                filled = np.frombuffer(blank, np.uint8) != 32
                ends = np.flatnonzero(filled & ~np.r_[filled[1:], False]) + 1
            if value := evaluate(expression_at(text, int(ends[word + n - 1]))):
                places += [("tag", word, name, value[1]) for name in sorted(value[0])]
    return len(words), places


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``n_words``, ``places``: an array of struct ``kind`` (base, notice, tag), ``word`` (the first
    one's number from 0), ``label``, ``level`` (0 to 100), in order of words.

    A null text counts as empty and has no places. Of a tag whose expression isn't well-formed the longest well-formed
    beginning counts, if any. Repeated rows each give a row, an empty table none; other columns are not read.
    """
    place = pa.struct([("kind", pa.string()), ("word", pa.int64()), ("label", pa.string()), ("level", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                done = [found_in(t.as_py() or b"") for t in part.column(1)]
                places = [[dict(zip(("kind", "word", "label", "level"), p, strict=True)) for p in found] for _, found in done]
                columns = [part.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array(places, pa.list_(place))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, places array<struct<kind: string, word: long, label: string, level: int>>")
