"""License notices and expressions in texts: one automaton over words, a shunting-yard parser behind tags.

The texts of a slice become one buffer of lower-case words with single spaces; an
Aho-Corasick automaton goes over it once and finds all phrases at whole words. Behind a tag
(``SPDX-License-Identifier``) or a statement (``licensed under``) the raw text is read as an
expression of license ids with ``and``, ``or`` and ``with``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archtrail.llm.chunks import bounded_batches
from archtrail.llm.packed import LOWER, release, slices, words

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further phrases of notices; of two that begin at one word the longer one counts.
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "apache license version 2 0": "apache-2.0", "artistic license": "artistic",
    "boost software license": "bsl-1.0", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "cc0": "cc0-1.0", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution sharealike": "cc-by-sa",
    "eclipse public license": "epl", "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "isc license": "isc", "lesser general public license": "lgpl", "mit license": "mit", "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit", "proprietary and confidential": "proprietary", "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd", "the unlicense": "unlicense", "zlib license": "zlib",
}
#: What stands before an expression; behind a tag any id counts, behind a statement only known ones.
TAGS, STATEMENTS = ("spdx license identifier", "license expression"), ("licensed under", "licensed under the", "released under", "released under the")
#: How freely text under a license may be used, by the beginning of its id (the longest that fits).
FREEDOM = {
    "0bsd": 1.0, "agpl": 0.2, "apache": 1.0, "artistic": 0.8, "bsd": 1.0, "bsl": 1.0, "cc-by": 0.9, "cc-by-nc": 0.1, "cc-by-nd": 0.1, "cc-by-sa": 0.6, "cc0": 1.0, "epl": 0.6, "gpl": 0.4,
    "isc": 1.0, "lgpl": 0.6, "mit": 1.0, "mpl": 0.6, "proprietary": 0.0, "public-domain": 1.0, "reserved": 0.0, "unlicense": 1.0, "zlib": 1.0,
}
UNSAID, UNKNOWN = 0.5, 0.5
#: An exception frees a license at least so far.
WITH_EXCEPTION = 0.6

#: What separates words ([\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing).
SEPARATORS = np.array([b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


def freedom(name: str) -> float | None:
    fits = [k for k in FREEDOM if name == k or name.startswith((k + "-", k + "+"))]
    return FREEDOM[max(fits, key=len)] if fits else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: ``with`` binds before ``and`` before ``or``. None where the tokens are no expression."""
    out, waiting, operand = [], [], True  # operand: what has to come next
    for token in tokens:
        if token in _BINDS and not operand:
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif token == "(" and operand and not (waiting and waiting[-1] == "with"):
            waiting.append(token)
        elif token == ")" and not operand:
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token not in _BINDS and token not in "()" and operand:
            out.append(token)
            operand = False
        else:
            return None
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(order: list[str]) -> tuple[float, set[str]] | None:
    """Freedom and labels of an expression in postfix: ``and`` takes the least, ``or`` the most, an exception frees."""
    stack: list[tuple[float, set[str]]] = []
    for token in order:
        if token not in _BINDS:
            known = freedom(token)
            stack.append((UNKNOWN if known is None else known, {token}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if len(left[1]) != 1:
                return None  # an exception belongs to one license
            stack.append((max(left[0], WITH_EXCEPTION), {f"{next(iter(left[1]))} with {next(iter(right[1]))}"}))
        else:
            stack.append(((min if token == "and" else max)(left[0], right[0]), left[1] | right[1]))
    return stack[0]


def read_expression(text: str, known_only: bool) -> tuple[str, float, list[str]] | None:
    """The expression that ``text`` begins with (after ``:``), its freedom and labels.

    Behind a statement words follow the expression, so the longest beginning that is one of
    known ids counts. Behind a tag all of the tokens must be an expression; what
    is not gives the label ``unparsed``.
    """
    tokens, at = [], re.compile(r"[ \t:]*").match(text).end()
    begin = at
    ends, depth = [], 0
    while got := _TOKEN.match(text, at):
        token = got[1].lower().rstrip(".")
        if known_only and not (token in _BINDS or token in "()" or freedom(token) is not None or (tokens and tokens[-1] == "with")):
            break
        if token == ")" and depth == 0:
            break
        depth += (token == "(") - (token == ")")
        tokens.append(token)
        ends.append(at := got.end())
        if got[1].endswith("."):
            break
    for n in range(len(tokens), 0 if known_only else max(len(tokens) - 1, 0), -1):
        order = postfix(tokens[:n])
        value = evaluate(order) if order else None
        if value:
            return text[begin : ends[n - 1]], value[0], sorted(value[1])
    return None if known_only or not tokens else (text[begin : ends[-1]], UNKNOWN, ["unparsed"])


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS, *STATEMENTS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def phrase_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """Word starts, ends and first words of the texts, and (number of its first word, phrase) of every phrase in them."""
    lower = LOWER[data]
    starts, stops, first = words(lower, at, SEPARATORS)
    # one buffer: a space, the word, ... and a line break between texts, which no phrase holds
    size = stops - starts
    n_texts = len(at) - 1
    text_of = np.repeat(np.arange(n_texts), np.diff(first))
    place = np.cumsum(size + 1) - size + 3 * text_of  # a text begins with a space and ends with a space and a break
    total = int(size.sum()) + len(size) + 3 * n_texts
    buffer = np.full(total, 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[starts] += 1
    inside[stops] -= 1
    source = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    buffer[source + np.repeat(place - starts, size)] = lower[source]
    breaks = np.cumsum(np.bincount(text_of, size + 1, n_texts).astype(np.int64) + 3) - 1
    buffer[breaks] = 10
    found = [(end - len(phrase), phrase) for end, phrase in automaton().iter(buffer.tobytes().decode("latin-1"))]
    word = np.searchsorted(place, [p for p, _ in found])
    return starts, stops, first, list(zip(word.tolist(), (p for _, p in found), strict=True))


SCHEMA = "doc_id long, n_words long, places array<struct<word: long, phrase: string, label: string, base: boolean>>, statements array<struct<word: long, expression: string, labels: array<string>, score: double>>, labels array<string>, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row ``doc_id``, ``n_words``, the ``places`` of phrases, ``statements`` read as expressions, ``labels`` and ``score``.

    Words are runs of digits, ASCII letters (lower-cased) and characters beyond ASCII. Places
    (by number of their first word) overlap freely; of the notices only the longest that begins
    at a word counts. ``score`` is the freedom of all that is said (the least of
    places and statements; ``UNSAID`` where nothing is). A null text is empty. Ids may be null
    or repeat; other columns are not read. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def judged(found: list[tuple[int, str]], first: int, end: int, data: np.ndarray, stops: np.ndarray) -> tuple:
        places, statements, longest = [], [], {}
        for word, phrase in found:
            if phrase in BASE:
                places.append({"word": word - first, "phrase": phrase, "label": BASE[phrase], "base": True})
            if phrase in NOTICES:
                longest[word] = max(longest.get(word, ""), phrase, key=len)
            if phrase in TAGS or phrase in STATEMENTS:
                begin = int(stops[word + phrase.count(" ")])
                line = data[begin:end].tobytes().partition(b"\n")[0].decode("utf-8", "replace")
                if read := read_expression(line, phrase in STATEMENTS):
                    statements.append({"word": word - first, "expression": read[0], "labels": read[2], "score": read[1]})
        places += [{"word": word - first, "phrase": p, "label": NOTICES[p], "base": False} for word, p in longest.items()]
        labels = sorted({p["label"] for p in places}.union(*(s["labels"] for s in statements)))
        said = [freedom(p["label"]) for p in places] + [s["score"] for s in statements]
        key = lambda x: (x["word"], x.get("phrase", ""), x.get("base", False), x.get("expression", ""))
        return sorted(places, key=key), sorted(statements, key=key), labels, min(said, default=UNSAID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                _, stops, first_word, found = phrase_places(data, at)
                n = end - first
                out = {"places": [[]] * n, "statements": [[]] * n, "labels": [[]] * n, "score": [UNSAID] * n}
                by_text: dict[int, list[tuple[int, str]]] = {}
                owner = np.searchsorted(first_word, [w for w, _ in found], "right") - 1
                for k, place in zip(owner.tolist(), found, strict=True):
                    by_text.setdefault(k, []).append(place)
                for k, own in by_text.items():
                    for name, value in zip(out, judged(own, int(first_word[k]), int(at[k + 1]), data, stops), strict=True):
                        out[name][k] = value
                ids = batch.column(0)[first:end].cast(pa.int64())
                columns = [ids, pa.array(np.diff(first_word)), *(pa.array(out[f.name], f.type) for f in list(arrow)[2:])]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                release()

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
