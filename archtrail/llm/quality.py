"""Line-first cleaning: lines that break a rule go, then documents that lost too much.

Everything is counted on byte buffers of a few megabytes, many documents at once; a
document never leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import bounded_batches
from archtrail.llm.packed import LOWER, SPACES, byte_hash, first_equal, mix, shingle_hash, slices, spread, words

SYMBOLS, SEPARATORS = b"#*$%&|<>", b"|<>/-*"
#: Phrases of page furniture (lower case).
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in to", "lorem ipsum", "privacy policy",
    "read more", "sign in to", "skip to content", "subscribe to our", "terms of service", "terms of use", "we use cookies",
)


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules; ``window`` words count as repeated where they occur twice in a text."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    punctuation_share: float = 0.2
    separator_share: float = 0.2
    short_line_words: int = 15
    max_lost_share: float = 0.5


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _SEPARATOR = _table(SYMBOLS), _table(SEPARATORS)
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, text string, {COUNTS}, n_lines long, n_lines_removed long, base_failed boolean, kept boolean"


class _Texts:
    """Counts and line verdicts of the texts of one slice."""

    def __init__(self, data: np.ndarray, at: np.ndarray, rules: Rules) -> None:
        self.data, self.at, self.rules = data, at, rules
        n = len(at) - 1
        starts, stops, first = words(data, at)
        self.n_words = np.diff(first)
        total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        chars = total(((data & 0xC0) != 0x80) & ~SPACES[data])
        symbols = total(_SYMBOL[data])
        self.word_chars, self.n_symbols = np.diff(chars[at]), np.diff(symbols[at])
        self.n_repeat_words = self._repeated(first_equal(data, starts, stops, byte_hash(data, starts, stops)), first)

        breaks = np.flatnonzero(data == 10)
        text_of_break = np.searchsorted(at, breaks, "right") - 1
        per_text = np.bincount(text_of_break, minlength=n) + 1
        self.line_text = np.repeat(np.arange(n), per_text)
        self.line_start = np.empty(len(self.line_text), np.int64)
        heads = np.cumsum(per_text) - per_text
        is_head = np.zeros(len(self.line_text), bool)
        is_head[heads] = True
        self.line_start[is_head], self.line_start[~is_head] = at[:-1], breaks + 1
        is_tail = np.roll(is_head, -1)
        self.line_end = np.empty_like(self.line_start)
        self.line_end[is_tail], self.line_end[~is_tail] = at[1:], breaks
        begun = np.zeros(len(data) + 1, np.int64)
        begun[starts + 1] = 1
        begun = np.cumsum(begun)
        count = lambda sums: sums[self.line_end] - sums[self.line_start]
        line_words, line_chars = count(begun), count(chars)
        full = np.flatnonzero(line_words > 0)
        begin, end = self.line_start[full], self.line_end[full]
        line = first_equal(data, begin, end, byte_hash(data, begin, end))
        once = np.unique((self.line_text[full] << 32) | line, return_index=True)[1]
        self.n_dup_lines = np.bincount(self.line_text[full], minlength=n) - np.bincount(self.line_text[full][once], minlength=n)

        lone = starts[(stops - starts == 1) & _SEPARATOR[data[starts]]] if len(starts) else starts
        separators = np.zeros(len(data) + 1, np.int64)
        separators[lone + 1] = 1
        separators = count(np.cumsum(separators))
        punctuation = count(total(_PUNCTUATION[data]))
        bad = (line_words >= 3) & (punctuation > rules.punctuation_share * line_chars)
        bad |= (separators >= 2) & (separators > rules.separator_share * line_words)
        bad |= (line_words <= rules.short_line_words) & self._furniture()
        self.line_bad = bad & (line_words > 0)
        self.n_lines = np.bincount(self.line_text[full], minlength=n)
        self.n_removed = np.bincount(self.line_text[self.line_bad], minlength=n)
        lost = np.bincount(self.line_text[self.line_bad], line_chars[self.line_bad], n)
        self.base_failed = (self.n_words < rules.min_words) | (100 * self.n_repeat_words > rules.max_repeat_percent * self.n_words)
        self.kept = ~self.base_failed & (lost <= rules.max_lost_share * self.word_chars)

    def _repeated(self, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words of each text that lie in a window that occurs twice in it (``word``: a number of its bytes)."""
        size, n = self.rules.window, len(first) - 1
        windows = np.maximum(self.n_words - size + 1, 0)
        place = np.repeat(first[:-1], windows) + spread(windows)
        text = np.repeat(np.arange(n), windows)
        value = mix(shingle_hash(mix(word.astype(np.uint64)), size)[place] + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(value)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, value), len(twice) - 1)] == value) if len(twice) else place[:0]
        _, head, of = np.unique(value[at], return_index=True, return_inverse=True)
        lead = at[head][of]  # the hash brought them together, the words decide
        same = text[at] == text[lead]
        for k in range(size if len(at) else 0):
            same &= word[place[at] + k] == word[place[lead] + k]
        keep = same & (np.bincount(of, same, len(head))[of] > 1)
        odd = at[~same]
        if len(odd):  # other words under the same hash
            runs = [(int(text[k]), *word[place[k] : place[k] + size].tolist()) for k in odd]
            times = Counter(runs)
            keep[~same] = [times[r] > 1 for r in runs]
        found = place[at[keep]]
        length = len(word) + 1
        inside = np.cumsum(np.bincount(found, minlength=length) - np.bincount(found + size, minlength=length))[:-1] > 0
        return np.diff(np.concatenate([[0], np.cumsum(inside)])[first])

    def _furniture(self) -> np.ndarray:
        lower = LOWER[self.data].tobytes()
        hit = np.zeros(len(self.line_start), bool)
        for phrase in BOILERPLATE:
            wanted, place = phrase.encode(), -1
            while (place := lower.find(wanted, place + 1)) >= 0:
                line = np.searchsorted(self.line_start, place, "right") - 1
                if place + len(wanted) <= self.line_end[line]:
                    hit[line] = True
        return hit

    def cleaned(self) -> pa.Array:
        """The texts without their bad lines (a removed line takes the line break before it, the first the one after)."""
        keep = np.ones(len(self.data), bool)
        for line in np.flatnonzero(self.line_bad):
            keep[self.line_start[line] : self.line_end[line]] = False
        n = len(self.at) - 1
        good = ~self.line_bad
        line_no = np.arange(len(good)) - np.searchsorted(self.line_text, self.line_text)
        before = np.concatenate([[0], np.cumsum(good)])
        text_first = np.searchsorted(self.line_text, np.arange(n))
        any_before = before[np.arange(len(good))] - before[text_first[self.line_text]] > 0
        # a break stays where a kept line follows it and another stands before it
        inner = np.flatnonzero(line_no > 0)
        keep[self.line_start[inner] - 1] = good[inner] & any_before[inner]
        at = np.concatenate([[0], np.cumsum(keep)])[self.at]
        body = self.data[keep]
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), carry: Sequence[str] = ()) -> DataFrame:
    """Per input row ``doc_id``, the cleaned ``text``, counts, ``base_failed`` and ``kept``.

    Line rules, for lines with a word: *punctuation* (3 words or more, and ASCII punctuation is
    over ``punctuation_share`` of its characters), *navigation* (2 or more words that are a lone
    separator, over ``separator_share`` of its words), *boilerplate* (at most ``short_line_words``
    words, with a phrase of page furniture). A document is kept where the base rules hold
    (``min_words``; at most ``max_repeat_percent`` of its words in repeated windows) and the
    removed lines had at most ``max_lost_share`` of its characters. Counts are of the input
    text; a null text is empty, fails and stays null. Of the other columns those of
    ``carry`` come along, in a struct ``row``.
    """
    bounded_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = SCHEMA + (f", row struct<{fields}>" if carry else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                t = _Texts(data, at, rules)
                text = t.cleaned()
                null = batch.column(1)[first:end].is_null()
                text = pa.array([], pa.string()) if not len(text) else pc.if_else(null, pa.scalar(None, pa.string()), text)
                columns = [batch.column(0)[first:end].cast(pa.int64()), text, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, t.n_lines, t.n_removed, t.base_failed, t.kept]
                names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
                if carry:
                    columns.append(batch.column(2)[first:end])
                    names.append("row")
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return docs.select(id_col, text_col, *([F.struct(*carry).alias("row")] if carry else [])).mapInArrow(run, schema)
