"""License scans against plain loops over words, and the expression parser."""

import itertools
import re

import pytest
from cases import ITEM_WORD, key, lower, rows_of

from archtrail.llm import licenses as L

ODD = [
    (920001, "CC-BY cc by CC\n\nBY-NC 4.0"), (920002, "the GNU General\n * Public-License, version 3, and all rights\treserved"), (920003, "All rights reserved all rights reservedly"),
    (920004, "// SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Foo)\nint x;"), (920005, "# spdx license identifier: MIT AND AND\n"),
    (920006, "Licensed under MIT or Apache-2.0."), (920007, "cc"), (920008, "by cc"), (920009, "general public license general public license"), (None, "mit license"), (920010, "ccé by cc by"),
    (920011, "SPDX-License-Identifier:"), (920012, "x " * 50_000 + "cc by"), (920012, "x " * 50_000 + "cc by"), (920013, "Released under the MIT License."), (920014, "SPDX-License-Identifier: MIT\r\nSPDX-License-Identifier: (BSD-3-Clause)"),
]


def runs(words, phrase):
    wanted = phrase.split(" ")
    return [k for k in range(len(words) - len(wanted) + 1) if words[k : k + len(wanted)] == wanted]


def test_places_and_labels(spark, docs, texts):
    want = []
    for doc, text in texts + ODD:
        words = re.findall(ITEM_WORD, lower(text))
        base = sorted((k, p, L.BASE[p], True) for p in L.BASE for k in runs(words, p))
        longest = {}
        for p in L.NOTICES:
            for k in runs(words, p):
                longest[k] = max(longest.get(k, ""), p, key=len)
        want.append((doc, len(words), tuple(sorted(base + [(k, p, L.NOTICES[p], False) for k, p in longest.items()]))))
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    got = L.scan_licenses(docs.unionByName(odd, allowMissingColumns=True)).collect()
    assert sorted(((r.doc_id, r.n_words, tuple(sorted(tuple(p) for p in r.places))) for r in got), key=key) == sorted(want, key=key)


def test_statements(spark):
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(ODD[:11] + ODD[14:], "doc_id long, text string")).collect()}
    assert got[920004].labels == ["foo", "gpl-2.0-only with classpath-exception-2.0", "mit"] and got[920004].score == 1.0
    assert got[920005].labels == ["unparsed"] and got[920006].labels == ["apache-2.0", "mit"]
    assert (got[920001].labels, got[920001].score) == (["cc-by", "cc-by-nc"], 0.1)
    assert got[920002].labels == ["gpl", "gpl-3.0", "reserved"] and got[920002].score == 0.0
    assert (got[920007].labels, got[920007].score) == ([], L.UNSAID)
    assert got[920013].labels == ["mit"] and got[920014].labels == ["bsd-3-clause", "mit"] and len(got[920014].statements) == 2


def test_parser_equals_python_on_all_small_expressions():
    names = {"mit": 1.0, "gpl": 0.4, "agpl": 0.2}
    for n in range(1, 6):
        for tokens in itertools.product(["mit", "gpl", "agpl", "and", "or", "(", ")"], repeat=n):
            try:
                want = eval(" ".join({"and": "and_", "or": "or_"}.get(t, t) for t in tokens).replace("and_", "&").replace("or_", "|"), {}, {k: _Value(v) for k, v in names.items()}).value
            except (SyntaxError, TypeError, AttributeError):
                want = None
            order = L.postfix(list(tokens))
            assert (L.evaluate(order)[0] if order else None) == want, tokens


class _Value:
    def __init__(self, value):
        self.value = value

    def __and__(self, other):
        return _Value(min(self.value, other.value))

    def __or__(self, other):
        return _Value(max(self.value, other.value))


@pytest.mark.parametrize(("text", "want"), [
    ("MIT", (1.0, ["mit"])), (": mit or agpl-3.0 and gpl-2.0", (1.0, ["agpl-3.0", "gpl-2.0", "mit"])), ("(mit or agpl-3.0) and gpl-2.0", (0.4, ["agpl-3.0", "gpl-2.0", "mit"])),
    ("gpl-3.0+ with a-exception or agpl", (0.6, ["agpl", "gpl-3.0+ with a-exception"])), ("(mit and gpl) with x", (0.5, ["unparsed"])), ("(mit", (0.5, ["unparsed"])), ("mit */", (1.0, ["mit"])),
])
def test_expressions(text, want):
    assert L.read_expression(text, False)[1:] == want


def test_empty_table(none):
    assert L.scan_licenses(none).count() == 0
