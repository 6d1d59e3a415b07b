"""Token alignment against the libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import key, rows_of

from archtrail.llm import alignment as A
from archtrail.llm.queries import vocabulary

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = [
    (910001, "▁ marks ▁▁ are no spaces"), (910002, " "), (910003, "  two  spaces   hard　wide   em "), (910004, "<|endoftext|> <s> </s> <0x41> <unk>"),
    (910005, "日本語のテキストは空白なしで書かれることが多い。" * 30), (910006, "\n\n\t tab\r\nline \n \n end"), (910007, "aaaaaaaaaaaaaaaaaaaa" * 500), (910008, "'s 't I'll we've x's"),
    (910009, "\u0085 next \u0085line"), (None, "no id"), (910010, "٣٤٥ Ⅷ ﬁ é \U0001f600"), (910010, "٣٤٥ Ⅷ ﬁ é \U0001f600"), (910011, "\x00 nul \x7f del\x7f \x1c sep"),
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(FILES[0]))
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(FILES[1]))
    name = {v: k for k, v in tokenizer.get_vocab().items()}
    byte = A.byte_level_bytes()
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    every, docs_of = [], Counter()
    for doc, text in rows:
        groups = []
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            bytes_a, bytes_b = [bytes(byte[c] for c in name[i]) for i in a], [piece(i) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                at = [0, 0]
                for end in sorted(set(ends_a) & set(ends_b)):
                    to = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
                    at = to
        linked = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            for i in cx:
                for j in cy:
                    linked[i, j] += cx[i] * cy[j]
        docs_of.update(linked.keys())
        every.append((doc, groups, linked))
    highest = Counter()
    for (i, _), n in docs_of.items():
        highest[i] = max(highest[i], n)
    out = []
    for doc, groups, linked in every:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if docs_of[p] == highest[p[0]]), sum(n * docs_of[p] for p, n in linked.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, docs_of


@pytest.mark.parametrize("bounds", [{}, {"UNIT_BYTES": 60_000, "PIECE_BYTES": 20_000, "LINKS_AT_ONCE": 500, "SMALL_GROUP": 3, "JOINED_WORDS": 3}])
def test_report_and_counts(spark, docs, texts, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(A, name, value)
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    every = docs.unionByName(odd, allowMissingColumns=True).repartition(3)
    want, docs_of = brute(texts + ODD)
    paths = [vocabulary(f) for f in FILES]
    assert sorted(rows_of(A.alignment_report(every, *paths)), key=key) == sorted(want, key=key)
    if not bounds:
        counts = A.pair_counts(A.align(every, *paths), A.vocabulary_sizes(*paths)[1])
        assert {(r.a, r.b): r.n for r in counts.collect()} == dict(docs_of)


def test_tokens_and_group_sizes(spark):
    rows = [(1, "Good morning, world"), (2, None), (3, "")]
    paths = [vocabulary(f) for f in FILES]
    got = {r.doc_id: r for r in A.aligned_tokens(A.align(spark.createDataFrame(rows, "doc_id long, text string"), *paths)).collect()}
    assert len(got) == 3 and got[2].a_ids == got[3].b_ids == []
    assert sum(got[1].a_sizes) == len(got[1].a_ids) and sum(got[1].b_sizes) == len(got[1].b_ids) and len(got[1].a_sizes) == len(got[1].b_sizes) > 1


def test_empty_table(none):
    assert A.alignment_report(none, *(vocabulary(f) for f in FILES)).count() == 0


def test_both_libraries_give_the_same_ids(texts):
    import json

    path = vocabulary(FILES[0])
    tokens = A.ByteTokens(path)
    with open(path, "rb") as f:
        assert tokens._by_ranks(json.load(f), {50256: b"<|endoftext|>"})
    every = [(" " + t).encode() for _, t in texts + ODD if t]
    assert tokens.encode_text(every) == tokens._by_file(path)(every)
