"""Quality rules, language model, tokens: each against a plain version in Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import WORD, key, lower, rows_of

from archtrail.llm.queries import vocabulary


def test_quality_counts(docs, texts):
    from archtrail.llm.quality import clean_documents

    want = []
    for doc, text in texts:
        text = text or ""
        words = re.findall(WORD, text)
        lines = [line for line in text.split("\n") if re.search(WORD, line)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        times, inside = Counter(windows), set()
        for k, w in enumerate(windows):
            if times[w] > 1:
                inside |= set(range(k, k + 5))
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        want.append((doc, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed))
    got = clean_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(rows_of(got), key=key) == sorted(want, key=key)


def test_quality_removes_lines_and_keeps_clean_text(spark):
    from archtrail.llm.quality import clean_documents

    good = "Spring came late, and nobody minded.\nThe river rose over its banks.\nBoats were tied up along the mill.\nIn May the water fell again."
    mixed = "We use cookies\n" + good + "\nhome | news | about | contact\n\nwow$$$ buy### now%%% here***"
    docs = spark.createDataFrame([(1, good, "a"), (2, mixed, "b"), (3, "a | b | c | d\n" * 1 + "x | y | z | w " * 4, "c")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in clean_documents(docs, carry=["kept"]).collect()}
    assert (got[1].text, got[1].kept, got[1].n_lines_removed, got[1].row.kept) == (good, True, 0, "a")
    assert (got[2].text, got[2].kept, got[2].n_lines_removed) == (good + "\n", True, 3)
    assert not got[3].kept


def _ppm(rows, order, hold):
    """Counts of training texts, then the code length by walking down the contexts."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    coded = lambda text: list(lower(text).encode()) + [256]
    for doc, text in rows:
        if not hold(doc):
            padded = [0] * order + coded(text)
            for k in range(order + 1):
                for i in range(order, len(padded)):
                    seen[k][tuple(padded[i - k : i])][padded[i]] += 1

    def score(text):
        padded, total = [0] * order + coded(text), 0.0
        for i in range(order, len(padded)):
            out = set()
            for k in range(order, -1, -1):
                here = {s: n for s, n in seen[k].get(tuple(padded[i - k : i]), {}).items() if s not in out}
                if not here:
                    continue
                if padded[i] in here:
                    total += math.log10((2 * here[padded[i]] - 1) / (2 * sum(here.values())))
                    break
                total += math.log10(len(here) / (2 * sum(here.values())))
                out |= set(here)
            else:
                total -= math.log10(257 - len(seen[0][()]))
        return total

    return score


def test_ppm_and_base_scores(docs, texts):
    from archtrail.llm.lm_score import score_documents

    some = [r for r in texts if len(r[1] or "") < 3000]
    hold = lambda doc: zlib.crc32(b"" if doc is None else str(doc).encode()) % 5 == 1
    counts = Counter()
    for doc, text in some:
        if not hold(doc):
            counts.update(re.findall(WORD, lower(text)) + [None])
    total, kinds = sum(counts.values()), len(counts)
    score = _ppm(some, 3, hold)
    want = []
    for doc, text in some:
        tokens = re.findall(WORD, lower(text)) + [None]
        base = sum(math.log10((counts.get(t, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want.append((doc, hold(doc), len(tokens), sum(counts.get(t, 0) > 0 for t in tokens), total, round(base, 6), round(score(text), 3)))
    got = score_documents(docs.where("text is null or length(text) < 3000"), order=3).collect()
    have = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 3)) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_ppm_probabilities_sum_to_one():
    from archtrail.llm.lm_score import code_lengths, distinct

    rng = np.random.default_rng(1)
    text = rng.choice(list(b"abc"), 400)
    key_of = lambda i, symbol: np.uint64(int(text[i - 1]) << 56 | int(text[i - 2]) << 48 | symbol)
    keys = np.array([key_of(i, int(text[i])) for i in range(2, 400)])
    low = np.zeros((256, 257), np.int64)
    for i in range(2, 400):
        low[text[i - 1], text[i]] += 1
    asked = np.array([key_of(50, s) for s in range(257)])
    grams, counts = distinct(np.concatenate([keys, asked]), np.concatenate([np.ones(len(keys), np.int64), np.zeros(257, np.int64)]))
    bits = code_lengths(grams, counts, low, 2)
    assert np.isclose((2.0 ** -bits[np.searchsorted(grams, asked)]).sum(), 1)


def test_held_out_texts_are_coded_better_than_by_words(spark):
    from archtrail.llm.lm_score import score_documents

    got = score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


def test_token_files_equal_the_library(docs, texts, spark, tmp_path):
    from tokenizers import Tokenizer

    from archtrail.llm import token_files as t

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    order = lambda r: (r[0] is not None, r[0] or 0)
    want, start = [], 0
    got = sorted(rows_of(t.token_file_report(docs, path, path=f"{tmp_path}/ids")), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in sorted(texts, key=order)]
    ids = {}
    for doc, text in texts:
        ids.setdefault(doc, []).append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for doc, begin, n, crc in got:
        assert begin == start
        start += n
        assert (n, crc) in [(len(b) // 4, zlib.crc32(b)) for b in ids[doc]]
        want.append(n)
    files = t.read_token_files(spark, f"{tmp_path}/ids")
    assert files.where("doc_id = 900004").select("ids").collect()[0].ids == [*tokenizer.encode("one", add_special_tokens=False).ids, 2]
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,900004)]" in files.where("doc_id = 900004")._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def library():
    """The library's own unigram search over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    from archtrail.llm.pieces import Pieces

    path = vocabulary("piece_bpe_32k.model")
    proto, pieces = sentencepiece_model_pb2.ModelProto(), Pieces(path)
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    for k, piece in enumerate(proto.pieces):
        piece.score = score.get(k, piece.score)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces, score


def test_pieces_of_words_equal_the_library(library, texts):
    from archtrail.llm.sentencepiece_codec import segment, segment_long

    model, pieces, score = library
    words = sorted({w for _, t in texts for w in (t or "").split(" ") if w and len(w) < 40})[:6000]
    found = [("▁" + w).encode() for w in words]
    ids, size = segment(pieces, found)
    worth = lambda got: round(sum(score.get(i, 0) for i in got), 4)
    for word, own in zip(words, np.split(ids, np.cumsum(size)[:-1]), strict=True):
        theirs = model.encode(word)
        assert own.tolist() == theirs or worth(own.tolist()) == worth(theirs)  # single precision there, double here
        assert segment_long(pieces, ("▁" + word).encode()).tolist() == own.tolist()


def test_encode_decode_round_trip_and_counts(docs, texts, library):
    from archtrail.llm.sentencepiece_codec import decode, encode
    from archtrail.llm.token_counts import token_counts

    path = vocabulary("piece_bpe_32k.model")
    got = decode(encode(docs, path), path).collect()
    assert sorted([(r.doc_id, r.decoded) for r in got], key=key) == sorted([(d, (t or "").replace("▁", " ")) for d, t in texts], key=key)
    model = library[0]
    assert all(model.decode(r.ids) == r.decoded for r in got[:60])
    counted = token_counts(docs, path)
    assert sorted(rows_of(counted.select("doc_id", "n_tokens")), key=key) == sorted([(r.doc_id, len(r.ids)) for r in got], key=key)


def test_shared_prefixes_of_sorted_words():
    from archtrail.llm.token_counts import shared_prefixes

    words = sorted([b"a", b"ab", b"abc", b"abd", b"b", b"ba"])
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    assert shared_prefixes(data, np.cumsum(size) - size, size).tolist() == [0, 1, 2, 2, 0, 1]


def test_empty_tables(none, tmp_path):
    from archtrail.llm.lm_score import score_documents
    from archtrail.llm.quality import clean_documents
    from archtrail.llm.sentencepiece_codec import encode
    from archtrail.llm.token_counts import token_counts
    from archtrail.llm.token_files import token_file_report

    model = vocabulary("piece_bpe_32k.model")
    for frame in (clean_documents(none), score_documents(none), encode(none, model), token_counts(none, model), token_file_report(none, vocabulary("word_bpe_49k.json"))):
        assert frame.count() == 0
