"""Strings that share a polynomial sum modulo 2**64, and hashes that fail altogether."""

import re
import zlib

import numpy as np
import pytest
from cases import rows_of

from archtrail.llm import quality
from archtrail.llm.packed import byte_hash, equal_spans, first_equal
from archtrail.llm.queries import vocabulary
from archtrail.llm.word_cache import WordCache


def twins(n: int) -> tuple[str, str]:
    """The Thue-Morse word of ``n`` letters and its complement."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def pair_docs(spark):
    rows = [(2 * k + j, w) for k, n in enumerate((512, 1024, 2048, 4096)) for j, w in enumerate(twins(n))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_byte_hash_by_content_only():
    texts = [b"", b"a", b"ab", b"12345678", b"123456789", b"x" * 511, b"x" * 512, b"x" * 513, *(w.encode() for n in (512, 1024, 2048) for w in twins(n))]
    data = np.frombuffer(b"--".join(texts + texts), np.uint8)
    size = np.array([len(t) for t in texts * 2])
    starts = np.cumsum(size + 2) - size - 2
    got = byte_hash(data, starts, starts + size).tolist()
    assert got[: len(texts)] == got[len(texts) :] and len(set(got)) == len(texts)
    assert equal_spans(data, starts[: len(texts)], data, starts[len(texts) :], size[: len(texts)]).all()
    assert not equal_spans(data, starts[-2:-1], data, starts[-1:], size[-1:]).any()


def test_first_equal_under_one_hash_for_all():
    words = [b"b", b"a", b"b", b"c" * 600, b"a", b"c" * 600, b"d"]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    starts = np.cumsum(size) - size
    assert first_equal(data, starts, starts + size, np.zeros(7, np.uint64)).tolist() == [0, 1, 0, 3, 1, 3, 6]


def test_word_cache_under_one_hash_for_all():
    cache = WordCache(lambda found: (np.array([w[0] for w in found for _ in w]), np.array([len(w) for w in found])), np.dtype(np.int32))
    cache._hash = lambda data, starts, stops: np.zeros(len(starts), np.uint64)
    for words in ([b"b", b"aa", b"b"], [b"ccc", b"aa"]):
        data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        at, n = cache.look_up(data, np.cumsum(size) - size, np.cumsum(size))
        assert cache.gather(at, n).tolist() == [w[0] for w in words for _ in w]


def test_repeated_windows_under_one_hash_for_all(monkeypatch):
    text = b"a b c d e f a b c d e"
    at = np.array([0, len(text)])
    want = quality._Texts(np.frombuffer(text, np.uint8), at, quality.Rules()).n_repeat_words.tolist()
    monkeypatch.setattr(quality, "mix", lambda x: np.zeros(len(x), np.uint64))
    assert quality._Texts(np.frombuffer(text, np.uint8), at, quality.Rules()).n_repeat_words.tolist() == want == [10]


def test_jaccard_join_keeps_twins_apart(pair_docs):
    from archtrail.llm.jaccard_join import similar_groups

    assert all(r.group_id == r.doc_id for r in similar_groups(pair_docs, size=4, percent=85).collect())


def test_token_files_write_each_its_own_ids(pair_docs):
    from tokenizers import Tokenizer

    from archtrail.llm.token_files import token_file_report

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    want = {r.doc_id: crc(r.text) for r in pair_docs.collect()}
    assert {r.doc_id: r.ids_crc32 for r in token_file_report(pair_docs, path).collect()} == want


def test_pieces_come_back_as_text(pair_docs):
    from archtrail.llm.sentencepiece_codec import decode, encode
    from archtrail.llm.token_counts import token_counts

    model = vocabulary("piece_bpe_32k.model")
    got = {r.doc_id: r for r in decode(encode(pair_docs, model), model).collect()}
    assert {k: r.decoded for k, r in got.items()} == dict(rows_of(pair_docs))
    assert {r.doc_id: r.n_tokens for r in token_counts(pair_docs, model).collect()} == {k: r.n_tokens for k, r in got.items()}


def test_lines_and_known_words(spark, pair_docs):
    from archtrail.llm.lm_score import score_documents

    a, b = twins(2048)
    lines = spark.createDataFrame([(1, f"{a}\n{b}\n{a}\n{b}c")], "doc_id long, text string")
    assert quality.clean_documents(lines).first().n_dup_lines == 1
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    seen, unseen = next(k for k in range(99) if not held(k)), next(k for k in range(99) if held(k))
    apart = spark.createDataFrame([(seen, a), (unseen, b)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_documents(apart).collect()}
    assert (got[seen].n_known, got[unseen].n_known) == (2, 1) and not re.search(a, b)
