"""Token counts without token ids: unigram forward scores over a trie of pre-tokens.

The distinct pre-tokens of a task are sorted, which lays out their trie: a word adds a
node for every byte after the prefix it shares with the word before. Nodes of one depth
are scored together, each prefix once however many words share it, and a word's
count is read off where it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from archtrail.llm.chunks import bounded_batches
from archtrail.llm.packed import prefix_sums, slices, span_hash
from archtrail.llm.pieces import Pieces, escape, load, pre_tokens
from archtrail.llm.sentencepiece_codec import BATCHED_BYTES, segment_long
from archtrail.llm.word_cache import WordCache

SCHEMA = "doc_id long, n_tokens long, n_pre_tokens long"


def shared_prefixes(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each of the sorted words shares with the one before."""
    out = np.zeros(len(starts), np.int64)
    row = np.arange(1, len(starts))
    depth = 0
    while len(row):
        row = row[(size[row] > depth) & (size[row - 1] > depth)]
        row = row[data[starts[row] + depth] == data[starts[row - 1] + depth]]
        depth += 1
        out[row] = depth
    return out


def forward_counts(pieces: Pieces, found: list[bytes]) -> np.ndarray:
    """Tokens of the best segmentation of each of the sorted, distinct words (of at most BATCHED_BYTES bytes)."""
    n = len(found)
    size = np.array([len(w) for w in found], np.int64)
    data = np.frombuffer(b"".join(found), np.uint8)
    starts = np.cumsum(size) - size
    sums, shared = prefix_sums(data), shared_prefixes(data, starts, size)
    lead = np.append((data & 0xC0) != 0x80, True)
    depth_max = int(size.max(initial=0))
    best, count = np.full((depth_max + 1, n), -np.inf), np.zeros((depth_max + 1, n), np.int32)
    best[0] = 0
    last_char = np.zeros(n, np.int64)  # depth at which the character that runs on began
    for depth in range(1, depth_max + 1):
        node = np.flatnonzero((size >= depth) & (shared < depth))
        deep = size >= depth
        begins = deep & lead[np.minimum(starts + depth - 1, len(data) - 1)]
        last_char[begins] = depth - 1
        whole = lead[starts[node] + depth] | (size[node] == depth)
        char = np.where(whole, depth - last_char[node], 0)
        score, tokens = np.full(len(node), -np.inf), np.zeros(len(node), np.int32)
        alone = np.zeros(len(node), bool)
        for length in pieces.sizes:
            if length > depth:
                continue
            at = np.flatnonzero(best[depth - length, node] > -np.inf)
            if not len(at):
                continue
            place, hit = pieces.find(span_hash(sums, starts[node[at]] + depth - length, starts[node[at]] + depth))
            at, place = at[hit], place[hit]
            alone[at] |= char[at] == length
            new = best[depth - length, node[at]] + pieces.scores[place]
            more = new > score[at]
            at = at[more]
            score[at], tokens[at] = new[more], count[depth - length, node[at]] + 1
        at = np.flatnonzero((char > 0) & ~alone)
        new = best[depth - char[at], node[at]] + pieces.unknown_score
        more = new > score[at]
        at = at[more]
        score[at], tokens[at] = new[more], count[depth - char[at], node[at]] + (char[at] if pieces.has_bytes else 1)
        # words below a node find its score in their own column
        owner = np.zeros(n, np.int64)
        owner[node] = np.arange(len(node))
        owner = np.maximum.accumulate(owner)
        if len(node):
            best[depth, deep], count[depth, deep] = score[owner[deep]], tokens[owner[deep]]
    return count[size, np.arange(n)]


def count_words(pieces: Pieces, found: list[bytes]) -> np.ndarray:
    out = np.zeros(len(found), np.int64)
    short = [k for k, w in enumerate(found) if len(w) <= BATCHED_BYTES]
    for k in range(0, len(short), 50_000):
        part = short[k : k + 50_000]
        out[part] = forward_counts(pieces, [found[i] for i in part])
    for k, w in enumerate(found):
        if len(w) > BATCHED_BYTES:
            out[k] = len(segment_long(pieces, w))
    return out


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``n_pre_tokens`` of every text, one row per input row; nothing is shuffled.

    Tokens are those of the best unigram segmentation (``Pieces`` has the scores), as
    ``sentencepiece_codec.encode`` gives them, without making them. A null text has none.
    Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file, scores)
        cache = WordCache(lambda found: (count_words(pieces, found), np.ones(len(found), np.int64)), np.dtype(np.int64))
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                data, at = escape(data, at)
                starts, stops, of = pre_tokens(data, at)
                where, _ = cache.look_up(data, starts, stops)
                total = np.concatenate([[0], np.cumsum(cache.values[where])])[of]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end].cast(pa.int64()), pa.array(np.diff(total)), pa.array(np.diff(of))], names=["doc_id", "n_tokens", "n_pre_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
