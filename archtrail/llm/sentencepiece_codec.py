"""SentencePiece encoding and decoding by batched Viterbi.

The best segmentation of a text is that of its pre-tokens, and equal ones have equal
results, so each task segments its distinct pre-tokens: all of one length advance
together, byte by byte; hashes of the substrings that end there probe the sorted piece
keys, and maxima over them store scores and back-pointers for the whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from archtrail.llm.chunks import bounded_batches
from archtrail.llm.packed import prefix_sums, slices, span_hash
from archtrail.llm.pieces import SPACE_MARK, Pieces, escape, load, pre_tokens
from archtrail.llm.word_cache import WordCache

#: Longer pre-tokens (in bytes) are segmented one at a time.
BATCHED_BYTES = 96
SCHEMA = "doc_id long, ids array<int>, n_tokens long"


def _char_sizes(word: np.ndarray) -> np.ndarray:
    """Bytes of the character that ends before each place 1..n of the rows (0: inside a character)."""
    lead = (word & 0xC0) != 0x80
    ends = np.ones(word.shape, bool)
    ends[..., :-1] = lead[..., 1:]
    place = np.arange(1, word.shape[-1] + 1)
    last = np.maximum.accumulate(np.where(lead, place, 0), axis=-1)
    return np.where(ends, place - last + 1, 0)


def _segment_batch(pieces: Pieces, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of ``rows`` of equal length: their ids in text order and how many each has."""
    n, length = rows.shape
    sums = prefix_sums(rows.ravel())
    base = np.arange(n) * length
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back, piece = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
    char = _char_sizes(rows)
    for end in range(1, length + 1):
        alone = np.zeros(n, bool)  # a piece is the last character alone
        for size in pieces.sizes:
            if size > end:
                continue
            row = np.flatnonzero(best[end - size] > -np.inf)
            if not len(row):
                continue
            place, found = pieces.find(span_hash(sums, base[row] + end - size, base[row] + end))
            row, place = row[found], place[found]
            alone[row] |= char[row, end - 1] == size
            score = best[end - size, row] + pieces.scores[place]
            more = score > best[end, row]
            row, place = row[more], place[more]
            best[end, row], back[end, row], piece[end, row] = score[more], size, pieces.ids[place]
        row = np.flatnonzero((char[:, end - 1] > 0) & ~alone)
        size = char[row, end - 1]
        score = best[end - size, row] + pieces.unknown_score
        more = score > best[end, row]
        row, size = row[more], size[more]
        best[end, row], back[end, row], piece[end, row] = score[more], size, -1
    return _walk_back(pieces, rows, back, piece)


def _walk_back(pieces: Pieces, rows: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, length = rows.shape
    out = np.full((n, length), -1, np.int32)  # an id at the place where its piece starts; no more ids than bytes
    at, row = np.full(n, length), np.arange(n)
    while len(row):
        size, kind = back[at[row], row], piece[at[row], row]
        start = at[row] - size
        known = kind >= 0
        out[row[known], start[known]] = kind[known]
        for r, s, k in zip(row[~known], start[~known], size[~known], strict=True):
            out[r, s : s + k] = pieces.byte_id[rows[r, s : s + k]] if pieces.has_bytes else [pieces.unknown_id] + [-1] * (k - 1)
        at[row] = start
        row = row[start > 0]
    return out[out >= 0], (out >= 0).sum(1)


def segment_long(pieces: Pieces, word: bytes) -> np.ndarray:
    """The same for one long pre-token, with the pieces in a dictionary."""
    if not hasattr(pieces, "table"):
        keys = {pieces.bytes[i]: (float(s), int(i)) for i, s in zip(pieces.ids, pieces.scores, strict=True)}
        pieces.table = keys
    n = len(word)
    char = _char_sizes(np.frombuffer(word, np.uint8))
    best, back = [0.0] + [-np.inf] * n, [(0, 0)] * (n + 1)
    for end in range(1, n + 1):
        c = int(char[end - 1])
        if not c:
            continue
        for size in pieces.sizes:
            if size > end:
                continue
            got = pieces.table.get(word[end - size : end])
            if got and best[end - size] + got[0] > best[end]:
                best[end], back[end] = best[end - size] + got[0], (size, got[1])
        if word[end - c : end] not in pieces.table and best[end - c] + pieces.unknown_score > best[end]:
            best[end], back[end] = best[end - c] + pieces.unknown_score, (c, -1)
    out, end = [], n
    while end:
        size, kind = back[end]
        out.append([kind] if kind >= 0 else pieces.byte_id[np.frombuffer(word[end - size : end], np.uint8)].tolist() if pieces.has_bytes else [pieces.unknown_id])
        end -= size
    return np.array([i for part in reversed(out) for i in part], np.int32)


def segment(pieces: Pieces, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens, one after the other, and how many each has."""
    size = np.array([len(w) for w in found], np.int64)
    ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(found)
    for length in np.unique(size):
        of = np.flatnonzero(size == length)
        if length > BATCHED_BYTES:
            for k in of:
                ids[k] = segment_long(pieces, found[k])
            continue
        for part in np.array_split(of, -(-len(of) * int(length) // 400_000)):
            rows = np.frombuffer(b"".join(found[k] for k in part), np.uint8).reshape(len(part), int(length))
            values, count = _segment_batch(pieces, rows)
            for k, v in zip(part, np.split(values, np.cumsum(count)[:-1]), strict=True):
                ids[k] = v
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(v) for v in ids], np.int64)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", scores: str = "zipf") -> DataFrame:
    """``doc_id``, ``ids`` and ``n_tokens`` of every text; one row per input row, nothing is shuffled.

    As the library does for this kind of model: a space stands before a text that is not
    empty, spaces become U+2581, a character without a piece becomes its bytes. A null text
    is empty and has no ids. Of segmentations with one score, that with the longer last
    piece is taken. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file, scores)
        cache = WordCache(lambda found: segment(pieces, found), np.dtype(np.int32))
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                data, at = escape(data, at)
                starts, stops, of = pre_tokens(data, at)
                where, size = cache.look_up(data, starts, stops)
                offsets = np.concatenate([[0], np.cumsum(size)])[of]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cache.gather(where, size), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end].cast(pa.int64()), ids, pa.array(np.diff(offsets))], names=["doc_id", "ids", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of ``ids_col``; null ids give a null text.

    Pieces are joined, marks become spaces and the one before the text goes; bytes that are
    no UTF-8 are replaced by U+FFFD.
    """
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", decoded string"
    columns = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_file)
        size = np.array([len(b) for b in pieces.bytes], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        body = np.frombuffer(b"".join(pieces.bytes), np.uint8)
        for batch in batches:
            lists = batch.column(columns.index(ids_col))
            texts = []
            for k in range(0, len(lists), 256):
                part = lists[k : k + 256]
                ids, offsets = part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part), 0)))])
                each = size[ids]
                which = np.repeat(at[:-1][ids] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                joined = body[which].tobytes()
                ends = np.concatenate([[0], np.cumsum(each)])[offsets]
                for null, a, b in zip(part.is_null().to_pylist(), ends[:-1], ends[1:], strict=True):
                    text = joined[a:b].replace(SPACE_MARK, b" ")
                    texts.append(None if null else text[1 if text[:1] == b" " else 0 :].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, schema)
