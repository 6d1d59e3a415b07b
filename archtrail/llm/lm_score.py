"""Document scores from a language model learnt on the corpus: prediction by partial matching.

The model is a trie of byte contexts, most recent byte first, with the counts of what
followed. A symbol is coded in the longest context known; where it was not seen there, an
escape (method D: half a count for each symbol seen) goes to the context one byte
shorter, whose counts leave out all symbols already ruled out. Below order 0 what is
left is equally likely. With frozen counts the code length depends only on the last ``order``
bytes and the symbol, so it is worked out once for every such gram of the corpus.

Counts and costs travel between chunks of documents and ranges of the trie:

1. A unit of chunks (those of one input split) sends its distinct grams with their training
   counts to the range of the last two bytes (words, for the base score, to a range of
   hashes).
2. Ranges merge in groups of units first, then across groups, so a frequent context costs
   a row per group. All longer contexts of two bytes are in one range; orders 1 and 0
   are a table of 256 x 257 counts, the only thing that is handed to all.
3. The costs go back to the groups and from there to the units that asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import dealt_parts, each_chunk, expand, no_rows, pack, squeeze, unpack, written
from archtrail.llm.packed import LOWER, byte_hash, release, spread, words

#: Symbols: 256 bytes and the end of the text.
END, SYMBOLS = 256, 257
#: So many units form a group that merges first; range bounds come from at most SAMPLED chunks.
GROUP_UNITS, SAMPLED = 256, 64
BLOB = "bucket int, part int, unit long, data binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, n_bytes long, base_score double, score double"


def held_out(ids: np.ndarray, known: np.ndarray, folds: int, fold: int) -> np.ndarray:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return np.array([zlib.crc32(str(i).encode() if k else b"") % folds == fold for i, k in zip(ids, known, strict=True)], bool)


def grams(data: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and gram of every byte and end: ``order`` bytes before it (zeros before the text), latest first, then 9 bits of symbol."""
    size = np.diff(at)
    end = np.cumsum(size + order + 1)
    stream, is_symbol = np.zeros(int(end[-1]) if len(end) else 0, np.uint16), np.ones(int(end[-1]) if len(end) else 0, bool)
    is_symbol[(np.repeat(end - size - order - 1, order) + spread(np.full(len(size), order)))] = False
    is_end = np.zeros(len(stream), bool)
    is_end[end - 1] = True
    stream[is_symbol & ~is_end] = data
    key = stream.astype(np.uint64)
    key[is_end] = END
    for k in range(1, order + 1):
        key[k:] |= stream[:-k].astype(np.uint64) << np.uint64(64 - 8 * k)
    return np.repeat(np.arange(len(size)), size + 1), key[is_symbol]


def distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], (np.add.reduceat(counts[order], heads) if len(heads) else np.zeros(0, np.int64))


def code_lengths(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, order: int) -> np.ndarray:
    """Bits that each gram's symbol costs in its context; ``counts`` are of training, ``low`` those of orders 1 and 0.

    ``keys`` are distinct and hold all grams of the contexts of two bytes they touch.
    """
    symbol = (keys & np.uint64(511)).astype(np.int64)
    last = (keys >> np.uint64(56)).astype(np.int64)
    bits, undecided = np.zeros(len(keys)), np.ones(len(keys), bool)
    ruled_count, ruled_symbols = np.zeros(len(keys)), np.zeros(len(keys))
    entry = entry_count = context_of_entry = None

    def step(count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        nonlocal undecided
        total, kinds = total - ruled_count, kinds - ruled_symbols
        here = undecided & (total > 0)
        coded, escaped = here & (count > 0), here & (count == 0)
        bits[coded] -= np.log2((2 * count[coded] - 1) / (2 * total[coded]))
        bits[escaped] -= np.log2(kinds[escaped] / (2 * total[escaped]))
        undecided &= ~coded

    def rule_out(count: np.ndarray) -> np.ndarray:
        """Per gram: how often, in this context, what the longer one has seen occurs."""
        below = np.zeros(len(entry_count))
        below[entry] = count
        return np.bincount(context_of_entry, np.where(entry_count > 0, below, 0))[context_of_entry[entry]]

    for k in range(order, 1, -1):
        mask = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - 8 * k)) & 0xFFFFFFFFFFFFFFFF)
        value, this_entry = np.unique((keys & mask) | symbol.astype(np.uint64), return_inverse=True)
        this_count = np.bincount(this_entry, counts, len(value))
        this_context = np.unique(value & mask, return_inverse=True)[1]
        total, kinds = np.bincount(this_context, this_count), np.bincount(this_context, this_count > 0)
        count, of = this_count[this_entry], this_context[this_entry]
        if entry is not None:
            ruled_count = rule_out(count)
        step(count, total[of], kinds[of])
        entry, entry_count, context_of_entry, ruled_symbols = this_entry, this_count, this_context, kinds[of]
    seen, zero = low > 0, low.sum(0)
    if entry is not None:
        ruled_count = rule_out(low[last, symbol])
    step(low[last, symbol], low.sum(1)[last], seen.sum(1)[last])
    ruled_count, ruled_symbols = (seen * zero).sum(1)[last], seen.sum(1)[last]
    step(zero[symbol], np.full(len(keys), zero.sum()), np.full(len(keys), (zero > 0).sum()))
    bits[undecided] += np.log2(SYMBOLS - (zero > 0).sum())
    return bits


class _Chunk:
    """Words and grams of one chunk's documents."""

    def __init__(self, row: dict, order: int, folds: int, fold: int) -> None:
        self.ids, self.known, self.at, data = unpack(row)
        self.data = LOWER[data]
        self.held = held_out(self.ids, self.known, folds, fold)
        self.order = order

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        starts, stops, first = words(self.data, self.at)
        return byte_hash(self.data, starts, stops), first

    def distinct_words(self) -> tuple[np.ndarray, np.ndarray]:
        hashed, first = self.words()
        return distinct(hashed, (~np.repeat(self.held, np.diff(first))).astype(np.int64))

    def distinct_grams(self) -> tuple[np.ndarray, np.ndarray]:
        text, keys = grams(self.data, self.at, self.order)
        return distinct(keys, (~self.held[text]).astype(np.int64))


class _Merged:
    """Distinct keys and counts of several chunks, merged as they come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > 2 * len(self.parts[0][0]) + 1_000_000:
            self.parts = [self.total()]
            self.waiting = 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return distinct(*(np.concatenate(x) for x in zip(none, *self.parts, strict=True)))


def _spread_costs(keys: np.ndarray, text: np.ndarray, known: np.ndarray, value: np.ndarray, n: int, worth) -> list[np.ndarray]:  # noqa: ANN001
    """Sums per text of ``worth`` (functions of a value) over ``keys``, whose values stand beside the sorted ``known``."""
    order = np.argsort(keys)
    heads = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0)) if len(keys) else np.zeros(0, np.int64)
    found = value[np.searchsorted(known, keys[order[heads]])]
    times, owner = np.diff(np.append(heads, len(keys))), text[order]
    return [np.bincount(owner, np.repeat(w(found), times), n) for w in worth]


def _rows(bucket: list[int], part: int, unit: list[int], data: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(bucket, pa.int32()), pa.array([part] * len(bucket), pa.int32()), pa.array(unit, pa.int64()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "part", "unit", "data"])


def _deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _low_orders(chunks: DataFrame, order: int, folds: int, fold: int, n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts by last byte and symbol, and (from a bounded sample) distinct grams by last two bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, load = np.zeros(256 * 512, np.int64), np.zeros(65536, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                c = _Chunk(row, 1, folds, fold)
                text, keys = grams(c.data, c.at, 1)
                keys = keys[~c.held[text]]
                low += np.bincount(((keys >> np.uint64(56)) << np.uint64(9) | (keys & np.uint64(511))).astype(np.int64), minlength=len(low))
                if n_chunks <= SAMPLED or zlib.crc32(str(row["chunk"]).encode()) % n_chunks < SAMPLED:
                    c.order = order
                    load += np.bincount((c.distinct_grams()[0] >> np.uint64(48)).astype(np.int64), minlength=65536)
        yield _rows([k for k in range(8)], 0, [0] * 8, [squeeze(low[k::8], load[k::8]) for k in range(8)])

    def total(table: pa.Table) -> pa.Table:
        low, load = (sum(x) for x in zip(*(expand(d) for d in table["data"].to_pylist()), strict=True))
        return pa.Table.from_batches([_rows([table["bucket"][0].as_py()], 0, [0], [squeeze(low, load)])])

    low, load = np.zeros(256 * 512, np.int64), np.zeros(65536, np.int64)
    for row in chunks.mapInArrow(count, BLOB).groupBy("bucket").applyInArrow(total, BLOB).collect():
        low[row["bucket"] :: 8], load[row["bucket"] :: 8] = expand(bytes(row["data"]))
    return low.reshape(256, 512)[:, :SYMBOLS], load


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, folds: int = 5, fold: int = 1) -> DataFrame:
    """Score every text under a model of the documents that are not held out.

    Held out are those whose ``crc32(id as text) % folds = fold``. Per input row: ``doc_id``,
    ``held_out``, ``n_tokens`` (words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end),
    ``n_known`` (tokens that occur in training), ``train_tokens`` (of all training documents),
    ``n_bytes``, ``base_score`` (add-half unigram, log10) and ``score`` (log10 probability of the
    lower-cased bytes and their end; the code length in bits is ``-score / log10(2)``). A
    null text is empty; a row with a null id is in training; repeated rows count each.
    ``order`` (2 to 6) bytes of context. Words are told apart by 64-bit hashes.
    """
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")
    spark = docs.sparkSession
    chunks = pack(docs, id_col, text_col)
    n_chunks = chunks.count()
    low, load = _low_orders(chunks, order, folds, fold, n_chunks)
    shared = spark.sparkContext.broadcast(low)  # 256 x 257 counts
    n_buckets = 3 * dealt_parts(spark)
    range_of = (np.cumsum(load) - load // 2) * n_buckets // max(1, load.sum())  # of the last two bytes
    chunks = chunks.withColumn("unit", F.shiftright("chunk", 32))
    groups = max(1, chunks.select("unit").distinct().count() // GROUP_UNITS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, word_counts, gram_counts = None, _Merged(), _Merged()

        def emit() -> Iterator[pa.RecordBatch]:
            part = zlib.crc32(str(unit).encode()) % groups
            keys, counts = word_counts.total()
            cuts = np.searchsorted(keys, (np.arange(1, n_buckets, dtype=np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF // n_buckets)))
            for b, (k, n) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                if len(k):
                    yield _rows([b], part, [unit], [squeeze(_deltas(k), n.astype(np.int32))])
            keys, counts = gram_counts.total()
            for b, first, end in _runs(range_of[(keys >> np.uint64(48)).astype(np.int64)]):
                yield _rows([n_buckets + b], part, [unit], [squeeze(_deltas(keys[first:end]), counts[first:end].astype(np.int32))])

        for row in (r for batch in batches for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
            if unit is not None and row["unit"] != unit:
                yield from emit()
                word_counts, gram_counts = _Merged(), _Merged()
            unit = row["unit"]
            c = _Chunk(row, order, folds, fold)
            word_counts.add(*c.distinct_words())
            gram_counts.add(*c.distinct_grams())
            release()
        if unit is not None:
            yield from emit()

    asked = written(chunks.mapInArrow(send, BLOB))
    no_blobs, no_scores = no_rows(BLOB), no_rows(SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        blobs = [expand(x) for x in table["data"].to_pylist()]
        keys, counts = distinct(np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blobs]), np.concatenate([b[1].astype(np.int64) for b in blobs]))
        return pa.Table.from_batches([_rows([table["bucket"][0].as_py()], table["part"][0].as_py(), [-1], [squeeze(_deltas(keys), counts)])])

    def decide(table: pa.Table) -> pa.Table:
        merged = merge(table)
        keys, counts = expand(merged["data"][0].as_py())
        keys = np.cumsum(keys, dtype=np.uint64)
        bucket = merged["bucket"][0].as_py()
        value = counts.astype(np.float64) if bucket < n_buckets else code_lengths(keys, counts, shared.value, order)
        out = []
        parts = table["part"].to_pylist()
        for part, blob in zip(parts, table["data"].to_pylist(), strict=True):  # each group gets what it asked for
            own = np.cumsum(expand(blob)[0], dtype=np.uint64)
            out.append(_rows([bucket], part, [int((counts > 0).sum()) if part == min(parts) and bucket < n_buckets else 0], [squeeze(_deltas(own), value[np.searchsorted(keys, own)])]))
        return pa.Table.from_batches(out)

    merged = asked.groupBy("bucket", "part").applyInArrow(merge, BLOB)
    decided = written(merged.groupBy("bucket").applyInArrow(decide, BLOB))

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return no_blobs
        keys, value = expand(right["data"][0].as_py())
        keys = np.cumsum(keys, dtype=np.uint64)
        bucket, part = left["bucket"][0].as_py(), left["part"][0].as_py()
        kind = np.int64 if bucket < n_buckets else np.float32
        out = []
        for unit, blob in zip(left["unit"].to_pylist(), left["data"].to_pylist(), strict=True):
            own = np.cumsum(expand(blob)[0], dtype=np.uint64)
            out.append(_rows([bucket], part, [unit], [squeeze(_deltas(own), value[np.searchsorted(keys, own)].astype(kind))]))
        return pa.Table.from_batches(out)

    both = asked.groupBy("bucket", "part").cogroup(decided.groupBy("bucket", "part"))
    answers = both.applyInArrow(reply, BLOB)

    distinct_words = decided.agg(F.sum("unit")).first()[0] or 0
    trained = int(low[:, END].sum())
    train_words = each_chunk(chunks, lambda row: _count_words(row, folds, fold), "n long").agg(F.sum("n")).first()[0] or 0
    all_tokens, kinds = train_words + trained, distinct_words + (trained > 0)
    below = all_tokens + 0.5 * (kinds + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(right.to_pylist(), key=lambda g: g["bucket"])

        def take(words: bool) -> tuple[np.ndarray, np.ndarray]:
            parts = [expand(g["data"]) for g in got if (g["bucket"] < n_buckets) == words]
            keys = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(p[0], dtype=np.uint64) for p in parts)])
            return keys, np.concatenate([np.zeros(0), *(p[1].astype(np.float64) for p in parts)])

        word_values, gram_values = take(True), take(False)
        return pa.concat_tables([no_scores, *(score(row, word_values, gram_values) for row in left.to_pylist())], promote_options="permissive")

    def score(row: dict, word_values: tuple, gram_values: tuple) -> pa.Table:
        c = _Chunk(row, order, folds, fold)
        n = len(c.ids)
        hashed, first = c.words()
        n_words = np.diff(first)
        base, known = _spread_costs(hashed, np.repeat(np.arange(n), n_words), *word_values, n, [lambda v: np.log10((v + 0.5) / below), lambda v: v > 0])
        text, keys = grams(c.data, c.at, order)
        (bits,) = _spread_costs(keys, text, *gram_values, n, [lambda v: v])
        return pa.table(
            {
                "doc_id": pa.array(c.ids, mask=~c.known), "held_out": c.held, "n_tokens": n_words + 1, "n_known": known.astype(np.int64) + (trained > 0),
                "train_tokens": np.full(n, all_tokens), "n_bytes": np.diff(c.at), "base_score": base + np.log10((trained + 0.5) / below), "score": -bits * np.log10(2),
            }
        )

    both = chunks.groupBy("unit").cogroup(answers.groupBy("unit"))
    return both.applyInArrow(finish, SCHEMA)


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for first, end in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
        yield int(bucket[first]), int(first), int(end)


def _count_words(row: dict, folds: int, fold: int) -> Iterator[pa.RecordBatch]:
    c = _Chunk(row, 2, folds, fold)
    _, _, first = words(c.data, c.at)
    yield pa.RecordBatch.from_arrays([pa.array([int(np.diff(first)[~c.held].sum())])], names=["n"])
