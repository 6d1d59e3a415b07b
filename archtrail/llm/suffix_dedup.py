"""Removal of repeated passages by a distributed suffix array.

Every string of ``span`` bytes that starts in a document with a smaller id is cut.

1. Of all suffixes only those at anchors take part at first: an anchor is where the
   hash of ``LEAD`` bytes is smallest among the places a ``span``-byte string offers.
   It depends on the string alone, so equal strings have their anchor at the same
   place, and one byte in about 18 is one.
2. Anchor suffixes are range-partitioned by their leading tokens (8 bytes each) with
   sampled splitters. A token that alone fills several ranges is divided by the next
   ones. Each chunk of documents sends a leading string once, however often it has it.
3. A bucket sorts its suffixes by multikey sort and marks leading strings that occur in
   two documents. Splitters cut between leading strings, so the last suffix of a bucket
   and the first of the next differ there and no match reaches over a boundary.
4. For marked anchors the surrounding bytes follow (once per chunk for equal ones).
   Buckets sort all suffixes that start in them, token by token up to ``span`` bytes,
   comparing only what is still tied, and find the smallest document of equal strings.
5. Each chunk gets its answer as bits and cuts its documents.

Nothing is bounded by a cap: a passage in every document costs one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import answer_chunks, carried, dealt_parts, each_chunk, expand, pack, squeeze, unpack, written
from archtrail.llm.packed import byte_hash, piece_hashes, prefix_sums, release, span_hash, spread

#: Bytes of a suffix that an anchor is chosen by and that deal it out (two tokens of 8).
LEAD = 16
#: A bucket is planned for about this many bytes of text.
BUCKET_BYTES = 32_000_000
#: Splitters are taken from at most about this many chunks and this many suffixes of each.
SAMPLED_CHUNKS, SAMPLED_SUFFIXES = 64, 512
#: Bytes of text in a chunk, and of those whose hashes are held at once.
CHUNK_BYTES, STRETCH_BYTES = 2_000_000, 1_000_000
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def multikey_sort(n: int, tokens: list[Callable[[np.ndarray | slice], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``n`` rows by their tokens and, in that order, where a row differs from the one before.

    The first token is taken and sorted for all rows, each further one only for rows
    that are still tied. A token is a function from rows to values.
    """
    value = tokens[0](slice(None))
    order = np.argsort(value)
    fresh = np.ones(n, bool)
    fresh[1:] = value[order[1:]] != value[order[:-1]]
    for token in tokens[1:]:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        rows = order[at]
        value = token(rows)
        by_value = np.argsort(value)
        rank = np.empty(len(at), np.int64)
        rank[by_value] = np.cumsum(np.append(0, value[by_value[1:]] != value[by_value[:-1]]))
        key = (np.cumsum(fresh[at]) << 32) | rank
        within = np.argsort(key)
        order[at] = rows[within]
        key = key[within]
        fresh[at[1:]] = key[1:] != key[:-1]
    return order, fresh


def token_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number that sorts as they do (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    every = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    return every[at].astype(np.uint64)


def _stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents of a chunk in stretches of about STRETCH_BYTES, which bound what is held at once."""
    first = 0
    while first < len(at) - 1:
        end = int(max(first + 1, np.searchsorted(at, at[first] + STRETCH_BYTES, "right") - 1))
        yield first, end
        first = end


def _anchors(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, its first and last string start, and the hash of its leading bytes."""
    parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for first, end in _stretches(at):
        *places, lead = _anchors_of(data[at[first] : at[end]], at[first : end + 1] - at[first], span)
        parts.append((*(p + at[first] for p in places), lead))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _region_hashes(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each region; no region crosses documents."""
    out, order = np.empty(len(low), np.uint64), np.argsort(low)
    ordered = low[order]
    for first, end in _stretches(at):
        of = order[np.searchsorted(ordered, at[first]) : np.searchsorted(ordered, at[end])]
        if len(of):
            out[of] = byte_hash(data[at[first] : at[end]], low[of] - at[first], high[of] - at[first])
    return out


def _anchors_of(data: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    n = len(data) - span + 1
    if n < 1:
        return none, none, none, none.astype(np.uint64)
    places = np.arange(len(data) - LEAD + 1)
    lead = span_hash(prefix_sums(data), places, places + LEAD) >> np.uint64(32)
    least = (lead << np.uint64(32)) | places.astype(np.uint64)
    width, k = span - LEAD + 1, 1
    while k * 2 <= width:
        np.minimum(least[:-k], least[k:], out=least[:-k])
        k *= 2
    if width > k:
        least[: k - width] = np.minimum(least[: k - width], least[width - k :])
    chosen = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = np.zeros(len(data) + 1, np.int32)
    ok = at[1:] - at[:-1] >= span
    np.add.at(whole, at[:-1][ok], 1)
    np.add.at(whole, at[1:][ok] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:n]) > 0)  # strings that lie in one document
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    chosen = chosen[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    anchor = chosen[first]
    return anchor, starts[first], starts[last], lead[anchor]


class _Leads:
    """The anchors of a chunk and its distinct leading strings, in bucket order."""

    def __init__(self, row: dict, span: int, splitters: np.ndarray) -> None:
        self.ids, self.known, self.at, self.data = unpack(row)
        self.anchor, self.low, self.high, lead = _anchors(self.data, self.at, span)
        doc = np.searchsorted(self.at, self.anchor, "right") - 1
        usable = self.known[doc]  # a document without id neither repeats nor is repeated
        self.anchor, self.low, self.high, lead, doc = (x[usable] for x in (self.anchor, self.low, self.high, lead, doc))
        self.id = self.ids[doc]
        token = token_at(self.data, self.anchor)
        order, fresh = multikey_sort(len(token), [token.__getitem__, lead.__getitem__])
        self.order, self.group = order, np.cumsum(fresh) - 1
        heads = np.flatnonzero(fresh)
        self.token, self.lead = token[order[heads]], lead[order[heads]].astype(np.uint32)
        ids = self.id[order]
        self.several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads) if len(heads) else np.zeros(0, bool)
        left, right = np.searchsorted(splitters, self.token, "left"), np.searchsorted(splitters, self.token, "right")
        self.bucket = left + self.lead % (right - left + 1)


def _batch(**columns: list) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int64(), "data": pa.binary(), "token": pa.decimal128(20, 0)}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


def _splitters(chunks: DataFrame, span: int, n_buckets: int, n_chunks: int) -> np.ndarray:
    """Bounds of the buckets from a bounded sample; they only balance the work."""

    def sample(row: dict) -> Iterator[pa.RecordBatch]:
        token = _Leads(row, span, np.zeros(0, np.uint64)).token
        picked = np.random.default_rng(row["chunk"] & 0xFFFFFFFF).choice(token, min(len(token), SAMPLED_SUFFIXES), replace=False)
        yield _batch(data=[picked.tobytes()])

    part = chunks if n_chunks <= SAMPLED_CHUNKS else chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(n_chunks)) < SAMPLED_CHUNKS)
    got = each_chunk(part, sample, "data binary").collect()
    tokens = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(bytes(r[0]), np.uint64) for r in got)]))
    if not len(tokens):
        return tokens
    return tokens[(np.arange(1, n_buckets) * len(tokens)) // n_buckets]


def _mark_shared(table: pa.Table) -> pa.Table:
    """Per sender: which of its leading strings occur in another document too."""
    blobs = [expand(x) for x in table["data"].to_pylist()]
    token, lead, several = (np.concatenate(x) for x in zip(*blobs, strict=True))
    order, fresh = multikey_sort(len(token), [token.__getitem__, lead.__getitem__])
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(order)))
    group = np.cumsum(fresh) - 1
    some = np.bincount(group, several[order], len(heads)) > 0
    mark = np.zeros(len(order), bool)
    mark[order] = (some | (size > 1))[group]
    cuts = np.cumsum([len(b[0]) for b in blobs])[:-1]
    del token, lead, several, order, fresh, group
    release()
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "data": [np.packbits(m).tobytes() for m in np.split(mark, cuts)]},
                    schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())]))


def _regions(row: dict, marks: list[dict], span: int, splitters: np.ndarray) -> tuple[_Leads, np.ndarray, np.ndarray, np.ndarray]:
    """Marked anchors of a chunk: rows, class of each, and per class its head, smallest id and bucket."""
    leads = _Leads(row, span, splitters)
    shared = np.zeros(len(leads.token), bool)
    for m in marks:
        of = np.flatnonzero(leads.bucket == m["bucket"])
        shared[of] = np.unpackbits(np.frombuffer(m["data"], np.uint8), count=len(of)).astype(bool)
    keep = shared[leads.group]
    rows, bucket = leads.order[keep], leads.bucket[leads.group[keep]]
    content = _region_hashes(leads.data, leads.at, leads.low[rows], leads.high[rows] + span)
    offset = leads.anchor[rows] - leads.low[rows]
    order, fresh = multikey_sort(len(rows), [content.__getitem__, offset.__getitem__])
    heads = np.flatnonzero(fresh)
    rows, bucket = rows[order], bucket[order]
    least = np.minimum.reduceat(leads.id[rows], heads) if len(heads) else np.zeros(0, np.int64)
    return leads, rows, np.cumsum(fresh) - 1, np.stack([rows[heads], least, bucket[heads]])


def _find_repeats(table: pa.Table, span: int) -> pa.Table:
    """Per sender and string of its regions: does it also start in a smaller document?"""
    blobs = [expand(x) for x in table["data"].to_pylist()]
    least, count, body = (np.concatenate(x) for x in zip(*blobs, strict=True))
    count = count.astype(np.int64)
    size = count + span - 1
    at = np.cumsum(size) - size
    content = piece_hashes(body, np.append(at, len(body)))  # equal regions of several senders are sorted once
    order, fresh = multikey_sort(len(at), [content.__getitem__, size.__getitem__])
    heads, group = np.flatnonzero(fresh), np.empty(len(at), np.int64)
    group[order] = np.cumsum(fresh) - 1
    region_least, region = np.minimum.reduceat(least[order], heads), order[heads]
    start = np.repeat(at[region], count[region]) + spread(count[region])
    owner = np.repeat(region_least, count[region])
    steps = dict.fromkeys([*range(0, span - 7, 8), span - 8])
    order, fresh = multikey_sort(len(start), [lambda rows, k=k: token_at(body, start[rows] + k) for k in steps])
    smallest = np.empty(len(start), np.int64)
    smallest[order] = np.minimum.reduceat(owner[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
    place = np.cumsum(count[region]) - count[region]
    repeat = smallest[np.repeat(place[group], count) + spread(count)] < np.repeat(least, count)
    cuts = np.cumsum([int(b[1].sum()) for b in blobs])[:-1]
    del body, start, owner, order, fresh, smallest
    release()
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "data": [np.packbits(m).tobytes() for m in np.split(repeat, cuts)]},
                    schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())]))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50, carry: Sequence[str] = (), whole_chars: bool = False) -> DataFrame:
    """Cut every byte covered by a ``span``-byte string that also starts in a smaller document.

    Returns ``doc_id``, ``n_bytes`` (of the UTF-8 text), ``spans`` (maximal removed runs,
    byte offsets, end exclusive) and ``kept`` (the other bytes, joined). Matches never cross
    documents and are judged on the input. One row per input row; of the other columns
    those of ``carry`` come along, in a struct ``row``. A null text is empty. Rows with equal ids are no smaller than each other; a row
    with a null id keeps all and removes nothing elsewhere. ``span`` is 24 at least. With
    ``whole_chars`` a character of which a byte goes is removed, so ``kept`` is UTF-8.
    """
    if span < LEAD + 8:
        raise ValueError(f"span must be {LEAD + 8} at least")
    chunks = pack(docs, id_col, text_col, CHUNK_BYTES, carry)
    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = SCHEMA + (f", row struct<{fields}>" if carry else "")
    total, n_chunks = chunks.agg(F.sum("n_bytes"), F.count("*")).first()
    n_buckets = 6 * max(dealt_parts(docs.sparkSession), (total or 0) // BUCKET_BYTES)  # several a task even out
    splitters = _splitters(chunks, span, n_buckets, n_chunks)

    def send_leads(row: dict) -> Iterator[pa.RecordBatch]:
        leads = _Leads(row, span, splitters)
        for b in np.unique(leads.bucket):
            of = leads.bucket == b
            yield _batch(bucket=[int(b)], chunk=[row["chunk"]], data=[squeeze(leads.token[of], leads.lead[of], leads.several[of])])

    blob = "bucket int, chunk long, data binary"
    answer = "chunk long, bucket int, data binary"
    marks = written(each_chunk(chunks, send_leads, blob).groupBy("bucket").applyInArrow(_mark_shared, answer))

    def send_regions(row: dict, marks: list[dict]) -> pa.Table:
        leads, _, _, (rows, least, bucket) = _regions(row, marks, span, splitters)
        out: dict[str, list] = {"bucket": [], "chunk": [], "data": []}
        for b in np.unique(bucket):
            of = rows[bucket == b]
            size = leads.high[of] - leads.low[of] + span
            body = leads.data[np.repeat(leads.low[of], size) + spread(size)]
            out["bucket"].append(int(b))
            out["chunk"].append(row["chunk"])
            out["data"].append(squeeze(least[bucket == b], (size - span + 1).astype(np.uint16), body))
        return pa.Table.from_batches([_batch(**out)])

    repeats = answer_chunks(chunks, marks, send_regions, blob).groupBy("bucket").applyInArrow(lambda t: _find_repeats(t, span), answer)
    both = marks.withColumn("step", F.lit(1)).unionByName(repeats.withColumn("step", F.lit(2)))

    def cut(row: dict, answers: list[dict]) -> pa.Table:
        marks = [a for a in answers if a["step"] == 1]
        leads, rows, group, (heads, least, bucket) = _regions(row, marks, span, splitters)
        count = leads.high[heads] - leads.low[heads] + 1 if len(heads) else np.zeros(0, np.int64)
        place = np.zeros(len(heads), np.int64)
        bits = [np.zeros(0, bool)]
        offset = 0
        for a in (a for a in answers if a["step"] == 2):
            of = np.flatnonzero(bucket == a["bucket"])
            total = int(count[of].sum())
            place[of] = offset + np.cumsum(count[of]) - count[of]
            bits.append(np.unpackbits(np.frombuffer(a["data"], np.uint8), count=total).astype(bool))
            offset += total
        bit = np.concatenate(bits)
        each = leads.high[rows] - leads.low[rows] + 1
        within = spread(each)
        hit = bit[np.repeat(place[group], each) + within] | np.repeat(leads.id[rows] > least[group], each)
        start = (np.repeat(leads.low[rows], each) + within)[hit]
        n = len(leads.data) + 1
        gone = np.cumsum(np.bincount(start, minlength=n) - np.bincount(start + span, minlength=n), dtype=np.int32)[:-1] > 0
        if whole_chars and len(gone):
            lead = (leads.data & 0xC0) != 0x80
            gone = np.logical_or.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead, dtype=np.int32) - 1]
        return _cut_documents(leads, gone, dict(zip(carry, carried(row), strict=True)))

    return answer_chunks(chunks, both, cut, schema)


def _cut_documents(leads: _Leads, gone: np.ndarray, rest: dict[str, pa.ChunkedArray]) -> pa.Table:
    at, n = leads.at, len(leads.data)
    edge = np.zeros(n + 1, bool)  # a run also ends where its document does
    edge[at] = True
    first = np.flatnonzero(gone & (edge[:-1] | ~np.append(False, gone[:-1])))
    last = np.flatnonzero(gone & (edge[1:] | ~np.append(gone[1:], False)))
    doc = np.searchsorted(at, first, "right") - 1
    of = np.searchsorted(doc, np.arange(len(at)))
    spans = pa.StructArray.from_arrays([pa.array(first - at[doc]), pa.array(last + 1 - at[doc])], names=["start", "end"])
    kept_at = np.concatenate([[0], np.cumsum(~gone)])[at]
    kept = leads.data[~gone]
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(kept)])
    row = {"row": pa.StructArray.from_arrays([c.combine_chunks() for c in rest.values()], names=list(rest))} if rest else {}
    return pa.table(
        {
            "doc_id": pa.array(leads.ids, mask=~leads.known), "n_bytes": np.diff(at),
            "spans": pa.ListArray.from_arrays(pa.array(of, pa.int32()), spans), "kept": body.cast(pa.binary()), **row,
        }
    )
