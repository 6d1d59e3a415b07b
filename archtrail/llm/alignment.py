"""Alignment of two tokenizers' tokens over a corpus, by Arrow tables in tasks and Spark between them.

A text is encoded by a byte-level BPE (A, with a space before it) and by a piece model (B).
Byte offsets at which tokens of both end cut them into groups; each A token is linked
with each B token of its group.

In a task: token lists are flattened with their parent indices, token sizes are summed up
per document, an Acero hash join on (document, end) finds the common ends, a second one on
the group makes links, and ``Table.group_by`` reduces them per document and per *unit* (some
megabytes of text). A unit sends every pair of ids once with its count of documents; Spark
merges the counts, finds each A id's highest, and sends every unit the counts of its pairs.
Tokens are encoded once and stored in the shared folder, compressed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import bounded_batches, expand, no_rows, squeeze, written
from archtrail.llm.packed import release, slices
from archtrail.llm.pieces import SPACE_MARK, escape, pre_tokens
from archtrail.llm.word_cache import WordCache

#: Text of a unit and of its stored pieces, in bytes; a longer text is a unit of its own.
UNIT_BYTES, PIECE_BYTES = 16_000_000, 1_000_000
#: Pairs of a group that are written out at once; ids of a larger group are counted before. Links of those made at once.
SMALL_GROUP, LINKS_AT_ONCE = 64, 2_000_000
#: Bits of a pair's key below the number of its document in the piece.
KEY_BITS = 36
#: Words handed to a library call as one text.
JOINED_WORDS = 400
PIECE = "unit long, kind int, n_docs long, data binary"


# ---- the two tokenizers, by words


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """Ids of words and the bytes of every id; words are joined for the library and taken apart by sizes."""

    bytes: list[bytes]

    def prepare(self) -> None:
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.body = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.cache = WordCache(self.encode_words, np.dtype(np.int32))

    def encode_text(self, texts: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def joins(self, word: bytes) -> bool:
        """Whether words may stand after each other in one text without a token across them."""
        raise NotImplementedError

    def seen(self, word: bytes) -> int:
        """Bytes that the tokens of a word stand for."""
        return len(word)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        joined = np.array([self.joins(w) for w in words], bool)
        safe, alone = np.flatnonzero(joined), np.flatnonzero(~joined).tolist()
        seen = np.array([self.seen(w) for w in words], np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, how many ids each has, the ids
        groups = [safe[k : k + JOINED_WORDS] for k in range(0, len(safe), JOINED_WORDS)]
        for first in range(0, len(groups), 64):
            part = groups[first : first + 64]
            for group, ids in zip(part, self.encode_text([b"".join(words[g[0] : g[-1] + 1] if g[-1] - g[0] + 1 == len(g) else [words[k] for k in g]) for g in part]), strict=True):
                ids = np.array(ids, np.int32)
                ends, wanted = np.cumsum(self.size[ids]), np.cumsum(seen[group])
                cuts = np.searchsorted(ends, wanted) + 1
                if len(ids) and ends[-1] == wanted[-1] and np.array_equal(ends[cuts - 1], wanted):
                    parts.append((group, np.diff(cuts, prepend=0), ids))
                else:
                    alone += group.tolist()
        for first in range(0, len(alone), 512):
            part = alone[first : first + 512]
            found = self.encode_text([words[k] for k in part])
            parts.append((np.array(part), np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32)))
        sizes = np.zeros(len(words), np.int64)
        for of, size, _ in parts:
            sizes[of] = size
        starts = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for of, size, ids in parts:
            out[np.repeat(starts[of] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
        return out, sizes

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        each = self.size[ids]
        ends = np.cumsum(each)
        return self.body[np.repeat(self.at[ids] - (ends - each), each) + np.arange(int(each.sum()))]


class ByteTokens(Tokens):
    """A byte-level BPE file. Where its ids are the ranks of its merges, the faster of two libraries gives the same ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, "rb") as f:
            parts = json.load(f)
        names = {v: k for k, v in parts["model"]["vocab"].items()}
        added = {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
        byte = byte_level_bytes()
        self.bytes = [added[k] if k in added else bytes(byte[c] for c in names.get(k, "")) for k in range(max([*names, *added]) + 1)]
        self.encode_text = self._by_ranks(parts, added) or self._by_file(path)
        self.prepare()

    def _by_ranks(self, parts: dict, added: dict[int, bytes]):
        before, model = parts["pre_tokenizer"], parts["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not parts["normalizer"]
        plain &= not model.get("dropout") and not model.get("ignore_merges")
        if not plain or any(model["vocab"].get(m) != 256 + k for k, m in enumerate(merges)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.bytes[k]: k for k in range(256 + len(merges)) if k not in added}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t.decode()) for t in texts]

    def _by_file(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        return lambda texts: [e.ids for e in tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]

    def joins(self, word: bytes) -> bool:
        return len(word) > 1 and word[0] == 32 and 32 < word[1] < 127 and 32 < word[-1] < 127

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans between single spaces with no white space beside them, where the tokenizer always cuts, and the first span of every text."""
        n = len(data)
        padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)])
        before, after = padded[:-2], padded[2:]
        clear = lambda b: (b > 32) & (b < 127)
        lead = (after > 0xC2) & (after != 0xE1) & (after != 0xE2) & (after != 0xE3)  # no white space starts with these bytes
        begins = (data == 32) & clear(before) & (clear(after) | lead)
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, at)


class PieceTokens(Tokens):
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lone = [self.model.piece_to_id(SPACE_MARK.decode())]
        self.bytes = []
        for k in range(self.model.get_piece_size()):
            name = self.model.id_to_piece(k)
            self.bytes.append(bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.encode().replace(SPACE_MARK, b" "))
        self.prepare()

    def encode_text(self, texts: list[bytes]) -> list[list[int]]:
        # the library puts the first space before a text by itself, but not before an empty one
        found = self.model.encode([t[len(SPACE_MARK) :].replace(SPACE_MARK, b" ").decode() for t in texts], num_threads=1)
        return [self.lone if t == SPACE_MARK else ids for t, ids in zip(texts, found, strict=True)]

    def joins(self, word: bytes) -> bool:
        return not word.endswith(SPACE_MARK)

    def seen(self, word: bytes) -> int:
        return len(word) - 2 * word.count(SPACE_MARK)

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return pre_tokens(data, at)


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    """Read once in a worker process."""
    return ByteTokens(path_a), PieceTokens(path_b)


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    with open(path_a, "rb") as f:
        model = json.load(f)
    import sentencepiece

    size_a = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) + 1
    return size_a, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _lists(tokens: Tokens, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and the offsets of each text's."""
    starts, stops, of = tokens.words(data, at)
    where, size = tokens.cache.look_up(data, starts, stops)
    return tokens.cache.gather(where, size), np.concatenate([[0], np.cumsum(size)])[of]


def _same_text(tokens: Tokens, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the joined bytes of each text's ids are its bytes."""
    ends = np.concatenate([[0], np.cumsum(tokens.size[ids])])[offsets]
    same = np.diff(ends) == np.diff(at)
    if same.all():
        differ = np.concatenate([[0], np.cumsum(tokens.decoded(ids) != data)])
        return differ[at[1:]] == differ[at[:-1]]
    for k in np.flatnonzero(same):
        same[k] = np.array_equal(tokens.decoded(ids[offsets[k] : offsets[k + 1]]), data[at[k] : at[k + 1]])
    return same


# ---- groups and links of one piece


def _ends(ids: np.ndarray, offsets: np.ndarray, size: pa.Array) -> pa.Table:
    """Per token its document and the byte at which it ends there, as one key, and its number."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))
    parent = pc.list_parent_indices(lists)
    running = pc.cumulative_sum(pc.take(size, pc.list_flatten(lists)))
    before = np.concatenate([[0], running.to_numpy()])[offsets[:-1]]
    end = pc.subtract(running, pc.take(pa.array(before), parent))
    return pa.table({"document_end": pc.add(pc.shift_left(parent, 32), end), "token": np.arange(len(ids))})


def group_sizes(a: np.ndarray, a_at: np.ndarray, size_a: np.ndarray, b: np.ndarray, b_at: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of A and B tokens in each group, over all documents in order."""
    left, right = _ends(a, a_at, pa.array(size_a)), _ends(b, b_at, pa.array(size_b))
    both = left.join(right, "document_end", join_type="inner", right_suffix="_b", use_threads=False)
    last_a, last_b = np.sort(both["token"].to_numpy()), np.sort(both["token_b"].to_numpy())
    return np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)


def _counted(group: np.ndarray, ids: np.ndarray, name: str) -> pa.Table:
    return pa.TableGroupBy(pa.table({"group": group, name: ids}), ["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])


def _summed(key: np.ndarray | pa.ChunkedArray, n: np.ndarray | pa.ChunkedArray) -> pa.Table:
    return pa.TableGroupBy(pa.table({"key": key, "n": n}), ["key"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])


def links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, doc_of_group: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, key (a * size_b + b) and occurrence pairs of all links, by document and key.

    Pairs of small groups are written out; in a larger one ids are counted first and
    joined by group, ``LINKS_AT_ONCE`` at a time.
    """
    wide = in_a * in_b > SMALL_GROUP
    out = []
    for few, rows_a, rows_b in ((True, np.repeat(~wide, in_a), np.repeat(~wide, in_b)), (False, np.repeat(wide, in_a), np.repeat(wide, in_b))):
        of = np.flatnonzero(wide != few)
        if not len(of):
            continue
        own_a, own_b, n_a, n_b = a[rows_a], b[rows_b], in_a[of], in_b[of]
        if few:
            each = np.repeat(n_b, n_a)  # every A token meets the B tokens of its group
            right = np.repeat(np.repeat(np.cumsum(n_b) - n_b, n_a) - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            doc = np.repeat(np.repeat(doc_of_group[of], n_a), each)
            key = np.repeat(own_a, each) * size_b + own_b[right]
            out.append(_summed((doc << KEY_BITS) | key, np.ones(len(key), np.int64)))
            continue
        left, right = _counted(np.repeat(of, n_a), own_a, "a"), _counted(np.repeat(of, n_b), own_b, "b")
        made = np.cumsum(np.bincount(right["group"].to_numpy(), minlength=len(in_a))[left["group"].to_numpy()])
        first = 0
        while first < left.num_rows:
            before = made[first - 1] if first else 0
            end = int(max(first + 1, np.searchsorted(made, before + LINKS_AT_ONCE, "right")))
            pairs = left.slice(first, end - first).join(right, "group", join_type="inner", use_threads=False)
            key = pairs["a"].to_numpy() * size_b + pairs["b"].to_numpy()
            out.append(_summed((doc_of_group[pairs["group"].to_numpy()] << KEY_BITS) | key, pc.multiply(pairs["n_a"], pairs["n_b"])))
            first = end
    if not out:
        return (np.zeros(0, np.int64),) * 3
    table = out[0] if len(out) == 1 else _summed(pa.concat_tables(out)["key"], pa.concat_tables(out)["n"])
    both, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(both)
    return both[order] >> KEY_BITS, both[order] & ((1 << KEY_BITS) - 1), n[order]


class Piece:
    """Stored tokens of some documents."""

    def __init__(self, data: bytes) -> None:
        self.ids, known, self.a_at, self.b_at, self.g_at, a, b, in_a, in_b = expand(data)
        self.known = known.astype(bool)
        self.a, self.b, self.in_a, self.in_b = (x.astype(np.int64) for x in (a, b, in_a, in_b))

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return links(self.a, self.b, self.in_a, self.in_b, np.repeat(np.arange(len(self.ids)), np.diff(self.g_at)), size_b)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8 if values.max(initial=0) < 1 << 8 else np.uint16 if values.max(initial=0) < 1 << 16 else np.uint32)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, align and store: rows of kind 0 (a ``Piece``) and 1 (per unit its pairs and their counts of documents).

    A text that is null or empty, or whose tokens of A or B do not spell a space and the text,
    has no tokens. Ids may be null or repeat, each row is a document. Other columns are not
    read; an empty table gives no rows. The result is written, for readers below.
    """
    bounded_batches(docs.sparkSession)
    size_a, size_b = vocabulary_sizes(path_a, path_b)
    if size_a * size_b >= 1 << KEY_BITS:
        raise ValueError("pairs of ids of these vocabularies do not fit in KEY_BITS")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_tokens, second_tokens = _tokenizers(path_a, path_b)
        unit, held, counted = TaskContext.get().partitionId() << 32, 0, []

        def row(kind: int, n: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([kind], pa.int32()), pa.array([n]), pa.array([data], pa.binary())], names=["unit", "kind", "n_docs", "data"])

        def merged() -> pa.Table:
            every = pa.concat_tables(counted)
            return _summed(every["key"], every["n"])

        def close() -> pa.RecordBatch:
            pairs = merged().sort_by("key")
            return row(1, 0, squeeze(pairs["key"].to_numpy(), _narrow(pairs["n"].to_numpy())))

        for batch in batches:
            for first, end, data, at in slices(batch.column(1), PIECE_BYTES):
                if held and held + len(data) > UNIT_BYTES:
                    yield close()
                    unit, held, counted = unit + 1, 0, []
                ids = batch.column(0)[first:end].cast(pa.int64())
                size = np.diff(at)
                spaced = np.insert(data, at[:-1][size > 0], 32)
                spaced_at = at + np.concatenate([[0], np.cumsum(size > 0)])
                a, a_at = _lists(first_tokens, spaced, spaced_at)
                b, b_at = _lists(second_tokens, *escape(data, at))
                good = _same_text(first_tokens, a, a_at, spaced, spaced_at) & _same_text(second_tokens, b, b_at, spaced, spaced_at)
                if not good.all():
                    a, b = a[np.repeat(good, np.diff(a_at))], b[np.repeat(good, np.diff(b_at))]
                    a_at, b_at = (np.concatenate([[0], np.cumsum(np.diff(x) * good)]) for x in (a_at, b_at))
                in_a, in_b = group_sizes(a, a_at, first_tokens.size, b, b_at, second_tokens.size)
                g_at = np.searchsorted(np.concatenate([[0], np.cumsum(in_a)]), a_at)
                stored = squeeze(
                    np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()).astype(np.uint8), a_at, b_at, g_at,
                    *(_narrow(x) for x in (a, b, in_a, in_b)), level=3)
                found = links(a.astype(np.int64), b.astype(np.int64), in_a, in_b, np.repeat(np.arange(end - first), np.diff(g_at)), size_b)[1]
                counted.append(_summed(found, np.ones(len(found), np.int64)))
                if len(counted) > 8:
                    counted = [merged()]
                held += len(data) + 16 * (end - first)
                yield row(0, end - first, stored)
                del found, a, b
                release()
        if counted:
            yield close()

    return written(docs.select(id_col, text_col).mapInArrow(run, PIECE))


# ---- over the corpus


def unit_pairs(aligned: DataFrame) -> DataFrame:
    """``unit, key, n``: every pair of ids of every unit, with the unit's documents that have it linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = expand(data)
                for k in range(0, len(keys), 200_000):
                    part = keys[k : k + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), unit)), pa.array(part), pa.array(n[k : k + 200_000].astype(np.int64))], names=["unit", "key", "n"])

    return aligned.where("kind = 1").select("unit", "data").mapInArrow(run, "unit long, key long, n long")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``a, b, key, n`` (documents of the corpus that hold the pair linked) and ``best`` (n is the highest of its A id)."""
    counts = unit_pairs(aligned).groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.expr(f"int(key div {size_b})")))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    return counts.join(highest, "a").select("a", F.expr(f"int(key % {size_b})").alias("b"), "key", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned_tokens(aligned: DataFrame) -> DataFrame:
    """Per document ``doc_id``, the ids of both tokenizers and how many of each every group has."""
    schema = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                p = Piece(data)
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for at, x in ((p.a_at, p.a), (p.b_at, p.b), (p.g_at, p.in_a), (p.g_at, p.in_b))]
                yield pa.RecordBatch.from_arrays([pa.array(p.ids, mask=~p.known), *lists], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return aligned.where("kind = 0").select("data").mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _decimals(n: int) -> pa.Array:
    """``id`` and what follows it (``,`` ``|`` ``;`` or nothing) as text, at 4 * id + k."""
    return pa.array([f"{k}{sign}" for k in range(n) for sign in (",", "|", ";", "")], pa.large_string())


def group_digests(p: Piece) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` per document; without tokens the empty string."""
    n, groups = len(p.a) + len(p.b), np.arange(len(p.in_a))
    last_a, last_b = np.cumsum(p.in_a) - 1, np.cumsum(p.in_b) - 1
    sign_a, sign_b = np.zeros(len(p.a), np.int64), np.zeros(len(p.b), np.int64)
    sign_a[last_a], sign_b[last_b] = 1, 2
    full = np.diff(p.g_at) > 0
    sign_b[p.b_at[1:][full] - 1] = 3
    token = np.empty(n, np.int64)
    token[np.arange(len(p.a)) + np.repeat(last_b - p.in_b + 1, p.in_a)] = 4 * p.a + sign_a
    token[np.arange(len(p.b)) + np.repeat(last_a + 1, p.in_b)] = 4 * p.b + sign_b
    del groups
    text = _decimals(int(max(p.a.max(initial=0), p.b.max(initial=0)) | 0xFFFF) + 1).take(pa.array(token))
    _, at, body = text.buffers()
    at = np.frombuffer(at, np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    cuts = at[p.a_at + p.b_at].tolist()
    view = memoryview(body) if body is not None else b""
    return [hashlib.sha256(view[s:e]).hexdigest() if e > s else "" for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, how many links have their A id's highest count, the sum of counts, and the digest of the groups."""
    _, size_b = vocabulary_sizes(path_a, path_b)
    aligned = align(docs, path_a, path_b, id_col, text_col)
    pairs = unit_pairs(aligned).select("unit", "key")
    answers = pairs.join(pair_counts(aligned, size_b).select("key", "n", "best"), "key").select("unit", "key", "n", "best")
    empty = no_rows(REPORT)

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("key")
        keys, n, best = (right[c].to_numpy() for c in ("key", "n", "best"))
        del right
        out = [empty]
        for data in left["data"]:
            p = Piece(data.as_py())
            doc, key, times = p.links(size_b)
            place = np.searchsorted(keys, key)
            bounds = np.searchsorted(doc, np.arange(len(p.ids) + 1))
            total = [np.diff(np.concatenate([[0], np.cumsum(value)])[bounds]) for value in (times, times * best[place], times * n[place])]
            columns = [pa.array(p.ids, mask=~p.known), *(pa.array(np.diff(x)) for x in (p.a_at, p.b_at, p.g_at)), *(pa.array(t) for t in total), pa.array(group_digests(p), pa.string())]
            out.append(pa.table(columns, schema=empty.schema))
            del doc, key, times, p
            release()
        return pa.concat_tables(out)

    pieces = aligned.where("kind = 0").select("unit", "data")
    return pieces.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(report, REPORT)
