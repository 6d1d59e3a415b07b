"""Size-aware heavy-light similarity join on word n-grams, down to groups of documents.

Two sets link when ``100 * intersection >= percent * union``.

* Documents with equal sets are one node (a copy costs nothing from here on).
* *Light* sets, up to a size chosen by cost, list all their subsets of the one size that
  a partner of each possible size must share: two sets that list the same subset link.
* *Heavy* sets scan inverted lists. A set is listed under its rarest grams only: as many
  as ensure that two linked sets meet in one list. Rarity is read from hashed counts of
  all grams (they only order, so what meets by chance in a cell costs time, not results).
* Short lists give candidate pairs, long ones are cut into blocks: whole sets of a block
  are indexed and those of every other block scan that index, so no pair of a long list
  becomes a row. A list whose grams are frequent everywhere is dealt out in such
  blocks from the start and never collected.
* Pairs are first compared by sketches, how many grams fall into each of about n / 16
  classes: the sum of the smaller counts is at least the intersection, so what it
  rules out is no link. The rest is checked on whole sets; a block passes on only
  links that join what was apart in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archtrail.llm.chunks import bounded_batches, dealt_parts, expand, squeeze, written
from archtrail.llm.components import components
from archtrail.llm.packed import LOWER, byte_hash, mix, release, shingle_hash, slices, spread, words

#: Cells of the hashed gram counts (a byte each when handed out) and of the node filter (a bit each).
CELLS, FILTER_BITS = 1 << 21, 1 << 23
#: Lists up to this length give pairs; longer ones are worked on in blocks of so many sets or grams.
SHORT_LIST, BLOCK_SETS, BLOCK_GRAMS = 64, 1024, 400_000
#: Pairs of short lists are looked at so many at a time.
PAIRS_AT_ONCE = 250_000
#: Lists of grams counted at least so often are dealt out in blocks from the start.
HOT_COUNT = 50_000
#: Light sets have at most this many grams, whatever the cost model says (subsets grow fast).
LIGHT_AT_MOST = 24


def overlap_needed(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Least intersection of linked sets of ``n`` and ``m`` grams: ceil(percent (n + m) / (100 + percent))."""
    return -(-(percent * (np.asarray(n) + m)) // (100 + percent))


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.floor(8 * np.log2(1 + counts.astype(np.float64)))).astype(np.uint8)


class GramSets:
    """Gram sets of the texts of one slice: ``n`` per text and the sorted distinct hashes of all."""

    def __init__(self, data: np.ndarray, at: np.ndarray, size: int) -> None:
        data = LOWER[data]
        starts, stops, first = words(data, at)
        hashed = byte_hash(data, starts, stops)
        count = np.diff(first)
        grams = shingle_hash(hashed, size)
        full = np.maximum(count - size + 1, 0)
        place = np.repeat(first[:-1], full) + spread(full)
        n = full.copy()
        self.value = np.empty(int(full.sum() + ((count > 0) & (count < size)).sum()), np.uint64)
        n[(count > 0) & (count < size)] = 1
        offset = np.concatenate([[0], np.cumsum(n)])
        long_ = np.repeat(full > 0, n)
        self.value[long_] = grams[place]
        for k in np.flatnonzero((count > 0) & (count < size)):  # a text of fewer words is one gram
            self.value[offset[k]] = shingle_hash(hashed[first[k] : first[k + 1]], int(count[k]))[0]
        for k in np.flatnonzero(n > 1):
            self.value[offset[k] : offset[k + 1]].sort()
        fresh = np.ones(len(self.value), bool)
        fresh[1:] = self.value[1:] != self.value[:-1]
        fresh[offset[:-1][n > 0]] = True
        self.text = np.repeat(np.arange(len(n)), n)[fresh]
        self.value = self.value[fresh]
        self.n = np.bincount(self.text, minlength=len(n))
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.value ^ np.uint64(0x5851F42D4C957F2D)))])
        self.node = mix(total[self.at[1:]] - total[self.at[:-1]] + self.n.astype(np.uint64)).view(np.int64)
        _, self.once = np.unique(self.node, return_index=True)  # one text of each set
        self.once = self.once[self.n[self.once] > 0]


def _longs(**columns: np.ndarray | list | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _facts(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """A row per document (``doc_id``, ``n``, ``node``) and the gram counts in blocks of cells."""
    per_block = CELLS // 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for first, end, data, at in slices(batch.column(1)):
                sets = GramSets(data, at, size)
                cells += np.bincount((sets.value & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                none = pa.nulls(end - first, pa.int32())
                yield _longs(doc_id=batch.column(0)[first:end].cast(pa.int64()), n=sets.n, node=sets.node, block=none, data=pa.nulls(end - first, pa.binary()))
        if cells.any():
            blank = pa.nulls(32, pa.int64())
            data = [squeeze(cells[k * per_block : (k + 1) * per_block]) for k in range(32)]
            yield _longs(doc_id=blank, n=blank, node=blank, block=pa.array(range(32), pa.int32()), data=data)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n long, node long, block int, data binary")


def _cell_levels(facts: DataFrame) -> tuple[np.ndarray, float]:
    """The level of every cell, and how long the list of a gram is on average."""

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros(CELLS // 32)
        for x in table["data"]:
            counts += expand(x.as_py())[0]
        return pa.table({"block": table["block"][:1], "data": [_levels(counts).tobytes()], "all": [float(counts.sum())], "squares": [float((counts**2).sum())]})

    got = facts.where("block is not null").select("block", "data").groupBy("block").applyInArrow(total, "block int, data binary, all double, squares double").collect()
    levels = np.zeros(CELLS, np.uint8)
    for row in got:
        levels[row["block"] * (CELLS // 32) : (row["block"] + 1) * (CELLS // 32)] = np.frombuffer(bytes(row["data"]), np.uint8)
    grams, squares = sum(r["all"] for r in got), sum(r["squares"] for r in got)
    return levels, max(1.0, (squares - grams**2 / CELLS) / grams) if grams else 1.0


def subsets_listed(n: int, percent: int) -> list[tuple[int, int, int]]:
    """For a set of ``n``: smaller size, larger size and subset size for every size of partner."""
    out = []
    for m in range(-(-percent * n // 100), 100 * n // percent + 1):
        c = int(overlap_needed(n, m, percent))
        if c <= min(n, m) and not (c == n == m):  # equal sets are one node already
            out.append((min(n, m), max(n, m), c))
    return out


def light_limit(percent: int, list_length: float) -> int:
    """Largest size up to which listing subsets costs no more than scanning inverted lists."""
    best = 0
    for n in range(1, LIGHT_AT_MOST + 1):
        listed = sum(comb(n, c) for _, _, c in subsets_listed(n, percent))
        if listed > (n - -(-percent * n // 100) + 1) * list_length + 1:
            break
        best = n
    return best


def _subset_keys(value: np.ndarray, percent: int) -> tuple[list[int], list[bool]]:
    from itertools import combinations

    parts = [int(x) for x in mix(value)]
    whole, mask = sum(parts), (1 << 64) - 1
    keys, equal = [], []
    for small, large, c in subsets_listed(len(parts), percent):
        tag = (small * 1000003 + large) * 1000003 + c
        for left_out in combinations(parts, len(parts) - c):
            keys.append((whole - sum(left_out) ^ tag * 0x9E3779B97F4A7C15) & mask)
            equal.append(small == large)
    return keys, equal


#: What a bucket hands on: ``link`` (a, b), ``pair`` (a, b to check), ``list`` (job a, node b, its block and their number).
STEP = "kind string, a long, b long, block int, blocks int"


def _step(kind: str, a: np.ndarray, b: np.ndarray, block: np.ndarray | int = 0, blocks: np.ndarray | int = 1) -> pa.RecordBatch:
    fill = lambda v: pa.array(np.broadcast_to(np.asarray(v, np.int32), len(a)))
    return _longs(kind=pa.array([kind] * len(a), pa.string()), a=a.astype(np.int64), b=b.astype(np.int64), block=fill(block), blocks=fill(blocks))


def _light_links(key: np.ndarray, node: np.ndarray, n: np.ndarray, equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets that list the same subset, tied to one of them (where the sizes the subset is for both occur)."""
    order = np.lexsort((node, key))
    key, node, n, equal = key[order], node[order], n[order], equal[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if not len(heads):
        return node, node
    group = np.cumsum(np.isin(np.arange(len(key)), heads)) - 1
    good = equal[heads] | (np.minimum.reduceat(n, heads) != np.maximum.reduceat(n, heads))
    a, b = node[heads][group], node
    keep = good[group] & (a != b)
    return a[keep], b[keep]


def _scan_lists(token: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, light: int, percent: int) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((node, n, token))
    token, node, n, place = token[order], node[order], n[order].astype(np.int64), place[order].astype(np.int64)
    fresh = np.ones(len(token), bool)  # the same set from several senders
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, n, place = token[fresh], node[fresh], n[fresh], place[fresh]
    heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    length = np.diff(np.append(heads, len(token)))
    pairs = []
    for size in np.unique(length[(length > 1) & (length <= SHORT_LIST)]):
        of = heads[length == size]
        i, j = np.triu_indices(int(size), 1)
        for part in np.array_split(of, max(1, len(of) * len(i) // PAIRS_AT_ONCE)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            most = 1 + np.minimum(n[x] - place[x], n[y] - place[y]) - 1  # nothing is shared before the first common gram
            good = (n[y] > light) & (100 * n[x] >= percent * n[y]) & (most >= overlap_needed(n[x], n[y], percent))
            pairs.append(np.stack([np.minimum(node[x], node[y])[good], np.maximum(node[x], node[y])[good]]))
    if pairs:
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield _step("pair", both[0], both[1])
    seen = set()
    for head, size in zip(heads[length > SHORT_LIST], length[length > SHORT_LIST], strict=True):
        members, sizes = node[head : head + size], n[head : head + size]
        job = int(np.sum(mix(members.view(np.uint64)), dtype=np.uint64).view(np.int64))
        if job in seen or sizes[-1] <= light:
            continue
        seen.add(job)
        block = np.maximum(np.arange(size) // BLOCK_SETS, np.cumsum(sizes) // BLOCK_GRAMS)
        block = np.unique(block, return_inverse=True)[1]
        yield _step("list", np.full(size, job), members, block, int(block[-1]) + 1)


def _candidates(docs: DataFrame, text_col: str, size: int, percent: int, levels: np.ndarray, light: int) -> DataFrame:
    """Inverted lists of all documents, scanned bucket by bucket."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(levels)  # CELLS bytes, whatever the input
    n_buckets = 3 * dealt_parts(spark)
    hot_level = int(_levels(np.array([HOT_COUNT]))[0])
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=["kind", "a", "b", "block", "blocks"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                sets = GramSets(data, at, size)
                keys, equal, owners = [], [], []
                for k in sets.once[sets.n[sets.once] <= light]:
                    mine, same = _subset_keys(sets.value[sets.at[k] : sets.at[k + 1]], percent)
                    keys += mine
                    equal += same
                    owners += [k] * len(mine)
                owners = np.array(owners, np.int64)
                lightly = np.array(keys, np.uint64), sets.node[owners], sets.n[owners].astype(np.int32), np.array(equal, bool)
                ordered = (level_of[(sets.value & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (sets.value >> np.uint64(8))
                heavy = np.zeros(len(sets.n), bool)
                heavy[sets.once[100 * sets.n[sets.once] >= percent * (light + 1)]] = True
                prefix = np.where(heavy, sets.n + 1 + (-(percent * sets.n) // 100), 0)
                for k in np.flatnonzero(heavy & (sets.n > 1)):
                    ordered[sets.at[k] : sets.at[k + 1]].sort()
                which = np.repeat(sets.at[:-1], prefix) + spread(prefix)
                token, owner, place = ordered[which], np.repeat(np.arange(len(prefix)), prefix), spread(prefix).astype(np.int32)
                hot = (token >> np.uint64(56)) >= hot_level
                if hot.any():
                    count = 2.0 ** ((token[hot] >> np.uint64(56)).astype(np.float64) / 8)
                    blocks = np.ceil(count / BLOCK_SETS).astype(np.int64)
                    node = sets.node[owner[hot]]
                    block = (mix(node.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                    yield _blobs([-1], [squeeze(token[hot].view(np.int64), node, block, blocks)])
                    token, owner, place = token[~hot], owner[~hot], place[~hot]
                bucket, lit = mix(token) % np.uint64(n_buckets), mix(lightly[0]) % np.uint64(n_buckets)
                order, light_order = np.argsort(bucket, kind="stable"), np.argsort(lit, kind="stable")
                cuts, light_cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1)), np.searchsorted(lit[light_order], np.arange(n_buckets + 1))
                columns = [x[order] for x in (token, sets.node[owner], sets.n[owner].astype(np.int32), place)]
                light_columns = [x[light_order] for x in lightly]
                out = [
                    (b, squeeze(*(x[cuts[b] : cuts[b + 1]] for x in columns), *(x[light_cuts[b] : light_cuts[b + 1]] for x in light_columns)))
                    for b in range(n_buckets) if cuts[b] < cuts[b + 1] or light_cuts[b] < light_cuts[b + 1]
                ]
                if out:
                    yield _blobs([b for b, _ in out], [x for _, x in out])

    def scan(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blobs = [expand(x) for x in table["data"].to_pylist()]
        token, node, n, place, *lightly = (np.concatenate(x) for x in zip(*blobs, strict=True))
        yield _step("link", *_light_links(*lightly))
        if len(token):
            yield from _scan_lists(token, node, n, place, light, percent)
        del blobs, token, node, n, place, lightly
        release()

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("data").to_pylist():
                yield _step("list", *expand(row))

    sent = docs.select(text_col).mapInArrow(send, "bucket int, data binary")
    if not (levels >= hot_level).any():
        return written(sent.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches([empty, *scan(t)]), STEP))
    sent = written(sent)
    scanned = sent.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches([empty, *scan(t)]), STEP)
    return written(scanned.unionByName(sent.where("bucket < 0").mapInArrow(pass_on, STEP)))


def _blobs(bucket: list[int], data: list[bytes]) -> pa.RecordBatch:
    return _longs(bucket=pa.array(bucket, pa.int32()), data=pa.array(data, pa.binary()))


def sketch(grams: np.ndarray) -> bytes:
    """How many grams fall into each class, by their low bits."""
    classes = 1 << min(12, max(4, (len(grams) // 16).bit_length()))
    return np.minimum(np.bincount((grams & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 65535).astype(np.uint16).tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """No intersection is larger than this (counts that reach 65,535 rule nothing out)."""
    x, y = np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.uint16).astype(np.int64)
    if max(x.max(), y.max()) == 65535:
        return 1 << 40
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            size = [(int(np.frombuffer(v, np.uint16).sum(dtype=np.int64)), int(np.frombuffer(w, np.uint16).sum(dtype=np.int64))) for v, w in zip(x, y, strict=True)]
            keep = [most_shared(v, w) >= overlap_needed(n, m, percent) for v, w, (n, m) in zip(x, y, size, strict=True)]
            yield _longs(a=batch.column(0), b=batch.column(1)).filter(pa.array(keep, pa.bool_()))
            release()

    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets_of(nodes: DataFrame, docs: DataFrame, text_col: str, size: int, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``node`` and its whole set, or its sketch, for the distinct ``nodes``; others are left out early by a bit filter."""
    spot = F.pmod("node", F.lit(FILTER_BITS)) + 1
    got = nodes.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS, bool)
    for row in got:
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        bits[(row["k"] - 1) * len(part) : row["k"] * len(part)] = part[: FILTER_BITS - (row["k"] - 1) * len(part)]
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                sets = GramSets(data, at, size)
                keep = sets.once[asked[sets.node[sets.once] % FILTER_BITS]]
                if len(keep):
                    yield _longs(node=sets.node[keep], grams=pa.array([form(sets.value[sets.at[k] : sets.at[k + 1]]) for k in keep], pa.binary()))

    found = docs.select(text_col).mapInArrow(run, "node long, grams binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("grams").alias("grams"))


class _Block:
    """Sets of one job that are held, indexed by gram, and who is joined with whom."""

    def __init__(self, percent: int) -> None:
        self.percent, self.nodes, self.sets, self.up = percent, [], [], {}

    def hold(self, node: int, grams: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(grams)
        self.index = None

    def top(self, node: int) -> int:
        while (up := self.up.get(node, node)) != node:
            self.up[node] = self.up.get(up, up)
            node = up
        return node

    def scan(self, node: int, grams: np.ndarray) -> list[tuple[int, int]]:
        if not self.sets:
            return []
        if self.index is None:
            n = np.array([len(s) for s in self.sets])
            value, owner = np.concatenate(self.sets), np.repeat(np.arange(len(n)), n)
            order = np.argsort(value, kind="stable")
            self.index = value[order], owner[order], n
        value, owner, n = self.index
        left, right = np.searchsorted(value, grams, "left"), np.searchsorted(value, grams, "right")
        count = right - left
        shared = np.bincount(owner[np.repeat(left, count) + spread(count)], minlength=len(n))
        out = []
        for k in np.flatnonzero(100 * shared >= self.percent * (n + len(grams) - shared)):
            a, b = self.top(self.nodes[k]), self.top(node)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((self.nodes[k], node))
        return out


def _check(rows: DataFrame, percent: int) -> DataFrame:
    """Links among candidates: ``rows`` have ``job``, ``side`` (0 held, 1 scans), ``node``, ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, block = None, None
        for batch in batches:
            links = []
            for this, side, node, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != job:
                    job, block = this, _Block(percent)
                grams = np.frombuffer(grams, np.uint64)
                if side == 0:
                    block.hold(node, grams)
                else:
                    links += block.scan(node, grams)
            if links:
                yield _longs(a=pa.array([x for x, _ in links], pa.int64()), b=pa.array([y for _, y in links], pa.int64()))
            release()

    parts = dealt_parts(rows.sparkSession)
    return rows.select("job", "side", "node", "grams").repartition(parts, "job").sortWithinPartitions("job", "side").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that are connected by similar sets of ``size``-word grams.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer than ``size``
    words is one gram of them all; one without words (or null) has no gram and no link.
    Returns ``doc_id``, ``n_grams`` and ``group_id``, the smallest id of the group (the own
    id for a document alone), one row per input row. Rows with equal ids count as linked
    only by their texts. A row with a null id takes part, but its id is never a group's
    (a group of such rows alone has a null ``group_id``). Sets are told apart by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    facts = written(_facts(docs, id_col, text_col, size))
    members = facts.where("block is null").select("doc_id", "n", "node")
    levels, list_length = _cell_levels(facts)
    light = light_limit(percent, list_length)
    steps = _candidates(docs, text_col, size, percent, levels, light)
    pairs = written(steps.where("kind = 'pair'").select("a", "b").distinct())
    lists = written(steps.where("kind = 'list'").select("a", "b", "block", "blocks").distinct())
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node"))
    sketches = written(_sets_of(written(ends(pairs).distinct()), docs, text_col, size, sketch))
    pairs = written(_possible(pairs, sketches, percent))
    sets = written(_sets_of(written(ends(pairs).unionByName(lists.select(F.col("b").alias("node"))).distinct()), docs, text_col, size, np.ndarray.tobytes))
    job = F.struct(F.lit(0).alias("kind"), F.col("a").alias("a"), F.pmod(F.xxhash64("b"), F.lit(4)).cast("int").alias("i"), F.lit(0).alias("j"))
    held = pairs.select(job.alias("job"), F.lit(0).alias("side"), F.col("a").alias("node")).distinct()
    scans = pairs.select(job.alias("job"), F.lit(1).alias("side"), F.col("b").alias("node"))
    tile = lambda i, j: F.struct(F.lit(1).alias("kind"), F.col("a").alias("a"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    other = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    first = other.where("k >= block").select(tile(F.col("block"), F.col("k")).alias("job"), F.lit(0).alias("side"), F.col("b").alias("node"))
    second = other.where("k <= block").select(tile(F.col("k"), F.col("block")).alias("job"), F.lit(1).alias("side"), F.col("b").alias("node"))
    jobs = held.unionByName(scans).unionByName(first).unionByName(second).withColumn("job", F.xxhash64("job"))
    links = _check(jobs.join(sets, "node"), percent)
    roots = components(steps.where("kind = 'link'").select("a", "b").unionByName(links))
    nodes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("group_id"))
    named = nodes.join(least, "root").select("node", "group_id")
    out = members.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_grams"), F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"))
