"""Fixpoints inside blocks of links, so that iterative graph jobs need few rounds.

A vertex-at-a-time job needs one shuffle per hop. Here each task first runs its
own links to a fixpoint and only then exchanges what crossed: the number of
rounds becomes the number of block borders on a path instead of its length.
Any split of the links into blocks is correct, so a block is simply as many rows
as fit comfortably in a task; a hot node is spread over many blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_ROWS = 1_000_000
BLOCK_BYTES = 64 * 1024 * 1024  # as Arrow holds them; rows with long keys fill a block earlier
BATCH_ROWS = 100_000


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup the Arrow batches of a partition into blocks of bounded size."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
            full, held, rows, size = held, [], 0, 0
            yield pa.Table.from_batches(full)
    if rows:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the place of each row's value among them; no text becomes a Python object."""
    encoded = pa.concat_arrays(column.chunks).dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy()


def _ends(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Node names and the two ends of each link as positions among them."""
    names, codes = _codes(pa.chunked_array([*block["source"].chunks, *block["target"].chunks]))
    return names, codes[: block.num_rows], codes[block.num_rows :]


def _batches(**columns: pa.Array) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=BATCH_ROWS)


def spread_highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target, value of the source) → (node, value): the highest value
    that reaches a node along links of the block."""
    for block in in_blocks(batches):
        names, source, target = _ends(block)
        labels, rank = _codes(block["value"])
        order = pc.sort_indices(labels).to_numpy()
        place = np.empty(len(labels), dtype=np.int64)
        place[order] = np.arange(len(labels))
        best = np.full(len(names), -1, dtype=np.int64)
        np.maximum.at(best, source, place[rank])
        start = best.copy()
        while True:
            before = best.copy()
            np.maximum.at(best, target, best[source])
            if np.array_equal(before, best):
                break
        gained = np.flatnonzero(best > start)
        yield from _batches(node=names.take(pa.array(gained)), value=labels.take(pa.array(order[best[gained]])))


def _spread_least(block: pa.Table, weight: np.ndarray | int) -> Iterator[pa.RecordBatch]:
    unreached = np.iinfo(np.int64).max // 2
    names, source, target = _ends(block)
    value = block["value"].to_numpy()
    best = np.full(len(names), unreached, dtype=np.int64)
    np.minimum.at(best, source, np.where(value < 0, unreached, value))
    start = best.copy()
    while True:
        before = best.copy()
        np.minimum.at(best, target, best[source] + weight)
        if np.array_equal(before, best):
            break
    gained = np.flatnonzero((best < start) & (best < unreached))
    yield from _batches(node=names.take(pa.array(gained)), value=pa.array(best[gained]))


def spread_distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target, value of the source) → (node, value): fewest links from a
    start at 0. A negative value marks a source not reached yet."""
    for block in in_blocks(batches):
        yield from _spread_least(block, 1)


def spread_weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for links of a given length (``weight``)."""
    for block in in_blocks(batches):
        yield from _spread_least(block, block["weight"].to_numpy())


def _peel(near: np.ndarray, far: np.ndarray, degree: np.ndarray, keep: np.ndarray) -> None:
    """Clear ``keep`` for links whose near end has no link left on its far side,
    and for those that thereby lose their last one. ``degree`` holds the global
    count at the near end of a link."""
    size = int(max(near.max(), far.max())) + 1
    left = np.full(size, np.iinfo(np.int64).max, dtype=np.int64)
    left[near] = degree
    while True:
        gone = keep & (left[near] <= 0)
        if not gone.any():
            return
        keep &= ~gone
        np.subtract.at(left, far[gone], 1)


def peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop links that cannot lie on a cycle. Input: source, target, way_in (links
    into the source), way_out (links out of the target), counted globally."""
    for block in in_blocks(batches):
        _, source, target = _ends(block)
        keep = np.ones(block.num_rows, dtype=bool)
        _peel(source, target, block["way_in"].to_numpy(), keep)
        # Links just dropped still count at their target's other side; that only
        # delays a drop to the next round, it never drops too much.
        _peel(target, source, block["way_out"].to_numpy(), keep)
        kept = block.select(["source", "target"]).filter(pa.array(keep))
        yield from kept.to_batches(max_chunksize=BATCH_ROWS)


def extend_key(key: list[str], node: str) -> list[str]:
    """Key of ``node`` as seen through a dependency with ``key``: what is below
    the node at the end of the chain goes, the node itself is appended."""
    end = len(key)
    while end and key[end - 1] < node:
        end -= 1
    return [*key[:end], node]


def spread_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target, value = key of the source) → (node, value): largest key a
    target gets along links of the block."""
    for block in in_blocks(batches):
        out: dict[str, list[str]] = {}
        best: dict[str, list[str]] = {}
        for batch in block.to_batches(max_chunksize=10_000):
            for source, target, key in zip(*(batch[name].to_pylist() for name in ("source", "target", "value"))):
                out.setdefault(source, []).append(target)
                best.setdefault(source, key)
        gained: set[str] = set()
        waiting = list(out)
        while waiting:
            touched: set[str] = set()
            for source in waiting:
                for target in out[source]:
                    key = extend_key(best[source], target)
                    if target not in best or key > best[target]:
                        best[target] = key
                        gained.add(target)
                        touched.add(target)
            waiting = [node for node in touched if node in out]
        nodes = list(gained)
        for at in range(0, len(nodes), 10_000):
            some = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_pydict(
                {"node": pa.array(some, pa.string()), "value": pa.array([best[node] for node in some], pa.list_(pa.string()))}
            )


def _settled(start: np.ndarray, degree: np.ndarray, mass: np.ndarray, near: np.ndarray, far: np.ndarray, weight: np.ndarray, total: float, least: float) -> np.ndarray:
    """Community of each node after all went, one after another, where they gain most until none
    gains more than ``least``; a node that went has its neighbours looked at again.

    A link's far end beyond the nodes is what stays in a community (its place among ``mass``)."""
    count = len(degree)
    order = np.lexsort((far, near))
    first = np.searchsorted(near[order], np.arange(count + 1)).tolist()
    far, weight = far[order].tolist(), weight[order].tolist()
    home = [*start.tolist(), *range(len(mass))]
    degree, mass = degree.tolist(), mass.tolist()
    moving = True
    while moving:  # masses change for all, so all are looked at until none moves
        moving, waiting, queued = False, deque(range(count)), [True] * len(home)
        while waiting:
            node = waiting.popleft()
            queued[node] = False
            here, own_degree = home[node], degree[node]
            shared = {here: 0.0}
            for at in range(first[node], first[node + 1]):
                there = home[far[at]]
                shared[there] = shared.get(there, 0.0) + weight[at]
            now = shared.pop(here) - own_degree * (mass[here] - own_degree) / total
            gains = [(round(part - own_degree * mass[there] / total, 9), -there) for there, part in shared.items()]
            best, to = max(gains, default=(now, 0))
            if best <= now + least:
                continue
            home[node], moving = -to, True
            mass[here] -= own_degree
            mass[-to] += own_degree
            for at in range(first[node], first[node + 1]):
                other = far[at]
                if not queued[other] and home[other] != -to:
                    queued[other] = True
                    waiting.append(other)
    return np.asarray(home[:count], dtype=np.int64)


def move_nodes(total: float, least: float) -> Callable[[pa.Table], pa.Table]:
    """Some nodes and whole communities → (node, to) of the nodes that moved between these.

    Rows: a node with its community, the mass of that and its degree (``weight``; ``other`` is
    null), or a link of it to another node with the same of the other end. Whatever is no node
    of the block stays where it is."""

    def moved(block: pa.Table) -> pa.Table:
        labels, at, community = np.unique(block["community"].to_numpy(), return_index=True, return_inverse=True)
        mass = block["mass"].to_numpy()[at]
        own = pc.is_null(block["other"]).to_numpy()
        node, weight = block["node"].to_numpy(), block["weight"].to_numpy()
        order = np.flatnonzero(own)[np.argsort(node[own])]
        names, start = node[order], community[order]
        other = block["other"].filter(pa.array(~own)).to_numpy()
        place = np.minimum(np.searchsorted(names, other), len(names) - 1)
        far = np.where(names[place] == other, place, len(names) + community[~own])
        end = _settled(start, weight[order], mass, np.searchsorted(names, node[~own]), far, weight[~own], total, least)
        gone = np.flatnonzero(end != start)
        return pa.table({"node": names[gone], "to": labels[end[gone]]})

    return moved


def _contracted(near: np.ndarray, far: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(near.max()) + 1
    pairs, at = np.unique(near * size + far, return_inverse=True)
    return pairs // size, pairs % size, np.bincount(at, weights=weight)


def search(smallest: float) -> Callable[[pa.Table], pa.Table]:
    """A whole graph that fits into a block (low, high, weight) → (node, community).

    Nodes move, then communities as wholes, level by level, then nodes again, until neither
    gains more than ``smallest`` times the weight. A community has the number of one of its nodes."""

    def found(links: pa.Table) -> pa.Table:
        low, high = links["low"].to_numpy(), links["high"].to_numpy()
        names, places = np.unique(np.concatenate([low, high]), return_inverse=True)
        near, far = places, np.concatenate([places[len(low):], places[: len(low)]])
        weight = np.concatenate([links["weight"].to_numpy()] * 2)
        total = float(weight.sum())

        def settled(start: np.ndarray, near: np.ndarray, far: np.ndarray, weight: np.ndarray) -> np.ndarray:
            degree = np.bincount(near, weights=weight, minlength=len(start))
            mass = np.bincount(start, weights=degree, minlength=len(start))
            apart = near != far
            return _settled(start, degree, mass, near[apart], far[apart], weight[apart], total, smallest * total)

        start = np.arange(len(names))
        home = settled(start, near, far, weight)
        while not np.array_equal(home, start):
            merged = False
            while True:
                labels, inner = np.unique(home, return_inverse=True)
                outer = settled(np.arange(len(labels)), *_contracted(inner[near], inner[far], weight))
                if np.array_equal(outer, np.arange(len(labels))):
                    break
                merged, home = True, labels[outer[inner]]
            if not merged:
                break
            start, home = home, settled(home, near, far, weight)
        return pa.table({"node": names, "community": names[home]})

    return found
