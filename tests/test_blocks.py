"""Kernels on Arrow batches: blocks are bounded by bytes, texts stay out of Python."""

import tracemalloc

import pyarrow as pa
import pytest

from archtrail.operators import blocks


def batches(rows, size=10_000, **values):
    for at in range(0, rows, size):
        ids = range(at, min(at + size, rows))
        yield pa.RecordBatch.from_pydict({
            "source": [f"node number {i}" for i in ids], "target": [f"node number {i // 2}" for i in ids],
            **{name: [value(i) for i in ids] for name, value in values.items()},
        })


def test_long_keys_fill_a_block_early():
    rows = list(batches(40_000, 1000, value=lambda i: ["a long chain of ids"] * 200))
    made = list(blocks.in_blocks(iter(rows)))
    assert sum(block.num_rows for block in made) == 40_000
    assert all(block.nbytes < blocks.BLOCK_BYTES + 2 * rows[0].nbytes for block in made) and len(made) > 1


@pytest.mark.parametrize("kernel,values", [
    (blocks.spread_highest, {"value": lambda i: f"node number {i}"}), (blocks.spread_distance, {"value": lambda i: i % 3 - 1}),
    (blocks.peel, {"way_in": lambda i: 1, "way_out": lambda i: 1}),
])
def test_no_object_per_text(kernel, values):
    given = list(batches(200_000, **values))
    tracemalloc.start()
    try:
        assert sum(len(out) if isinstance(out, list) else out.num_rows for out in kernel(iter(given)))
        assert tracemalloc.get_traced_memory()[1] < 24_000_000  # a text as an object takes 70 bytes: 42 MB
    finally:
        tracemalloc.stop()


def test_highest_is_by_bytes():
    link = pa.RecordBatch.from_pydict({"source": ["\U0001f600", "￮", "z"], "target": ["t", "t", "t"], "value": ["\U0001f600", "￮", "z"]})
    assert [row for out in blocks.spread_highest(iter([link])) for row in out.to_pylist()] == [{"node": "t", "value": "\U0001f600"}]
