"""Batches of texts as one byte buffer: word spans and 64-bit hashes by numpy.

``byte_hash`` is the hash of a span of any length: 8 bytes a step are mixed into a running
state, long spans are hashed by XXH3. Where a hash alone would decide a value within one
task, ``equal_spans`` compares the bytes. ``span_hash`` takes overlapping *short* spans (up
to ``SHORT_SPAN`` bytes) from one running polynomial sum; longer strings of few letters can
share such a sum, so it is not for them. Equal bytes always hash equal.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in slices of about this many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_000_000
#: Tables of powers beyond this length (left by a very long text) are dropped.
KEPT_POWERS = 3_000_000
#: Spans up to this many bytes may be taken from polynomial sums.
SHORT_SPAN = 64
#: Spans of more bytes are hashed one by one.
LANED_SPAN = 512
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: [\x20\x09-\x0D]: what separates words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z on bytes; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give memory that was freed back to the system; a worker process stays between tasks and stages."""
    if len(_POWERS[0]) > KEPT_POWERS:
        _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(n + 65_536, base, np.uint64)
            table[0] = 1
            _POWERS[k] = np.cumprod(table)
    return _POWERS[0], _POWERS[1]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into row ranges of about ``limit`` bytes (one row at least).

    Yields first row, end row, bytes and offsets (from 0). Null is an empty text.
    """
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        chunk = pc.fill_null(chunk.cast(pa.large_binary()), b"")
        _, at, data = chunk.buffers()
        at = np.frombuffer(at, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(chunk):
            end = int(max(first + 1, np.searchsorted(at, at[first] + limit, "right") - 1))
            yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
            first = end
    release()


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the index of its first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(space[data], out=inside[:-1])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = ~inside
    ends[1:] &= inside[:-1]
    ends[0] = False
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    touching = cuts[inside[cuts] & inside[cuts - 1]]  # a word ends where its text ends
    begins[touching] = True
    ends[touching] = True
    starts, stops = np.flatnonzero(begins[:-1]), np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, at)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes any short span from them."""
    power, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return mix((sums[stops] - sums[starts]) * _POWERS[1][starts] + (stops - starts).astype(np.uint64))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def byte_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span."""
    size = stops - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    lanes, row, step = _lanes(data), np.flatnonzero((size > 0) & (size <= LANED_SPAN)), 0
    while len(row):
        left = size[row] - step
        state = out[row] * np.uint64(0xD6E8FEB86659FD93) if step else out[row]
        out[row] = mix(state ^ (lanes[starts[row] + step] & _LOW_BYTES[np.minimum(left, 8)]))
        row, step = row[left > 8], step + 8
    long = np.flatnonzero(size > LANED_SPAN)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        for k, start, stop in zip(long.tolist(), starts[long].tolist(), stops[long].tolist(), strict=True):
            out[k] = xxhash.xxh3_64_intdigest(view[start:stop])
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, other_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes of ``data`` from each start equal those of ``other``."""
    same = np.ones(len(starts), bool)
    here, there = _lanes(data), _lanes(other)
    row, step = np.flatnonzero((size > 0) & (size <= LANED_SPAN)), 0
    while len(row):
        left = size[row] - step
        mask = _LOW_BYTES[np.minimum(left, 8)]
        differ = (here[starts[row] + step] & mask) != (there[other_starts[row] + step] & mask)
        same[row[differ]] = False
        row, step = row[~differ & (left > 8)], step + 8
    for k in np.flatnonzero(size > LANED_SPAN).tolist():
        same[k] = np.array_equal(data[starts[k] : starts[k] + size[k]], other[other_starts[k] : other_starts[k] + size[k]])
    return same


def first_equal(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """For every span the row of the first one with the same bytes (``hashed``: equal for equal bytes)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, at, of = np.unique(hashed, return_index=True, return_inverse=True)
    first = at[of]
    size = stops - starts
    same = size == size[first]
    same[same] = equal_spans(data, starts[same], data, starts[first[same]], size[same])
    seen: dict[bytes, int] = {}
    for k in np.flatnonzero(~same).tolist():  # other bytes under the same hash
        first[k] = seen.setdefault(data[starts[k] : stops[k]].tobytes(), k)
    return first


def piece_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of every piece between consecutive ``at``, a few megabytes at a time."""
    out, first = [np.zeros(0, np.uint64)], 0
    while first < len(at) - 1:
        end = int(max(first + 1, np.searchsorted(at, at[first] + SLICE_BYTES, "right") - 1))
        part = at[first : end + 1] - at[first]
        out.append(byte_hash(data[at[first] : at[end]], part[:-1], part[1:]))
        first = end
    return np.concatenate(out)


def shingle_hash(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by position of its first word."""
    n = len(word_hash) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + word_hash[k : k + n] + np.uint64(k + 1))
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c in ``counts``, one after the other."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)
