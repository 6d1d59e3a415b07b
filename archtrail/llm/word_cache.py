"""Encode each distinct word of a task once and put documents together from the results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from archtrail.llm.packed import byte_hash, equal_spans, spread

#: A task forgets its words when it holds more words or bytes; that costs time only, results stay.
HELD_WORDS, HELD_BYTES = 1_500_000, 32_000_000


class WordCache:
    """Values (token ids) of words; ``encode`` gets new words as bytes, sorted, distinct.

    Words are looked up by hash and then compared, so a word never gets another's values.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, held: int = HELD_WORDS) -> None:
        self.encode, self.kind, self.held = encode, kind, held
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.values, self.at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.body, self.body_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, fresh: list[bytes]) -> np.ndarray:
        """Rows of new words, in the order of ``fresh``."""
        order = sorted(range(len(fresh)), key=fresh.__getitem__)
        ordered = [fresh[k] for k in order]
        values, sizes = self.encode(ordered)
        row = np.empty(len(fresh), np.int64)
        row[order] = np.arange(len(fresh)) + len(self.at) - 1
        self.values = np.concatenate([self.values, values.astype(self.kind)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
        self.body = np.concatenate([self.body, np.frombuffer(b"".join(ordered), np.uint8)])
        self.body_at = np.concatenate([self.body_at, self.body_at[-1] + np.cumsum([len(w) for w in ordered])])
        return row

    def look_up(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word where its values start in ``self.values`` and how many they are."""
        if len(self.keys) > self.held or len(self.body) > HELD_BYTES:
            self._forget()
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, first, number = np.unique(self._hash(data, starts, stops), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        new |= place >= len(self.keys)
        if new.any():
            body = data.tobytes()
            row = self._learn([body[s:e] for s, e in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
            self.rows = np.insert(self.rows, place[new], row)
            self.keys = np.insert(self.keys, place[new], keys[new])
            place = np.searchsorted(self.keys, keys)
        row = self.rows[place[number]]
        size = stops - starts
        same = size == self.body_at[row + 1] - self.body_at[row]
        same[same] = equal_spans(data, starts[same], self.body, self.body_at[row[same]], size[same])
        other = np.flatnonzero(~same)
        if len(other):  # other bytes under the same hash: encoded on their own, not kept by hash
            words = [data[starts[k] : stops[k]].tobytes() for k in other.tolist()]
            distinct = sorted(set(words))
            known = dict(zip(distinct, self._learn(distinct).tolist(), strict=True))
            row[other] = [known[w] for w in words]
        return self.at[row], self.at[row + 1] - self.at[row]

    _hash = staticmethod(byte_hash)

    def gather(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.values[np.repeat(at, size) + spread(size)]
