"""SentencePiece pieces as sorted keys, and the unigram scores that segmentations are chosen by."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from archtrail.llm.packed import prefix_sums, span_hash

#: U+2581, which stands for a space, in UTF-8.
SPACE_MARK = b"\xe2\x96\x81"
#: Added to the lowest score for a character that is no piece (as the library does).
UNKNOWN_PENALTY = 10.0
#: Zipf-Mandelbrot offset of the default scores.
ZIPF_OFFSET = 2.7


class Pieces:
    """The vocabulary of a model file: keys for look-up, bytes for decoding.

    Scores: ``zipf`` (default) gives the piece of rank r the probability proportional to
    1 / (r + 2.7), as merge ranks are an order of frequency; ``model`` takes the file's.
    Characters without a piece become byte pieces where the vocabulary has them.
    """

    def __init__(self, model_file: str, scores: str = "zipf") -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(n)]
        normal = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        if scores == "zipf":
            share = 1 / (np.arange(1, len(normal) + 1) + ZIPF_OFFSET)
            score = np.log(share / share.sum())
        elif scores == "model":
            score = np.array([model.get_score(k) for k in normal])
        else:
            raise ValueError("scores must be zipf or model")
        score = score.astype(np.float32).astype(np.float64)
        self.unknown_id, self.unknown_score = model.unk_id(), float(score.min()) - UNKNOWN_PENALTY
        self.bytes = [names[k].encode() for k in range(n)]
        self.byte_id = np.full(256, -1, np.int32)
        for k in range(n):
            if model.is_byte(k):
                value = int(names[k][3:5], 16)
                self.byte_id[value] = k
                self.bytes[k] = bytes([value])
            elif model.is_control(k):
                self.bytes[k] = b""
        self.has_bytes = bool((self.byte_id >= 0).all())
        if not self.has_bytes:
            self.bytes[self.unknown_id] = " ⁇ ".encode()
        body = b"".join(self.bytes[k] for k in normal)
        ends = np.cumsum([len(self.bytes[k]) for k in normal])
        starts = ends - [len(self.bytes[k]) for k in normal]
        keys = span_hash(prefix_sums(np.frombuffer(body, np.uint8)), starts, ends)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(normal, np.int32)[order], score[order]
        self.sizes = sorted({len(self.bytes[k]) for k in normal}, reverse=True)  # on a tie the longer last piece is first
        if any(SPACE_MARK in self.bytes[k].lstrip(SPACE_MARK) for k in normal if self.bytes[k].strip(SPACE_MARK)):
            raise ValueError("pieces that hold a space after other characters are not supported")

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each key and whether there is one."""
        place = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return place, self.keys[place] == hashed


@lru_cache(maxsize=2)
def load(model_file: str, scores: str = "zipf") -> Pieces:
    """The pieces of a model file, read once in a worker process."""
    return Pieces(model_file, scores)


def escape(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as the model sees them: a space before each text that is not empty, spaces as marks."""
    size = np.diff(at)
    with_lead = np.insert(data, at[:-1][size > 0], 32)
    lead_at = at + np.concatenate([[0], np.cumsum(size > 0)])
    space = with_lead == 32
    out_at = np.concatenate([[0], np.cumsum(np.where(space, 3, 1))])
    out = np.empty(out_at[-1], np.uint8)
    out[out_at[:-1][~space]] = with_lead[~space]
    for k in range(3):
        out[out_at[:-1][space] + k] = SPACE_MARK[k]
    return out, out_at[lead_at]


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of marks with what follows them; no piece crosses their bounds. Also the first span of every text."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    mark = np.zeros(n + 3, bool)
    mark[:n] = (padded[:n] == 0xE2) & (padded[1 : n + 1] == 0x96) & (padded[2 : n + 2] == 0x81)
    begins = mark[:n].copy()
    begins[3:] &= ~mark[: max(n - 3, 0)]
    begins[at[:-1][at[:-1] < at[1:]]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, at)
