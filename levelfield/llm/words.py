"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, unchanged, which is
``[^\\x20\\x09-\\x0D]+``; that is also what ``bytes.split()`` gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are worked on in groups of about so many bytes, which bounds the arrays of a
#: task.  One longer text is a group of its own.
GROUP_BYTES = 2 << 20

GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 16  # bytes hashed under one table of powers
_LONG = 64  # longer words get XXH64 instead

with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.r_[1, np.full(_SPAN - 1, _BASE, np.uint64)].astype(np.uint64))
    _BACK = np.cumprod(np.r_[1, np.full(_SPAN - 1, pow(_BASE, -1, 1 << 64), np.uint64)].astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    return _mix_in_place(x, np.empty_like(x))


def _mix_in_place(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    x ^= np.right_shift(x, np.uint64(30), out=spare)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=spare)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=spare)
    return x


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are in order and apart."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = int(np.searchsorted(end, base + _SPAN - 1, "right"))
        if to > at:
            piece = data[base : end[to - 1]].astype(np.uint64)
            piece += np.uint64(1)
            piece *= _POWER[: len(piece)]
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece, out=total[1:])
            s, e = start[at:to] - base, end[at:to] - base
            out[at:to] = (total[e] - total[s]) * _BACK[s]
        at = max(to, at + 1)
    size = end - start
    out ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = mix(out)
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), 7)
    return out


class Words:
    """The words of a group of texts.

    data: all bytes, a blank around every text.  begin, finish: where text i lies.
    start, end: where each word lies.  first[i]:first[i + 1]: the words of text i.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.r_[0, np.cumsum(sizes + 1)][:-1].astype(np.int64) + 1
        self.finish = self.begin + sizes
        gap = GAP[self.data]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.r_[np.searchsorted(self.start, self.begin), len(self.start)]
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    @property
    def text_of(self) -> np.ndarray:
        """For each word the text it stands in."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; run i starts at word i."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    spare = np.empty_like(out)
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : len(hashes) - n + 1 + k]
        _mix_in_place(out, spare)
    return out


def run_starts(words: Words, n: int) -> np.ndarray:
    """Word indices at which ``n`` words of the same text begin."""
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.start))
    return np.flatnonzero(left >= n)


def groups(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts as bytes (null: empty), about GROUP_BYTES of text at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
        texts = [t or b"" for t in column.to_pylist()]
        at, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > GROUP_BYTES:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t) + 1
        if at < len(texts):
            yield batch.slice(at), texts[at:]
