"""Word splitting and hashing over the bytes of many texts at once, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240607)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[list(WHITE)] = False
#: digits, letters and everything beyond ASCII
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x41:0x5B] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (one entry more than texts); null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole texts of about `most` bytes; a longer text is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        m = max(n, SLICE_BYTES + 1)
        for name, step in (("up", _STEP), ("down", _STEP_BACK)):
            p = np.full(m, step, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
        if m > 4 * SLICE_BYTES:  # one very long text must not stay in memory
            got = _POWERS["up"], _POWERS["down"]
            _POWERS.clear()
            return got
    return _POWERS["up"], _POWERS["down"]


class Words:
    """The words of texts[a:b]: hash, byte range within `data`, and how many each text has."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: int, b: int, inside: np.ndarray = NOT_WHITE, hashed: bool = True):
        base = int(offsets[a])
        part, at = data[base : offsets[b]], offsets[a : b + 1] - base
        n = len(part)
        self.data, self.texts = part, b - a
        if not n:
            self.hash, self.start, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.first = np.zeros(b - a + 1, np.int64)
            return
        keep = inside[part]
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        begins = keep.copy()
        begins[1:] &= ~keep[:-1] | cut[1:n]
        ends = keep.copy()
        ends[:-1] &= ~keep[1:] | cut[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self._at = at
        if hashed:  # else once they are recut
            self._hash()

    def _hash(self) -> None:
        n = len(self.data)
        up, down = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[FOLD[self.data]] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, self._at)

    def recut(self, start: np.ndarray, end: np.ndarray) -> Words:
        """The same texts with other words, given in order."""
        self.start, self.end = start, end
        self._hash()
        return self

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text, counted from a, that each word stands in."""
        return np.repeat(np.arange(self.texts), self.counts)


def word_hash(word: str, inside: np.ndarray = NOT_WHITE) -> int:
    """The hash that Words gives this one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), 0, 1, inside).hash[0])


def shingles(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words, and where each text's begin.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    n = words.counts
    have = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(have)])
    at = np.repeat(words.first[:-1] - first[:-1], have) + np.arange(first[-1])
    stop = np.repeat(words.first[1:], have)
    out = np.full(len(at), seed + 1, np.uint64)
    padded = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(at + k < stop, padded[at + k], np.uint64(0))
    return mix(out), first


def stretches(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(a, at): texts a, a+1, ... or parts of them, text a+i in bytes at[i]:at[i+1], about `most` bytes at a time.

    A text of more than `most` bytes comes in several stretches of its own, cut only behind bytes that `inside` marks as
    no part of a word; a word of more than `most` bytes is not cut.
    """
    for a, b in slices(offsets, most):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= most or b - a > 1:
            yield a, offsets[a : b + 1]
            continue
        while low < high:
            cut, step = min(low + most, high), low
            while cut < high:
                gaps = np.flatnonzero(~inside[data[step:cut]])
                if len(gaps):
                    cut = step + int(gaps[-1]) + 1
                    break
                step, cut = cut, min(cut + most, high)
            yield a, np.array([low, cut])
            low = cut
