"""Vectorised word finding and hashing over whole batches of texts.

Texts are joined with a line feed, which no word contains, and handled as one
byte array. Word hashes are polynomial, taken from one prefix sum, then mixed;
64 bits, so two of 10^9 different words meet with a probability of about 0.03.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that stand between words: space and \t to \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes outside [0-9A-Za-z] and non-ASCII characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[33:48] = _PUNCTUATION[58:65] = _PUNCTUATION[91:97] = _PUNCTUATION[123:127] = True
_PUNCTUATION[39] = False

#: Bytes that are hashed at once.
BLOCK = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    """base**0 .. base**(size-1) modulo 2**64, kept for the next batch."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a batch of texts: where they start and end, whose they are, their hashes.

    ``first[i]:first[i + 1]`` are text i's words. None counts as an empty text.
    """

    def __init__(self, texts: list[str | None], separators: np.ndarray = SPACE, lower: bool = True):
        parts = [(t or "").encode() for t in texts]
        sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        self.raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
        self.bytes = LOWER[self.raw] if lower else self.raw
        gap = separators[self.raw]
        # starts and ends take turns, as what stands before and the last byte are gaps
        edge = np.flatnonzero(np.append(True, gap[:-1]) != gap)
        self.start, self.end = edge[::2].copy(), edge[1::2].copy()
        self._place()

    def _place(self) -> None:
        self.first = np.searchsorted(self.start, self.base)
        self.count = np.diff(self.first)

    def split_punctuation(self) -> None:
        """Cut words further between Latin letters and ASCII punctuation, the apostrophe left alone."""
        b = self.raw
        letter = _ASCII_LETTER[b]
        latin = np.append(False, b[:-1] == 0xC3) & (b >= 0x80) & (b != 0x97) & (b != 0xB7)
        mark = _PUNCTUATION[b]
        cut = np.flatnonzero(((letter | latin)[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        self.start = np.sort(np.concatenate([self.start, cut]))
        self.end = np.sort(np.concatenate([self.end, cut]))
        self._place()

    def hashes(self) -> np.ndarray:
        """One hash per word, in runs of words of about BLOCK bytes, so that sums and powers take little memory."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(out):
            origin = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, origin + BLOCK, side="right")))
            raw = self.bytes[origin : self.end[to - 1]]
            sums = np.zeros(len(raw) + 1, dtype=np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(raw))[: len(raw)], out=sums[1:])
            start, end = self.start[at:to] - origin, self.end[at:to] - origin
            out[at:to] = mix((sums[end] - sums[start]) * _power_table(_INVERSE, len(raw))[start])
            at = to
        return out


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted distinct 63-bit hashes.

    A text with fewer words than ``size`` has its whole sequence as the one shingle.
    """
    h = words.hashes()
    rolled = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    for j in range(size):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[j : j + len(rolled)]
    rolled = mix(rolled) >> np.uint64(1)
    out = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(rolled[lo : hi - size + 1]).astype(np.int64))
        elif hi > lo:
            short = np.uint64(hi - lo)
            for x in h[lo:hi]:
                short = np.uint64((int(short) * 0xD6E8FEB86659FD93 + int(x)) % (1 << 64))
            out.append((mix(np.array([short])) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def text_chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[slice, list[str | None]]]:
    """Runs of texts of about ``limit`` bytes, so that strings and arrays stay small; no text is cut."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        to = min(len(ends), int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)) + 1)
        yield slice(at, to), column.slice(at, to - at).to_pylist()
        at = to


def give_back() -> None:
    """Return freed memory to the system, which a process that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run`` over batches, giving memory back when a task is done."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return done


def tidy_group(run: Callable) -> Callable:
    """``run`` on a group, giving memory back after each."""

    def done(group):
        try:
            return run(group)
        finally:
            give_back()

    return done
