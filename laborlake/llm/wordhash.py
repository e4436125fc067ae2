"""Words of an Arrow string column as arrays of hashes, without a Python object per word.

A text's bytes are cut at separator bytes; a word's hash is a polynomial of its bytes modulo 2^64, taken from running
sums and mixed. Runs of words are hashed likewise from their words' hashes. UTF-8 keeps every byte of a longer
character above 127, so cutting at ASCII bytes never cuts a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

#: Separators by byte: ASCII white space; and everything in ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        for k, base in enumerate(self.bases):
            t = self.tables[k]
            while len(t) < n:
                t = np.concatenate([t, t * np.uint64(pow(base, len(t), 1 << 64))])
            self.tables[k] = t
        return self.tables[0][:n], self.tables[1][:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts: byte spans in ``data``, hashes, each text's first word and first byte (``offsets``
    and ``bounds``, one more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def ends_of(self) -> np.ndarray:
        """For each word the index behind its text's last word."""
        return np.repeat(self.offsets[1:], np.diff(self.offsets))


def cut(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES) -> Words:
    """``data`` holds the texts' bytes one behind the other, ``bounds`` where each begins and the last ends."""
    size = len(data)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < size)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _BYTES.upto(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds), bounds)


def chunks(column: pa.Array, separators: np.ndarray = SPACES) -> Iterator[tuple[int, int, Words]]:
    """Rows from, to and their words, in pieces of about ``CHUNK`` bytes. A null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield at, to, cut(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], separators)
        at = to


def run_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hash of each run of ``lengths`` words from ``starts``."""
    up, down = _WORDS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mixed((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64))


def whole_runs(words: Words, k: int) -> np.ndarray:
    """Indexes of the words from which ``k`` words follow in the same text."""
    n = len(words.hashes)
    return np.flatnonzero(np.arange(n) + k <= words.ends_of()) if n >= k else np.zeros(0, np.int64)
