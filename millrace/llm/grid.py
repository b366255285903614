"""Words and word windows of whole Arrow text columns as flat numpy arrays.

A ``Grid`` holds one 64-bit hash per word and the row that the word is in. The
work is a fixed number of array passes over the bytes, whatever the texts hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_CODES = mix(np.arange(1, 257, dtype=U) * GOLDEN)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, U(0x5851F42D4C957F2D), U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = _powers(4096)


@dataclass
class Grid:
    """hashes[k] is the hash of word k of all rows; words of row r are first[r]:first[r + 1]."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n_words)


def slices(col: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of at most ``most_bytes`` each; a longer text is a run of its own."""
    ends = np.cumsum(np.diff(_offsets(col)))
    at = 0
    while at < len(col):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
        yield at, col.slice(at, to - at)
        at = to


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def words(col: pa.Array, punctuation: bool = False, fold: bool = False) -> Grid:
    """Hash the words of each row; a null row has none.

    Words end at ASCII white space and, if ``punctuation``, at ASCII
    punctuation; ``fold`` ignores the case of A to Z.
    """
    if not len(col):
        return Grid(np.zeros(0, U), np.zeros(1, np.int64))
    if col.null_count:
        col = col.fill_null("")
    off = _offsets(col)
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    inside = ~(_PUNCT if punctuation else _SPACE)[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return Grid(np.zeros(0, U), np.zeros(len(off), np.int64))
    begins = np.ones(len(at), bool)
    begins[1:] = np.diff(at) > 1
    cut = np.searchsorted(at, off[:-1])
    begins[cut[cut < len(at)]] = True
    start = np.flatnonzero(begins)
    size = np.diff(start, append=len(at))
    powers = _POWERS if size.max() <= len(_POWERS) else _powers(int(size.max()))
    with np.errstate(over="ignore"):
        place = np.arange(len(at)) - np.repeat(start, size)
        hashes = mix(np.add.reduceat((_FOLDED if fold else _CODES)[data[at]] * powers[place], start))
    return Grid(hashes, np.searchsorted(at[start], off))


def windows(grid: Grid, width: int) -> Grid:
    """Hashes of all ``width``-word windows of each row; a row of fewer words has one, of all its words."""
    n, out_n = grid.n_words, np.maximum(grid.n_words - width + 1, np.minimum(grid.n_words, 1))
    first = np.concatenate([[0], np.cumsum(out_n)])
    if not first[-1]:
        return Grid(np.zeros(0, U), first)
    start = np.arange(first[-1]) - np.repeat(first[:-1], out_n) + np.repeat(grid.first[:-1], out_n)
    end = np.repeat(grid.first[1:], out_n)
    total = np.zeros(len(start), U)
    with np.errstate(over="ignore"):
        for k in range(width):
            at = start + k
            inside = at < end
            total += np.where(inside, mix(grid.hashes[np.where(inside, at, 0)] + U(k + 1) * GOLDEN), U(0))
    return Grid(mix(total), first)
