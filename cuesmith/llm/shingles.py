"""Words and word shingles of texts as 64-bit hashes, for use inside Arrow functions.

Everything is computed for a run of texts at once on the bytes of the Arrow column: no string is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
#: Bytes of text that are hashed at a time (a longer text is cut at white space), and the multiplier of word hashes with its inverse.
RUN = 1 << 18
STEP = 0x9FB21C651E98DF25
BACK = pow(STEP, -1, 1 << 64)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte; A-Z are as a-z, white space (what words are cut at) is 0.
BYTE = spread(np.arange(1, 257, dtype=np.uint64))
BYTE[0x41:0x5B] = BYTE[0x61:0x7B]
BYTE[[0x20, *range(0x09, 0x0E)]] = 0


class _Powers:
    """Powers of STEP and BACK, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, RUN + 1)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (STEP, BACK))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _words(b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other in b, and the first byte of each word."""
    value = BYTE[b]
    white = value == 0
    fresh = np.zeros(len(b) + 1, bool)  # no word goes over these
    fresh[begins] = fresh[-1] = True
    first = np.flatnonzero(~white & (np.r_[True, white[:-1]] | fresh[:-1]))
    last = np.flatnonzero(~white & (np.r_[white[1:], True] | fresh[1:])) + 1
    up, down = _powers.upto(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(value * up[: len(b)], out=sums[1:])
    return spread((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts and the offsets of the texts in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, words a row) of runs of rows. Words are runs of anything but \\x20 and \\x09-\\x0D, with
    A-Z lower-cased; a run has about RUN bytes, or one text."""
    b, at = texts_of(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + RUN, "right")) - 1)
        a, z = int(at[row]), int(at[end])
        if z - a <= 2 * RUN:
            h, first = _words(b[a:z], at[row:end] - a)
            yield row, h, np.diff(np.searchsorted(first, at[row : end + 1] - a))
        else:  # one long text, in pieces that end behind white space
            parts = []
            while a < z:
                stop = min(z, a + RUN)
                while stop < z and BYTE[b[stop - 1]]:
                    more = np.flatnonzero(BYTE[b[stop : stop + RUN]] == 0)
                    stop = min(z, stop + (int(more[0]) + 1 if len(more) else RUN))
                parts.append(_words(b[a:stop], np.zeros(1, np.int64))[0])
                a = stop
            h = np.concatenate(parts)
            yield row, h, np.array([len(h)])
        row = end


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, set sizes) of runs of rows: tokens are the rows' sets one after the other, each sorted.
    A set holds the distinct hashes of a text's k-word shingles; of fewer words, but not none, the whole sequence."""
    for row, w, n in word_hashes(column):
        ends = np.cumsum(n)
        of = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, n > 0))
        made = np.bincount(of, minlength=len(n))
        begin = np.repeat(ends - n - np.cumsum(made) + made, made) + np.arange(len(of))
        length = np.minimum(n, k)[of]
        h = length.astype(np.uint64)
        for j in range(k):
            inside = j < length
            term = np.where(inside, w[np.minimum(begin + j, max(0, len(w) - 1))] * PRIMES[j % 5], np.uint64(0)) if len(w) else h
            h = spread(h + term) if j >= 5 else h + term
        h = spread(h)
        stop = np.cumsum(made)
        for a, z in zip((stop - made).tolist(), stop.tolist(), strict=True):
            h[a:z].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield row, h[keep], np.bincount(of[keep], minlength=len(n))
