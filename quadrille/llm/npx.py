"""Vectorised byte, word and window hashing for Arrow batches.

Two kinds. Names, which stand for words and runs of words, are made with a non-linear step per eight bytes and per
doubling of a run (long words by BLAKE2); two independent lanes give 128 bits. Grams, which only decide where something
is looked for and never whether it is equal, are polynomials over the ring of 64-bit integers: the gram of any byte
string follows from two prefix sums, but such hashes collide on strings made for it, for every base.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG = 64  # bytes of a word from which BLAKE2 takes over


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


class Poly:
    """Prefix-sum hashing with one base."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, U)
        k = 1
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
            k += m
        return out

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            size = max(1 << 16, 1 << int(n + 1).bit_length())
            self.up, self.down = self._powers(self.base, size), self._powers(self.inverse, size)
        out = np.zeros(n + 1, U)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


POLY = tuple(Poly(b) for b in BASES)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches, column: str, most: int = 1 << 20):
    """Slices of record batches with about ``most`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = column_bytes(batch.column(column))[1]
        at, n = 0, batch.num_rows
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(n, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end
        del batch  # before the next one is read


class Words:
    """The words of each text of a column: maximal runs outside ``[\\x20\\x09-\\x0D]``.

    ``start``/``end`` are byte positions in ``data``; ``row`` is a word's text; ``first[r]`` is the number
    of the first word of text r (n + 1 entries).
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        data, self.offsets = column_bytes(column)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        n = len(data)
        solid = ~SPACE[data]
        breaks = np.zeros(n + 1, bool)
        breaks[self.offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            after = np.append(solid[1:], False)
            self.start = np.flatnonzero(solid & (~before | breaks[:n]))
            self.end = np.flatnonzero(solid & (~after | breaks[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets, "left")
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(column)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit name of each word in lane ``which``."""
        return span_names(self.data, self.start, self.end, which)


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit names of byte spans: eight bytes at a time, each mixed in before the next."""
    factor = U(BASES[which])
    length = end - start
    out = mix(length.astype(U) * factor + U(which + 1))
    if not len(start):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    some = np.flatnonzero((length > 0) & (length <= LONG))
    at, left = start[some], length[some]
    while len(some):
        value = eight[at]
        part = left < 8
        value[part] &= (U(1) << (left[part] * 8).astype(U)) - U(1)
        out[some] = mix((out[some] ^ value) * factor + U(0xD6E8FEB86659FD93))
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(length > LONG)
    if len(long):
        raw, salt = data.tobytes(), bytes([which])
        for k, a, b in zip(long.tolist(), start[long].tolist(), end[long].tolist()):
            out[k] = int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, salt=salt).digest(), "little")
    return out


def windows(names: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Name of each ``size`` consecutive names, by doubling; empty if there are fewer."""
    n = len(names)
    if n < size:
        return np.zeros(0, U)
    factor = U(BASES[which])
    out, step = names, 1
    while 2 * step <= size:
        out = mix(out[:-step] * factor + out[step:])
        step *= 2
    rest = size - step
    if rest:
        m = n - size + 1
        out = mix(out[:m] * factor + out[rest : rest + m] + U(rest))
    return out


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Gram of each ``size`` consecutive bytes; empty if there are fewer."""
    if len(data) < size:
        return np.zeros(0, U)
    poly = POLY[0]
    prefix = poly.prefix(data.astype(U) + U(1))
    at = np.arange(len(data) - size + 1)
    return poly.spans(prefix, at, at + size)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value of each ``width`` consecutive ones (block-wise scans)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    out = np.arange(n)
    best = values.copy()
    step = 1
    while 2 * step <= width:
        other, at = best[step:], out[step:]
        take = other < best[: len(other)]
        best, out = np.where(take, other, best[: len(other)]), np.where(take, at, out[: len(other)])
        step *= 2
    rest = width - step
    if rest:
        other, at = best[rest:], out[rest:]
        take = other < best[: len(other)]
        out = np.where(take, at, out[: len(other)])
    return out[: n - width + 1]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 within each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
