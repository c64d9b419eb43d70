"""Flat numpy views of Arrow text columns: words, rolling hashes and window hashes.

Every function works on one *slice* of a batch: ``data`` (uint8, UTF-8 bytes of all texts of the slice, end to end)
and ``offsets`` (int64, one more than texts). Slices hold ``SLICE_BYTES`` of text, or one text if that is longer, so
the temporaries of a task are bounded by the slice and not by the batch or the partition.

Hashes are polynomials over the bytes (or over the word hashes) modulo the prime 2**61 - 1, finished by a bijective mixer. Two
different strings of m bytes agree for at most m of the 2**61 bases, whatever their structure. Among n distinct strings, not made
against the base, a collision has probability about n*n / 2**62: 4e-3 at 130 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

PRIME = np.uint64((1 << 61) - 1)
#: The bases for bytes and for word hashes.
_P = np.uint64(0x1E3779B97F4A7C15)
_Q = np.uint64(0x16E8FEB86659FD93)
_LOW30, _LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, ...]] = {}


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective finisher (splitmix64)."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """Any 64-bit number modulo 2**61 - 1."""
    x = (x & PRIME) + (x >> _61)
    return x - PRIME * (x >= PRIME)


def _turn(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo 2**61 - 1, for x below 2**61."""
    return ((x & _LOW30) << _31) | (x >> _30)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for factors below 2**61, in halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _mod(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, ...]:
    """Low 31 and high 30 bits of base**i, and base**-i, modulo 2**61 - 1, for i < n at least."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max((1 << 19) + (1 << 17), n + (n >> 2))
        prime = int(PRIME)
        tables = []
        for b in (int(base), pow(int(base), -1, prime)):
            t, k = np.ones(size, np.uint64), 1
            while k < size:
                t[k : 2 * k] = _times(t[: min(k, size - k)], np.uint64(pow(b, k, prime)))
                k *= 2
            tables.append(t)
        have = _POWERS[int(base)] = (tables[0] & _LOW31, tables[0] >> _31, tables[1])
        if size > 8 << 20:
            _POWERS.pop(int(base))  # a giant text's tables do not stay
    return have


class Rolling:
    """Hash of any substring of ``values`` in constant time: a polynomial modulo 2**61 - 1. Values of type uint64 are hashes, of which 61 bits count."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _P):
        n = len(values)
        low, high, self.down = powers(base, n + 1)
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        a, b = self.low[1:], self.high[1:]
        v = values >> np.uint64(3) if values.dtype == np.uint64 else values.astype(np.uint64)
        v += np.uint64(1)
        if values.dtype == np.uint8 and n < 1 << 24:  # the sums of both halves stay below 2**64
            np.multiply(v, low[:n], out=a)
            np.multiply(v, high[:n], out=b)
        else:
            term = _times(v, low[:n] | (high[:n] << _31))
            np.bitwise_and(term, _LOW31, out=a)
            np.right_shift(term, _31, out=b)
        np.cumsum(a, out=a)
        np.cumsum(b, out=b)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        whole = _mod(_mod(self.low[ends] - self.low[starts]) + _turn(_mod(self.high[ends] - self.high[starts])))
        return mix(_times(whole, self.down[starts]), salt)


def text_slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, data, offsets) for slices of the batch; a null text counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield slice(low, high), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and per text the index of its first word (one more)."""
    solid = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1]))[: len(data)]
    after = np.concatenate((solid[1:], [False]))[: len(data)]
    starts = np.flatnonzero(solid & (~before | edge[: len(data)]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in its text, byte start and end of all \\n-split lines; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    of = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1))
    starts = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((starts, of))
    of, starts = of[order], starts[order]
    last = np.append(of[1:] != of[:-1], True)
    ends = np.where(last, offsets[of + 1], np.append(starts[1:], 0) - 1)
    return of, np.arange(len(of)) - np.searchsorted(of, of), starts, ends


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def windows(hashes: np.ndarray, firsts: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words of all k-word windows inside one text, and the windows' hashes."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(firsts[1:], np.diff(firsts))
    starts = np.flatnonzero(np.arange(n) + k <= last)
    return starts, Rolling(hashes, _Q)(starts, starts + k, salt + k)


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in some [start, start + length)."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:n]) > 0
