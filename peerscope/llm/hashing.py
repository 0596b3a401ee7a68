"""Vectorised word splitting and hashes over whole Arrow batches.

Words and lines are hashed eight bytes at a time, each step a bijection of what it
takes in, so words of up to eight bytes and one length never collide.

Prefix hashes are polynomials modulo 2**64: the running sum of ``value *
BASE**position``; the hash of any span is the difference of two prefix values, moved
to position 0 by a power of the inverse base. Such a hash is weak for spans of a
thousand values and more (Thue-Morse sequences collide), so it serves only spans
that are bounded by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)``, kept for the next batch."""
    known = _powers.get(name)
    if known is None or len(known) < n:
        size = max(n, 2 * CHUNK_BYTES)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[name] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running hashes of a byte or 64-bit array."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, _power("base", BASE, len(data)), out=out[1:], dtype=np.uint64, casting="unsafe")
    np.add.accumulate(out, out=out)
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans ``[start, end)``; equal spans get equal hashes."""
    return (prefix[end] - prefix[start]) * _power("inverse", INVERSE, len(prefix))[start]


#: Longer spans are hashed one by one.
LONG_SPAN = 4096
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``, whatever their length."""
    size = end - start
    out = mix(size.astype(np.uint64) + BASE)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, 0, (1,))
    active = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, rest = start[active], size[active]
    while len(active):
        out[active] = mix(out[active] ^ (eights[at] & _TAIL[np.minimum(rest, 8)])) + BASE
        more = rest > 8
        active, at, rest = active[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values (Horner's rule)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, k):
        out *= BASE
        out += values[j:n + j]
    return mix(out)


def separators(codes: list[int]) -> np.ndarray:
    """A table that is true for bytes that belong to a word."""
    table = np.ones(256, bool)
    table[codes] = False
    return table


#: Words are runs of anything but space and the five ASCII control blanks.
BLANK = [0x20, *range(0x09, 0x0E)]
WORD = separators(BLANK)
#: Words of benchmark comparison: ASCII letters, digits and all beyond ASCII.
ALNUM = separators([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        after = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        after = min(max(after, row + 1), rows)
        yield row, after
        row = after


class Words:
    """Words of some rows: byte spans, 64-bit hashes, and each row's range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD, lower: bool = False):
        first, last = int(offsets[0]), int(offsets[-1])
        self.data = LOWER[data[first:last]] if lower else data[first:last]
        self.offsets = offsets - first
        inside = table[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.hashes = byte_hashes(self.data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first minimum among each ``width`` consecutive values."""
    out, place, have = values, np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while have < width:
        step = min(have, width - have)
        left = out[:-step] <= out[step:]
        place = np.where(left, place[:-step], place[step:])
        out = np.where(left, out[:-step], out[step:])
        have += step
    return place.astype(np.int64)


def powers_inverse(n: int) -> np.ndarray:
    """Powers of the inverse base, which move a span's hash to position 0."""
    return _power("inverse", INVERSE, n)
