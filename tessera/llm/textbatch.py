"""Vectorised tokenising of Arrow string batches.

A batch's texts lie one after another in one UTF-8 buffer.  Tokens are maximal
runs of bytes that are no separators; every token gets a 64-bit hash, computed
for the whole buffer at once from a prefix sum of a polynomial in the bytes, so
that no Python object is made for each word.  ASCII separators never occur
inside a multi-byte character, so working on bytes is exact.

Null texts count as empty.  Texts of any length are handled whole: buffers are
cut only between tokens, and a token longer than a chunk is hashed in one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # 5 mod 8: powers repeat as late as possible

U64 = np.uint64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true for the bytes in the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are [^\x20\x09-\x0D]+
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+: letters, digits and all that is not ASCII
PUNCT = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Lines are [^\n]+
NEWLINE = separators((0x0A, 0x0A))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _letters(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=U64)
    if lower:
        codes[0x41:0x5B] += U64(32)
    return mix((codes + U64(1)) * U64(0xD1B54A32D192ED03)) | U64(1)


_TABLES = {True: _letters(True), False: _letters(False)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    size = CHUNK if n <= CHUNK else 1 << (n - 1).bit_length()
    if size not in _POWERS:
        _POWERS[size] = tuple(_series(b, size + 1) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _POWERS[size]


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


def _hash_chunk(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(data))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


class Tokens:
    """Tokens of consecutive texts: byte spans, hashes, and where each text's tokens begin."""

    def __init__(self, starts, ends, hashes, offsets):
        self.starts, self.ends, self.hashes, self.offsets = starts, ends, hashes, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owners(self) -> np.ndarray:
        """For each token, the index of its text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def tokenize(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray = SPACE, lower: bool = True) -> Tokens:
    """Tokens of the texts data[bounds[i]:bounds[i + 1]]; bounds start at 0."""
    n = len(data)
    if not n:
        return Tokens(*(np.zeros(0, np.int64),) * 2, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    word = ~sep[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~word[:-1]
    first[bounds[:-1][bounds[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~word[1:]
    starts = np.flatnonzero(word & first)
    ends = np.flatnonzero(word & last) + 1
    return Tokens(starts, ends, hash_spans(data, starts, ends, lower), np.searchsorted(starts, bounds))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of data[starts[i]:ends[i]]; spans follow each other and don't overlap."""
    hashes = np.empty(len(starts), U64)
    table = _TABLES[lower]
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        hashes[at:to] = _hash_chunk(data[low : ends[to - 1]], starts[at:to] - low, ends[at:to] - low, table)
        at = to
    return hashes


def windows(tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n tokens inside a text, and the index of each one's first token."""
    h = tokens.hashes
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    end = np.repeat(tokens.offsets[1:], tokens.counts)
    at = np.flatnonzero(np.arange(len(h)) + n <= end)
    return combine(h, n)[at], at


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of h[i:i + n] for each i, across texts too."""
    total = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        total = total * U64(0xFF51AFD7ED558CCD) + h[k : k + len(total)]
    return mix(total + U64(n))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array (null: empty) and each text's bounds in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES):
    """Parts of a batch with about `most` bytes of text each, as (part, bytes, bounds)."""
    data, bounds = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1))
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as int64, as Spark's long holds them."""
    return h.view(np.int64)
