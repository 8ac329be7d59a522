"""Vectorised byte kernels that work on Arrow string buffers without making Python strings.

Every kernel sees a *chunk*: the bytes of some consecutive rows and their offsets.  Chunks end
at row borders and hold about ``CHUNK`` bytes (a longer text is a chunk of its own), so that a
task's memory follows the longest text and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a uint64 array."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random 64-bit value for each byte value.
BYTE_VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_BASE))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space separates, and of words of ASCII letters, digits and all non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(max(n, CHUNK * 2), base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    out = _powers[0][:n], _powers[1][:n]
    if n > 8 * CHUNK:  # a very long text: don't keep its tables
        _powers[0], _powers[1] = np.ones(1, U64), np.ones(1, U64)
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n + 1 offsets and null flags of a string or binary array; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    nulls = np.zeros(n, bool) if column.null_count == 0 else column.is_null().to_numpy(zero_copy_only=False)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), nulls
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if nulls.any():
        lens = np.diff(at)
        if lens[nulls].any():
            keep = np.repeat(~nulls, lens)
            raw = raw[at[0] : at[-1]][keep]
            lens[nulls] = 0
            at = np.concatenate([[0], np.cumsum(lens)])
    return raw, at, nulls


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0, null flags) of consecutive rows of about ``limit`` bytes."""
    raw, at, nulls = string_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], nulls[lo:hi]
        lo = hi


def word_spans(buf: np.ndarray, at: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``in_word`` bytes that stays in one row, and each row's first word (n + 1)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = in_word[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """n + 1 running sums from which span_hash gets the hash of any span."""
    up, _ = powers(max(1, len(buf)))
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, the same wherever a span stands."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def join_hash(*parts: np.ndarray) -> np.ndarray:
    """One hash of several hashes in order."""
    out = np.full(len(parts[0]), 0x2545F4914F6CDD1D, U64)
    for p in parts:
        out = mix(out * U64(_BASE) + p)
    return out


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words."""
    return join_hash(*(words[i : len(words) - n + 1 + i] for i in range(n))) if len(words) >= n else np.zeros(0, U64)


def row_of(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each position, for offsets with empty rows."""
    return np.searchsorted(at, positions, side="right") - 1
