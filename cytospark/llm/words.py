"""Words, lines and their hashes straight from Arrow's string buffers, without a loop over texts.

A segment's hash takes eight bytes at a time into a chain of mixing steps that aren't linear, so no
pattern of bytes makes two segments meet; two of any two have one hash with a chance near 2^-64, and
with two seeds near 2^-128. Where a result must be exact, `numbered` and `equal` compare the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 20
#: Longer segments are hashed and compared one by one.
LONG = 256
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: The six white-space bytes of `[\x20\x09-\x0D]`.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
NOT_NEWLINE = np.arange(256) != 0x0A
#: Letters, digits and whatever isn't ASCII.
WORDLIKE = np.array([chr(i).isalnum() or i >= 0x80 for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA5CB9243D1F9E64B)
    x ^= x >> np.uint64(32)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first row, row after the last, bytes, offsets."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def segments(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are ``inside``; a text's edge ends a run."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = inside[data]
    first, last = k.copy(), k.copy()
    first[1:] &= ~k[:-1]
    last[:-1] &= ~k[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] |= k[edge]
    last[edge - 1] |= k[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros stand after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each segment; ``view`` is `eights` of the data, where it is at hand."""
    view, size = eights(data) if view is None else view, ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F + 2 * seed * 0x165667B19E3779F9 & (1 << 64) - 1))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        out[todo] = mix((out[todo] ^ (view[at] & _KEEP[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15 + seed))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[k] = int.from_bytes(digest, "little")
    return out


def equal(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """Whether so many bytes of a and of b, from these places on, are the same; ``view`` is `eights` of a, where it is at hand."""
    va, vb, out = eights(a) if view is None else view, eights(b), np.ones(len(size), bool)
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    x, y, left = a_at[todo], b_at[todo], size[todo]
    while len(todo):
        ok = (va[x] ^ vb[y]) & _KEEP[np.minimum(left, 8)] == 0
        out[todo[~ok]] = False
        more = ok & (left > 8)
        todo, x, y, left = todo[more], x[more] + 8, y[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = np.array_equal(a[a_at[k] : a_at[k] + size[k]], b[b_at[k] : b_at[k] + size[k]])
    return out


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """A number for each segment, the same for the same bytes and for no others."""
    h = hashes(data, starts, ends) if h is None else h
    own, first, back = np.unique(h, return_index=True, return_inverse=True)
    size, one = ends - starts, first[back]
    odd = np.flatnonzero((size != size[one]) | ~equal(data, starts, data, starts[one], np.minimum(size, size[one])))
    more: dict[bytes, int] = {}
    for k in odd.tolist():
        back[k] = len(own) + more.setdefault(data[starts[k] : ends[k]].tobytes(), len(more))
    return back


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` neighbouring hashes, in order."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out + h[k : k + n])
    return out


def per_text(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets of each text's segments among all."""
    return np.searchsorted(starts, off)


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points stand before each byte, and at the end."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
