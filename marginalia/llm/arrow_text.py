"""Byte-level views of Arrow text columns and the hashes the operators share.

Everything here works on the UTF-8 bytes of a whole batch at once, so that
the per-document cost is a few numpy passes and no Python string is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the rolling hash; its inverse modulo 2**64 undoes a shift.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges (lo, hi) of documents with about ``most`` bytes, one document at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 20, 1 << int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * BASE**k over i <= k < j."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + U(1)) * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes and length, wherever the span stands."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def table(lower: bool, other_than: bytes | None = None, spaces: bytes = b"") -> np.ndarray:
    """A byte map: A-Z lower-cased; bytes that are no word bytes become spaces."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    if other_than is not None:
        keep = np.zeros(256, bool)
        keep[np.frombuffer(other_than, np.uint8)] = True
        out[~keep] = 32
    if spaces:
        out[np.frombuffer(spaces, np.uint8)] = 32
    return out


#: After A-Z are lower-cased: words are runs of digits, a-z and bytes beyond ASCII.
WORD_BYTES = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
ALNUM_TABLE = table(True, WORD_BYTES)
#: Words are runs of anything but space, tab, LF, VT, FF and CR.
SPACE_TABLE = table(True, spaces=b"\t\n\x0b\x0c\r")


def words(data: np.ndarray, offsets: np.ndarray, mapped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word bounds, and of each document its first word's number.

    ``first`` has one entry more than there are documents. Words end with their document.
    """
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = mapped[data] != 32
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begin[edge] |= inside[edge]
    starts = np.flatnonzero(begin)
    stop = inside[:n] & ~inside[1:]
    stop[edge - 1] |= inside[edge - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)
