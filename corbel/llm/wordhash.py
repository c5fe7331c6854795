"""Vectorised words and word hashes over the UTF-8 bytes of Arrow string columns.

All word definitions used here split at ASCII bytes only, so they hold on UTF-8 bytes as they do on
code points.  A word's 64-bit hash is a polynomial over random byte values, taken from prefix sums,
so a block of text costs a few numpy passes and no Python work per word.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes, which bounds the scratch arrays.
PIECE_BYTES = 1 << 18
#: Longer words are hashed one by one; they never straddle a piece undecided.
LONG_WORD = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Separators: space and 0x09-0x0D.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Only digits, a-z and bytes of 0x80 and more make words (upper case is folded first).
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + LONG_WORD + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, np.uint64(base), dtype=np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column with A-Z folded, and the offset of every row (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return _LOWER[raw], offsets - offsets[0]


def _piece(buf: np.ndarray, cuts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one piece; no word spans a cut."""
    inside = letters[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(buf))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return starts, ends, hashes


def hash_words(buf: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of the rows that ``offsets`` delimits in ``buf``."""
    found, lo, n = [], 0, len(buf)
    while lo < n:
        hi = min(n, lo + PIECE_BYTES)
        if hi < n:
            # end the piece at a row's start or after the last separator; a word longer than the piece extends it
            row = offsets[np.searchsorted(offsets, hi, side="right") - 1]
            blank = np.flatnonzero(~letters[buf[lo:hi]])
            cut = max(row, lo + blank[-1] + 1 if len(blank) else lo)
            while cut <= lo:
                nxt = np.flatnonzero(~letters[buf[hi : hi + PIECE_BYTES]])
                end = offsets[np.searchsorted(offsets, hi, side="left")] if hi <= offsets[-1] else n
                hi2 = min(n, hi + PIECE_BYTES, int(end))
                if len(nxt) and hi + nxt[0] + 1 <= hi2:
                    cut = hi + int(nxt[0]) + 1
                elif hi2 == end or hi2 == n:
                    cut = hi2
                hi = hi2
            hi = int(cut)
        a, b = np.searchsorted(offsets, [lo, hi])
        s, e, h = _piece(buf[lo:hi], offsets[a : b + 1] - lo, letters)
        found.append((s + lo, e + lo, h))
        lo = hi
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``buf`` that stand in order and do not overlap, as ``hash_words`` gives them."""
    out, lo, n = np.empty(len(starts), np.uint64), 0, len(starts)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    while lo < n:
        hi = int(np.searchsorted(starts, starts[lo] + PIECE_BYTES))
        hi = min(hi, *long[np.searchsorted(long, lo) :][:1].tolist(), n)
        if hi == lo:  # a long one
            digest = hashlib.blake2b(buf[starts[lo] : ends[lo]].tobytes(), digest_size=8).digest()
            out[lo] = int.from_bytes(digest, "little")
            lo += 1
            continue
        base = starts[lo]
        some = buf[base : ends[hi - 1]]
        up, down = _powers(len(some) + 1)
        sums = np.zeros(len(some) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[some] * up[: len(some)], out=sums[1:])
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return out


def row_blocks(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``size`` bytes (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


_SLOT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive word hashes; the width is part of it."""
    width = int(width)
    n = len(words) - width + 1
    if n <= 0 or width < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, width * 0x632BE59BD9B4E019 % (1 << 64), dtype=np.uint64)
    for k in range(width):
        h += words[k : k + n] * _SLOT[k % 64] if k < 64 else mix(words[k : k + n] + np.uint64(k)) * _SLOT[k % 64]
    return mix(h)


def words_by_block(column: pa.Array, letters: np.ndarray) -> Iterator[tuple]:
    """Blocks of rows: first row, end row, folded bytes, first word of every row and the end, starts, ends, hashes."""
    release_memory()
    buf, offsets = lowered(column)
    for lo, hi in row_blocks(offsets):
        base = offsets[lo]
        part, cuts = buf[base : offsets[hi]], offsets[lo : hi + 1] - base
        starts, ends, hashes = hash_words(part, cuts, letters)
        yield lo, hi, part, cuts, np.searchsorted(starts, cuts), starts, ends, hashes


def words_by_row(column: pa.Array, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every row: its number, the folded bytes of its block, and starts, ends and hashes of its words."""
    for lo, hi, part, _, split, starts, ends, hashes in words_by_block(column, letters):
        for i in range(hi - lo):
            a, b = split[i], split[i + 1]
            yield lo + i, part, starts[a:b], ends[a:b], hashes[a:b]
