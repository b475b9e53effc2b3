"""Word hashes of Arrow string columns, computed over their bytes with numpy (no Python object per word)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer texts are cut at white space.
WINDOW = 1 << 18
_POWERS = 512
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_POWERS, 0x5851F42D4C957F2D, dtype=U))

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def windows(data: np.ndarray, offsets: np.ndarray, space: np.ndarray, size: int = WINDOW):
    """(from, to) ranges of the bytes, cut at text ends or white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:
                after = int(offsets[k + 1])
                gap = np.flatnonzero(space[data[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:  # a word longer than the window
                    gap = np.flatnonzero(space[data[end:after]])
                    end = end + int(gap[0]) + 1 if len(gap) else after
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """Starts and ends of maximal runs of non-space bytes; a text's end ends a word."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ink = ~space[data]
    first = np.empty(len(data), dtype=bool)
    first[0] = True
    np.logical_not(ink[:-1], out=first[1:])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    starts = np.flatnonzero(ink & first)
    last = np.empty(len(data), dtype=bool)
    last[-1] = True
    np.logical_not(ink[1:], out=last[:-1])
    last[inner - 1] = True
    return starts, np.flatnonzero(ink & last) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans are ordered and don't overlap."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    lens = ends - starts
    total = int(lens.sum())
    firsts = np.cumsum(lens) - lens
    within = np.arange(total, dtype=np.int64) - np.repeat(firsts, lens)
    at = np.repeat(starts, lens) + within
    with np.errstate(over="ignore"):
        long = within >= _POWERS
        power = _POW[within % _POWERS]
        if long.any():
            power = np.where(long, mix(power + (within // _POWERS).astype(U)), power)
        value = _BYTES[data[at]] * power
        run = np.concatenate([np.zeros(1, dtype=U), np.cumsum(value, dtype=U)])
        return mix(run[firsts + lens] - run[firsts] + lens.astype(U) * U(0x9E3779B97F4A7C15))


def word_hashes(column: pa.Array, fold: np.ndarray = LOWER, space: np.ndarray = SPACE):
    """(text index, hash) of every word of every text, in order; bytes pass through ``fold`` first."""
    data, offsets = column_bytes(column)
    docs, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U)]
    for lo, hi in windows(data, offsets, space):
        part = fold[data[lo:hi]]
        own = np.clip(offsets, lo, hi) - lo
        starts, ends = word_spans(part, own, space)
        hashes.append(hash_spans(part, starts, ends))
        docs.append(np.searchsorted(offsets, starts + lo, "right") - 1)
    return np.concatenate(docs), np.concatenate(hashes)
