"""Words of whole Arrow batches as numpy arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_BLOCK = 1 << 20
#: Bytes up to which words are hashed eight at a time, all at once; longer ones, which are rare, go one by one.
_LONG = 64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
#: A word's last eight bytes or less: which of them belong to it.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MARK = np.zeros(256, np.int64)
_MARK[list(b".,!?;:")] = 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n at least."""
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; null is empty."""
    a = column.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word; data ends in eight bytes that belong to none.

    Eight bytes after the other go through mix64 with what came before, so no two words collide by construction.
    """
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix64((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(_R)))
    for at in range(8, min(_LONG, int(size.max(initial=0))), 8):
        more = np.flatnonzero((size > at) & (size <= _LONG))
        if not len(more):
            break
        h[more] = mix64(h[more] * np.uint64(_R) + (eight[start[more] + at] & _MASK[np.minimum(size[more] - at, 8)]))
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
    return h


def _suffixes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    last = end - _MARK[data[end - 1]]
    first = np.maximum(start, last - 3)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return mix64(eight[first] & _MASK[last - first]) >> np.uint64(52)


class Words:
    """hash, start, end of each word; first[i]: where the words of text i begin. suffix, if asked for: 12 bits of a hash of each word's last three bytes, without a punctuation mark at its end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, suffix: bool = False):
        parts, pos, n = [], 0, len(data)
        while pos < n:  # blocks that end at white space, so that arrays stay small
            end = min(n, pos + _BLOCK)
            while end < n:
                gap = np.flatnonzero(~_SOLID[data[end : end + 4096]])
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(n, end + 4096)
            b = np.zeros(end - pos + 8, np.uint8)
            b[:-8] = LOWER[data[pos:end]] if lower else data[pos:end]
            solid = _SOLID[b]
            solid[-8:] = False
            turn = solid.copy()
            turn[1:] ^= solid[:-1]
            at = np.flatnonzero(turn)  # where words begin and end, in turn
            # a text that begins right after another's last word cuts the run there
            edge = offsets[np.searchsorted(offsets, pos, "right") : np.searchsorted(offsets, end)] - pos
            edge = np.unique(edge[edge > 0])
            edge = edge[solid[edge] & solid[edge - 1]]
            if len(edge):
                at = np.sort(np.concatenate([at, edge, edge]))
            s, e = at[::2], at[1::2]
            parts.append((_hashes(b, s, e - s), s + pos, e + pos, _suffixes(b, s, e) if suffix else s[:0]))
            pos = end
        self.hash = np.concatenate([x[0] for x in parts]) if parts else np.zeros(0, np.uint64)
        self.start = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.int64)
        self.end = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.int64)
        self.suffix = np.concatenate([x[3] for x in parts]) if parts else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.start, offsets)


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` elements of h; none if there are fewer. Runs over two texts are for the caller to leave out.

    Hashes of runs of 1, 2, 4, ... elements are mixed from two of half the length, and those that make up width are mixed in turn.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pair = lambda x, y: mix64(x * np.uint64(_R) + y)
    out, done, size, part = None, 0, 1, h
    while True:
        if width & size:
            out = part[:n] if out is None else pair(out, part[done : done + n])
            done += size
        if done == width:
            return mix64(out ^ np.uint64(width))
        part, size = pair(part[:-size], part[size:]), 2 * size


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """batch in slices of about `most` bytes or one row."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
