"""Vectorised word kernels over Arrow string columns.

Texts are handled whole, as UTF-8 bytes. A word is a maximal run of bytes that are not one of the
six ASCII white-space characters (space, \\t, \\n, \\v, \\f, \\r), unless another byte class is given.
Word and window identities are polynomial fingerprints modulo 2**64 over a random byte table,
finished by a 64-bit mixer; prefix sums make every word and every window a constant number of
array operations, so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = (
    mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)),
    mix(np.arange(1001, 1257, dtype=U64) * U64(0x9E3779B97F4A7C15)),
)


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES // 4, 2 * len(have[0]) if have else 0)
        base = BASES[which]
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[which] = (both[0], both[1])
    return have


def release() -> None:
    """Give memory back to the system at the end of a task: idle workers of earlier stages stay alive beside later ones."""
    import ctypes
    import gc

    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of a few texts. first[i]:first[i + 1] are the words of text i; begin and end are byte places in data."""

    data: np.ndarray
    text_begin: np.ndarray
    text_end: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def fingerprints(self, which: int = 0) -> np.ndarray:
        return span_fingerprints(self.data, self.begin, self.end, which)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins and ends there."""
        size = self.end - self.begin
        end = np.cumsum(size + 1) - 1
        begin = end - size
        out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.begin] = 1
        inside[self.end] = -1
        mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        target = np.ones(len(out), dtype=bool)
        target[end] = False
        out[target] = self.data[mask]
        return out, begin, end


def span_fingerprints(data: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each byte span."""
    if not len(begin):
        return np.zeros(0, dtype=U64)
    up, down = powers(len(data) + 1, which)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[which][data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_fingerprints(values: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each run of `width` consecutive values (text borders are not looked at)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:n]) * down[:n] + U64(width))


def run_fingerprints(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of each run values[begin:end]."""
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """True at each word where a window of `width` words of one text starts."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(n) + width <= last


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes together; a longer text stands alone and stays whole."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends) of the texts with one line break after each, which keeps neighbours apart."""
    texts = len(offsets) - 1
    out = np.full(len(data) + texts, 0x0A, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    end = offsets[1:] + np.arange(texts)
    keep[end] = False
    out[keep] = data
    return out, offsets[:-1] + np.arange(texts), end


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE, fold: np.ndarray | None = None, refine: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; `breaks` says which bytes part words, `fold` maps bytes first.

    `refine` may map the bytes again and cut words further: it gets all bytes and gives them back with
    True at each byte that starts a new part if it stands inside a word.
    """
    offsets = offsets - offsets[0]
    if fold is not None:
        data = fold[data]
    parted, text_begin, text_end = spread(data, offsets)
    gap = breaks[parted]
    gap[text_end] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if refine is not None:
        parted, cut = refine(parted)
        cut[1:] &= ~gap[1:] & ~gap[:-1]
        cut[:1] = False
        at = np.flatnonzero(cut)
        begin, end = np.sort(np.concatenate([begin, at])), np.sort(np.concatenate([end, at]))
    first = np.concatenate(([0], np.searchsorted(begin, text_end)))
    return Words(parted, text_begin, text_end, begin, end, first)


def of_array(texts: pa.Array, breaks: np.ndarray = WHITE, fold: np.ndarray | None = None, limit: int = CHUNK_BYTES, refine: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[int, int, Words]]:
    """Words of a string column, chunk by chunk: (from, to, words)."""
    data, offsets = flat_bytes(texts)
    for a, b in chunks(offsets, limit):
        yield a, b, words(data[offsets[a] : offsets[b]], offsets[a : b + 1], breaks, fold, refine)


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] places, then the same for each next one."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    skip = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size)
    return np.arange(total, dtype=np.int64) + skip


def binary_array(flat: np.ndarray | bytes, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(flat)])
