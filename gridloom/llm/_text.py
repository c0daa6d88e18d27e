"""Array kernels over UTF-8 text buffers: words, hashes, shingles.

A batch of texts is one byte buffer with row offsets, so every step is a NumPy
pass over bytes or words; nothing here loops over characters. Chunks are cut
at about ``CHUNK`` bytes, which bounds the temporaries whatever the batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (fixed constants), on uint64 arrays."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = splitmix(np.arange(256, dtype=np.uint64))
_M = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW, _INV = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, m in ((_POW, _M), (_INV, pow(_M, -1, 1 << 64))):
            out[0], have = 1, 1
            while have < size:
                step = _U(pow(m, have, 1 << 64))
                out[have : 2 * have] = out[: min(have, size - have)] * step
                have *= 2
    return _POW, _INV


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    off = off[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size`` bytes."""
    raw, off = buffers(texts)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def class_table(allowed: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(allowed)] = True
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case ASCII letters and every byte of a non-ASCII character.
WORD = class_table(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
#: All bytes but the six ASCII spaces: runs are the words that sizes count.
NONSPACE = class_table(bytes(x for x in range(256) if x not in (9, 10, 11, 12, 13, 32)))


def spans(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the maximal runs of ``table`` within rows, and runs before each row."""
    ok = table[raw]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = ok[edges]
    last[edges - 1] = ok[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one running sum."""
    power, inverse = _powers(len(raw) + 1)
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=run[1:])
    return splitmix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, word starts, word ends, words before each row, and word hashes."""
    low = LOWER[raw]
    start, end, first = spans(low, off, WORD)
    return low, start, end, first, span_hashes(low, start, end)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` neighbours of ``h`` (rows' ends are not minded here)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= _U(0xF1357AEA2E62A9C5)
        out += h[k : k + m]
    return splitmix(out)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of ``n`` consecutive words.

    A text of 1 to n-1 words has one shingle, all its words; one of no words has none.
    """
    for a, b, raw, off in chunks(texts):
        _, _, _, first, h = words(raw, off)
        win = windows(h, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(win[lo : hi - n + 1])
            elif hi > lo:
                yield windows(h[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, np.uint64)
