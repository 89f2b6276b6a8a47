"""NumPy kernels over Arrow string buffers.

Every kernel works on a block of whole texts laid end to end as bytes, with one
offset per text, so that no Python object is made for each text or word. Blocks
hold a bounded number of bytes (or one longer text), which bounds memory.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]

#: The ASCII white space of the word rule: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def utf8(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block whose malformed sequences are U+FFFD, as Python's decoder replaces them in each text by itself. Spark does not check the bytes of
    its strings, so a text may be cut inside a character. A well-formed block is returned as it is."""
    raw = data.tobytes()
    if not ((data[offsets[:-1][np.diff(offsets) > 0]] & 0xC0) == 0x80).any():  # no text goes on with a character of the one before
        with contextlib.suppress(UnicodeDecodeError):
            raw.decode()
            return data, offsets
    texts = [raw[a:b].decode(errors="replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most `most` bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _BASE + _U(seed)) | _U(1)


_BYTE = constants(256, 11)[LOWER]
_BYTE_CASED = constants(256, 11)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse. Those for a block are kept; those for a longer text are not."""
    if len(_POW[0]) >= n + 1:
        return _POW[0], _POW[1]
    out = []
    for base in (_BASE, _BASE_INV):
        steps = np.full(max(n, BLOCK_BYTES) + 1, base, _U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    if n <= BLOCK_BYTES:
        _POW[:] = out
    return out[0], out[1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each span, from one running polynomial sum."""
    up, down = _powers(len(values))
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the longest runs of bytes for which `inside` holds, cut where texts end; text i has runs first[i]:first[i+1]."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | cut[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | cut[1:n]
    start = np.flatnonzero(head)
    return start, np.flatnonzero(tail) + 1, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): spans of `[^\\x20\\x09-\\x0D]+` in a block; text i has words first[i]:first[i+1]."""
    return spans(~SPACE[data], offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct k-word shingles of each text, sorted; text i has hashes first[i]:first[i+1].

    A text of fewer words gives its whole word sequence as one shingle; one without words gives none.
    """
    start, end, first = words(data, offsets)
    h = span_hashes(_BYTE[data], start, end)
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_first = np.concatenate([[0], np.cumsum(m)])
    if not len(h):
        return np.zeros(0, _U), out_first
    combined = h.copy()
    padded = np.concatenate([h, np.zeros(k, _U)])
    for j in range(1, k):
        combined = mix(combined * _U(0x9FB21C651E98DF25)) + padded[j : j + len(h)]
    combined = mix(combined)
    pick = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], m)
    out = combined[pick]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = h[first[i] : first[i] + 1]
        for j in range(1, n[i]):
            x = mix(x * _U(0x9FB21C651E98DF25)) + h[first[i] + j]
        out[out_first[i]] = mix(x ^ _U(int(n[i]) * 0x51ED270B0B1D31))[0]
    ends = out_first.tolist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    heads = out_first[:-1][m > 0]
    keep[heads] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[out_first]


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, empty: float | int) -> np.ndarray:
    """ufunc over values[first[i]:first[i+1]] for each i, `empty` for an empty range."""
    out = np.full(len(first) - 1, empty, values.dtype)
    full = np.diff(first) > 0
    if full.any():
        out[full] = ufunc.reduceat(values, first[:-1][full])
    return out
