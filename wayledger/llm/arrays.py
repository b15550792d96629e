"""Vectorised word hashing for Arrow string columns.

A word is a maximal run of ASCII letters, digits and underscores or of any characters beyond ASCII, in the lower-cased text.  Words
are represented by 64-bit hashes; ``word_hashes`` finds and hashes the words of many texts with a few numpy passes over their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyz":
    WORD_BYTE[_c] = True

_ODD = 0x9E3779B97F4A7C15  # any odd number has an inverse modulo 2**64
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {_ODD: np.ones(1, np.uint64), pow(_ODD, -1, 1 << 64): np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for later calls up to a bound."""
    have = _powers.get(base, np.ones(1, np.uint64))
    if len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def plain_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` that hold about SLICE_BYTES each."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else np.zeros(0, np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield start, stop
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each text starts (with the end as the last entry)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words start (with the end as the last entry)."""
    raw, starts = text_bytes(pc.utf8_lower(column))
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    inside = WORD_BYTE[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cut = starts[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    joined = cut[inside[cut] & inside[cut - 1]]  # a word that ends one text beside one that starts the next
    edges = np.flatnonzero(edge)
    if len(joined):
        edges = np.sort(np.concatenate([edges, np.repeat(np.unique(joined), 2)]))
    first, last = edges[0::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[raw] * powers(_ODD, len(raw)), out=sums[1:])
    h = (sums[last] - sums[first]) * powers(pow(_ODD, -1, 1 << 64), len(raw))[first]
    return mix64(h + (last - first).astype(np.uint64)), np.searchsorted(first, starts)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word n-grams of each text, sorted, and where each text's set starts (with the end as the last entry).

    A text with fewer than n words but at least one has one n-gram, all its words; a text without words has none."""
    words, starts = word_hashes(column)
    counts = np.diff(starts)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for size in range(1, n + 1):
        texts = np.flatnonzero(counts >= n if size == n else counts == size)
        if not len(texts):
            continue
        room = counts[texts] - size + 1
        at = np.repeat(starts[:-1][texts] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
        h = np.full(len(at), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[at + k]
        parts.append((mix64(h), np.repeat(texts, room)))
    h, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.searchsorted(text[keep], np.arange(len(column) + 1))
