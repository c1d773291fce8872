"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Used inside mapInArrow. A batch is handled in slices of bounded bytes, so memory stays bounded by a slice, or by the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and all bytes of other scripts
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """The words of the texts of one slice: bytes start:end of data, text number doc (from 0), in order."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    n_docs: int

    def first(self) -> np.ndarray:
        """Where each text's words begin in the word arrays, and at last where they end."""
        return np.searchsorted(self.docs, np.arange(self.n_docs + 1))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts take about limit bytes; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at, before = 0, 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        before, at = int(total[to - 1]), to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and len + 1 offsets; null as the empty text."""
    texts = pa.concat_arrays([pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")])
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array, is_word: np.ndarray, lower: bool = True) -> Words:
    data, offsets = bytes_of(texts)
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    n = len(data)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, starts, ends, docs, len(texts))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base & (2**64 - 1), dtype=np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, taken from prefix sums, then mixed."""
    out = np.empty(len(w.starts), dtype=np.uint64)
    at = 0
    while at < len(out):
        lo = w.starts[at]
        to = max(at + 1, int(np.searchsorted(w.ends, lo + SLICE_BYTES, "right")))
        piece = w.data[lo : w.ends[to - 1]]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(piece)), out=sums[1:])
        a, b = w.starts[at:to] - lo, w.ends[at:to] - lo
        out[at:to] = (sums[b] - sums[a]) * powers(pow(_BASE, -1, 2**64), len(piece))[a]
        at = to
    return mix(out)


def runs(values: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each n consecutive values."""
    m = len(values) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out += values[j : j + m] * np.uint64(pow(base, j + 1, 2**64))
    return mix(out)
