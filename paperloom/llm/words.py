"""Vectorised cutting and hashing of texts: words, lines and windows over Arrow buffers.

Texts are handled in slices of a bounded number of bytes, so memory does not depend on the size
of a batch, only on the longest single text. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
#: Bytes of words: all but space and the controls from tab to carriage return.
WORD_BYTE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LINE_BYTE = _BYTES != 0x0A
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text; a longer text stands alone."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings or binaries, and where each value starts and ends."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (the finishing steps of a well-known hash function)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Spans:
    """The words or lines of several texts: ``starts`` and ``ends`` in ``data``; text i owns
    the spans ``first[i]`` up to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside_byte: np.ndarray = WORD_BYTE):
        self.data, self.off = data, off
        inside = inside_byte[data]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        full = off[1:] > off[:-1]
        heads, tails = off[:-1][full], off[1:][full] - 1
        opens[heads], closes[tails] = inside[heads], inside[tails]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        left = self.ends - self.starts
        out = mix(left.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        at, rows = self.starts, None
        while len(at):
            part = mix((eights[at] & _MASKS[np.minimum(left, 8)]) ^ (out if rows is None else out[rows]))
            if rows is None:
                out = part
            else:
                out[rows] = part
            more = np.flatnonzero(left > 8)
            rows = more if rows is None else rows[more]
            at, left = at[more] + 8, left[more] - 8
        return out


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive values, built by doubling; runs that cross
    from one text into the next must be masked by the caller (see ``whole``)."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, hashes, 1
    n = len(hashes) - length + 1
    while True:
        if length & size:
            piece = power[done : done + n]
            out = piece.copy() if out is None else mix(out * np.uint64(0x9FB21C651E98DF25) + piece)
            done += size
        if done == length:
            return out
        power = mix(power[:-size] * np.uint64(0xD6E8FEB86659FD93) + power[size:])
        size *= 2


def whole(spans: Spans, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``length`` spans that stay in one text, and each window's text."""
    counts = np.maximum(spans.counts - length + 1, 0)
    texts = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return spans.first[texts] + within, texts


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between offsets, as 64-bit integers or floats."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def covered(marks: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``length`` that starts at a mark."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, marks, 1)
    np.add.at(steps, np.minimum(marks + length, size), -1)
    return np.cumsum(steps[:-1]) > 0
