"""Words and word n-grams of whole Arrow columns as 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text with A-Z lowered. All
functions take and return numpy arrays; a batch is worked in windows that end at white space, so peak
memory follows the window and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: White space and ASCII punctuation.
LOOSE = WHITE.copy()
LOOSE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), vectorised."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_weights = mix(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def position_weights(n: int) -> np.ndarray:
    """Odd 64-bit multipliers for byte positions 0..n-1 of a word."""
    global _weights
    if n > len(_weights):
        size = 1 << n.bit_length()
        _weights = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _weights[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    base = int(offsets[0])
    raw = np.frombuffer(data, np.uint8)[base : int(offsets[-1])] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - base


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "_text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches cut to runs of rows with about ``most`` bytes of text, one row at least: bounds what a step holds."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _windows(raw: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Spans of about ``window`` bytes that end before white space or at the end."""
    at = 0
    while at < len(raw):
        end = min(at + window, len(raw))
        step = 4096
        while end < len(raw) and not WHITE[raw[end]]:
            hits = np.flatnonzero(WHITE[raw[end : end + step]])
            end = end + int(hits[0]) if len(hits) else min(end + step, len(raw))
        yield at, end
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n+1 offsets of each row's words; ``white`` marks the bytes between words."""
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    hashes, starts = [], []
    for a, b in _windows(raw, window):
        piece = raw[a:b]
        inside = ~white[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[a + 1 : b]
        where = np.flatnonzero(first)
        if not len(where):
            continue
        kept = np.cumsum(inside)[where] - 1
        data = LOWER[piece[inside]]
        sizes = np.diff(np.append(kept, len(data)))
        place = np.arange(len(data)) - np.repeat(kept, sizes)
        weights = position_weights(int(sizes.max()))
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * weights[place], kept)
        hashes.append(mix(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        starts.append(where + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def _row_ends(bounds: np.ndarray, n_words: int) -> np.ndarray:
    """For each word the end of its row's words."""
    return np.repeat(bounds[1:], np.diff(bounds))[:n_words]


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int, short_rows: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word n-grams in order, and their n+1 offsets.

    ``short_rows``: a row with 1 to n-1 words has its whole sequence as its one n-gram.
    """
    total = len(words)
    ends = _row_ends(bounds, total)
    at = np.arange(total)
    full = at + n <= ends
    grams = words.copy()
    for j in range(1, n):
        grams[: max(total - j, 0)] = mix(grams[: max(total - j, 0)] * np.uint64(0x9E3779B97F4A7C15) + words[j:])
    keep = full
    if short_rows and n > 1:
        sizes = np.diff(bounds)
        for row in np.flatnonzero((sizes > 0) & (sizes < n)):
            start, size = int(bounds[row]), int(sizes[row])
            value = words[start : start + 1].copy()
            for j in range(1, size):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + words[start + j])
            grams[start] = mix(value ^ np.uint64(0xA5A5A5A5 + size))[0]
            keep[start] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], counts[bounds]
