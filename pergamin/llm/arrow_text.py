"""UTF-8 text of Arrow batches as flat numpy arrays.

Every operator that scans characters in Python works on these arrays, a few million bytes at a time, so memory depends on
neither the number of rows of a batch nor the length of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
SLICE_BYTES = 3_000_000


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and n+1 offsets from 0; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if column.null_count and (np.diff(offsets)[~np.asarray(column.is_valid())] > 0).any():
        return flat_utf8(column.fill_null(""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about ``limit`` bytes; every row is in exactly one."""
    rows, start = len(offsets) - 1, 0
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of every character and the position of its first byte, for valid UTF-8."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    points = lead.copy()
    for low, high, more, mask in ((0xC0, 0xE0, 1, 0x1F), (0xE0, 0xF0, 2, 0x0F), (0xF0, 0xF8, 3, 0x07)):
        which = np.flatnonzero((lead >= low) & (lead < high))
        if len(which):
            value = lead[which] & mask
            for k in range(1, more + 1):
                value = (value << 6) | (data[at[which] + k] & 0x3F)
            points[which] = value
    return points, at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges [start, start + length), one range after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


# White space of one byte, and of two and three bytes in UTF-8.
BLANK_BYTES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
BLANK_PAIRS = (0x85, 0xA0)
BLANK_TRIPLES = {0xE1: ((0x9A, range(0x80, 0x81)),), 0xE2: ((0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, range(0x9F, 0xA0))), 0xE3: ((0x80, range(0x80, 0x81)),)}


def blanked(data: np.ndarray) -> np.ndarray:
    """The bytes with white space of several bytes written as so many plain blanks."""
    high = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    if not len(high):
        return data
    out, n = data.copy(), len(data)
    lead, second = data[high], data[np.minimum(high + 1, n - 1)]
    pair = high[(lead == 0xC2) & np.isin(second, BLANK_PAIRS)]
    out[pair] = out[pair + 1] = 0x20
    third = data[np.minimum(high + 2, n - 1)]
    for first, rows in BLANK_TRIPLES.items():
        for two, threes in rows:
            at = high[(lead == first) & (second == two) & np.isin(third, list(threes))]
            out[at] = out[at + 1] = out[at + 2] = 0x20
    return out


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of all texts as ``str.split`` gives them, one after another; the first token of every text (n+1); and whether
    a line or a text begins between a token and the one before it. A token is never cut, however long."""
    data = blanked(data)
    solid = ~BLANK_BYTES[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    starts = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | opens[:-1])) if len(data) else np.zeros(0, np.int64)
    kept = np.append(0, np.cumsum(solid))
    bounds = np.append(kept[starts], kept[-1]).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    first = np.searchsorted(starts, offsets)
    lines = np.cumsum(data == 10)[starts] if len(starts) else starts
    breaks = np.diff(lines, prepend=-1) != 0
    breaks[first[:-1][first[:-1] < len(starts)]] = True
    return tokens, first, breaks
