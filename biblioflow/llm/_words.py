"""Vectorised words and word-window hashes over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LONG = 48
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= B
    x ^= x >> np.uint64(27)
    x *= C
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows in them) in chunks of some MB; a null row is empty. A longer text is one chunk."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of bytes other than ASCII white space) and first word of each row, with the total."""
    solid = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes. Words over 48 bytes are hashed one by one."""
    import xxhash

    n = ends - starts
    h = np.full(len(starts), A, np.uint64)
    order = np.argsort(-n, kind="stable")
    sorted_n = -n[order]
    at, acc = starts[order], h[order]
    for k in range(min(LONG, int(n.max(initial=0)))):
        live = int(np.searchsorted(sorted_n, -k, side="left"))  # words longer than k
        acc[:live] = acc[:live] * C + data[at[:live] + k]
    h[order] = acc
    h = mix(h + n.astype(np.uint64) * A)
    for i in np.flatnonzero(n > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * A + (b ^ C))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n-word window of a word-hash sequence by doubling: 1, 2, 4, ... and one overlap for the rest."""
    size = 1
    while size * 2 <= n:
        h = join(h[: max(0, len(h) - size)], h[size:])
        size *= 2
    if size < n:
        rest = n - size
        h = join(h[: max(0, len(h) - rest)], h[rest:])
    return h
