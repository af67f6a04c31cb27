"""Words and shingles of Arrow text columns as flat numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes, with A-Z lower-cased.  Hashes are 64-bit: two different
shingles of one comparison share a hash with a chance of about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = 0x9E6C_63D0_876A_9A35
_M = (1 << 64) - 1
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_VALUE = np.where(_IS_WORD, mix((_FOLD + 1).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1), np.uint64(0))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about a megabyte: first row, bytes, offsets within them."""
    flat, offsets = text_buffer(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(n, max(first + 1, last))
        at = offsets[first : last + 1]
        yield first, flat[at[0] : at[-1]], at - at[0]
        first = last


def word_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every row the index of its first word (one more at the end)."""
    inside = _IS_WORD[flat]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[:1] = False
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1:] = False
    after[filled[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of every word's folded bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(flat))
    sums = np.add.reduceat(_VALUE[flat] * up[: len(flat)], starts)
    return mix(sums * down[starts])


def sequence_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbouring words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[k : n + k]
    return mix(total)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every row: runs of ``width`` words, or the whole of a shorter row."""
    starts, _, first = word_bounds(flat, offsets)
    hashes = word_hashes(flat, starts)
    runs = sequence_hash(hashes, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(sequence_hash(hashes[a:b], b - a) if b > a else hashes[a:b])
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed integers."""
    one = mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(own + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(mix(one.reshape(1))[0].view(np.int64)), int(two.view(np.int64))


def segment_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of many segments at once: (segment, hash), sorted by both."""
    starts, _, first = word_bounds(flat, offsets)
    hashes = word_hashes(flat, starts)
    count = np.diff(first)
    of_word = np.repeat(np.arange(len(count)), count)
    runs = sequence_hash(hashes, width)
    whole = np.flatnonzero(np.arange(len(runs)) + width <= first[1:][of_word[: len(runs)]])
    segment, found = [of_word[whole]], [runs[whole]]
    for size in range(1, width):
        short = np.flatnonzero(count == size)
        if len(short):
            segment.append(short)
            found.append(sequence_hash(hashes, size)[first[:-1][short]])
    segment, found = np.concatenate(segment), np.concatenate(found)
    order = np.argsort(found)
    narrow = np.uint16 if len(count) <= 1 << 16 else np.int64
    order = order[np.argsort(segment[order].astype(narrow), kind="stable")]
    segment, found = segment[order], found[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (segment[1:] != segment[:-1]) | (found[1:] != found[:-1])
    return segment[fresh], found[fresh]


def segment_fingerprints(begin: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``fingerprint`` of every non-empty segment, given where its hashes begin."""
    one = np.add.reduceat(mix(found ^ np.uint64(0x5851F42D4C957F2D)), begin)
    two = np.add.reduceat(mix(found + np.uint64(0x14057B7EF767814F)), begin)
    return mix(one).view(np.int64), two.view(np.int64)
