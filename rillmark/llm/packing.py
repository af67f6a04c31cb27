"""Simple-8b: integers packed into 64-bit words, each with a 4-bit selector."""

from __future__ import annotations

import numpy as np

# Fixed values of the published code: how many values of how many bits a word of each selector holds.  Selector 0 is
# used as the escape here: the word behind it is one plain value.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
# Values of a frame; every frame begins a new word, whose offset is kept.
FRAME = 1024


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned values, and the offset of every frame's first word.

    In each word the greediest selector is taken; words at the end of a frame may be filled up with zeros.  All
    frames are packed side by side, a word of each at a time.
    """
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    frames = -(-n // FRAME)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.zeros((frames, FRAME), np.uint64 if values.max() >> np.uint64(32) else np.uint32)
    grid.ravel()[:n] = values
    choice = np.zeros((frames, FRAME), np.uint8)
    for selector in range(len(COUNTS) - 1, 0, -1):
        width, count = int(WIDTHS[selector]), int(COUNTS[selector])
        fits = grid < (1 << width) if width < 8 * grid.itemsize else np.ones(grid.shape, bool)
        reach = 1
        while reach < count:  # all of the next `count` values, by doubling; the end of a frame fits
            step = min(reach, count - reach)
            fits[:, :-step] &= fits[:, step:].copy()
            reach += step
        np.copyto(choice, selector, where=fits)
    choice = choice.ravel()
    place = np.arange(frames) * FRAME
    limit = np.minimum(place + FRAME, n)
    begins = np.zeros(n, bool)
    while len(place):
        begins[place] = True
        place = place + COUNTS[choice[place]]
        inside = place < limit
        place, limit = place[inside], limit[inside]
    place = np.flatnonzero(begins)
    chosen = choice[place]
    padded = np.concatenate((values, np.zeros(int(COUNTS.max()), np.uint64)))
    limit = np.minimum((place // FRAME + 1) * FRAME, n)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        if selector <= 1:  # an escape's value follows below; zeros need no bits
            continue
        own = np.flatnonzero(chosen == selector)
        for k in range(int(COUNTS[selector])):
            spot = place[own] + k
            words[own] |= np.where(spot < limit[own], padded[spot], np.uint64(0)) << np.uint64(k * int(WIDTHS[selector]))
    first = np.searchsorted(place, np.arange(frames) * FRAME)
    escapes = np.flatnonzero(chosen == ESCAPE)
    if len(escapes):
        first = first + np.searchsorted(escapes, first)
        words = np.insert(words, escapes + 1, values[place[escapes]])
    return words, first.astype(np.int64)


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of all frames, selector by selector."""
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), bool)
    after = -1
    for at in np.flatnonzero(selectors == ESCAPE).tolist():
        if at != after:  # not itself the value of an escape
            after = at + 1
            plain[after] = True
    heads = np.flatnonzero(~plain)
    counts = COUNTS[selectors[heads]]
    frame = np.searchsorted(first, heads, "right") - 1
    begun = np.cumsum(counts) - counts
    place = frame * FRAME + begun - begun[np.searchsorted(heads, first)][frame]
    limit = np.minimum((frame + 1) * FRAME, n)
    out = np.zeros(n, np.uint64)
    for selector in np.unique(selectors[heads]):
        own = np.flatnonzero(selectors[heads] == selector)
        spot, word, stop = place[own], words[heads[own]], limit[own]
        if selector == ESCAPE:
            out[spot] = words[heads[own] + 1]
            continue
        if selector == 1:
            continue
        width = int(WIDTHS[selector])
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[selector])):
            inside = spot + k < stop
            out[spot[inside] + k] = (word[inside] >> np.uint64(k * width)) & mask
    return out
