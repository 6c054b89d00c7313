"""Suffix arrays of byte strings by two-stage sorting, with common prefixes cut off at a fixed depth.

A suffix is of type B if it is smaller than its successor, else of type A. Only type B suffixes are sorted directly (by
their first ``depth`` bytes). All others follow from scans of the buckets of first bytes, from the smallest bucket up:
the suffix before each scanned one, if of type A, goes to the next free place of its own bucket. A bucket's A part is
scanned in waves, since scanning it adds to it where bytes repeat; each wave is one vector operation.

Where only some suffixes are wanted, those between a wanted one and the next of type B take part too, as induction needs
them, and no others.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian integer (zeros beyond the end)."""
    out = np.zeros(len(text) + 8, np.uint64)
    out[: len(text)] = text
    for shift in (1, 2, 4):
        out[: len(out) - shift] = (out[: len(out) - shift] << np.uint64(8 * shift)) | out[shift:]
    return out[: len(text)]


def types(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their successors (the end of the text is smallest)."""
    last = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    smaller = np.zeros(len(last), bool)
    smaller[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    return np.repeat(smaller, np.diff(np.concatenate([[-1], last])))


def sort_directly(starts: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their first ``depth`` bytes; only ties are compared further."""
    padded = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    starts = starts[np.argsort(padded[starts])]
    new = np.concatenate([[True], padded[starts[1:]] != padded[starts[:-1]]]) if len(starts) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        group = np.cumsum(new)
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        own, key = group[tied], padded[starts[tied] + at]
        # Two plain sorts, as ``lexsort`` is slower: places of the keys among themselves, then of those within groups.
        by_key = np.argsort(key)
        place = np.empty(len(key), np.int64)
        place[by_key] = np.concatenate([[0], np.cumsum(key[by_key[1:]] != key[by_key[:-1]])])
        order = np.argsort(own * len(key) + place)
        starts[tied] = starts[tied][order]
        key, own = key[order], own[order]
        new[tied] = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
    return starts


def needed(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Wanted suffixes and those after them up to the next of type B."""
    stretch = np.concatenate([[0], np.cumsum(smaller)[:-1]])  # a stretch ends with its type B suffix
    at = np.flatnonzero(wanted)
    first = np.full(stretch[-1] + 1, len(wanted), np.int64)
    np.minimum.at(first, stretch[at], at)
    return np.arange(len(wanted)) >= first[stretch]


def suffix_array(text: np.ndarray, words: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes (of those that take part if some are ``wanted``), by their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    smaller = types(text)
    part = np.ones(n, bool) if wanted is None else needed(wanted, smaller)
    larger = part & ~smaller
    direct = sort_directly(np.flatnonzero(smaller & part), words, depth)
    direct_first = text[direct]
    bucket = np.concatenate([[0], np.cumsum(np.bincount(text[part], minlength=256))])
    free = bucket[:-1].copy()
    array = np.empty(bucket[-1], np.int64)
    n_direct = np.bincount(direct_first, minlength=256)
    edge = np.concatenate([[0], np.cumsum(n_direct)])
    for c in range(256):
        array[bucket[c + 1] - n_direct[c] : bucket[c + 1]] = direct[edge[c] : edge[c + 1]]

    def induce(scanned: np.ndarray) -> None:
        before = scanned - 1
        before = before[before >= 0]
        before = before[larger[before]]
        if not len(before):
            return
        first = text[before]
        order = np.argsort(first, kind="stable")
        counts = np.bincount(first, minlength=256)
        offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
        first = first[order]
        array[free[first] + np.arange(len(first)) - offset[first]] = before[order]
        free[:] += counts

    if larger[n - 1]:
        array[free[text[n - 1]]] = n - 1
        free[text[n - 1]] += 1
    for c in np.flatnonzero(np.diff(bucket)):
        done = bucket[c]
        while done < free[c]:
            done, scanned = free[c], array[done : free[c]]
            induce(scanned)
        induce(array[bucket[c + 1] - n_direct[c] : bucket[c + 1]])
    return array


def common_prefixes(array: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each entry with the one before it, cut off at ``depth`` (first: 0)."""
    padded = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    out = np.zeros(len(array), np.int64)
    live = np.arange(1, len(array))
    for at in range(0, depth, 8):
        if not len(live):
            break
        differ = padded[array[live] + at] ^ padded[array[live - 1] + at]
        equal = np.full(len(live), 8, np.int64)
        for k in range(7, -1, -1):
            equal[(differ >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0] = k
        out[live] += equal
        live = live[equal == 8]
    return np.minimum(out, depth)


def new_prefixes(array: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Which entries do not share their first ``depth`` bytes with the one before (the first doesn't)."""
    padded = np.concatenate([words, np.zeros(depth + 8, np.uint64)])
    out = np.ones(len(array), bool)
    live = np.arange(1, len(array))
    for at in range(0, depth, 8):
        differ = padded[array[live] + at] ^ padded[array[live - 1] + at]
        live = live[differ >> np.uint64(8 * max(0, at + 8 - depth)) == 0]
    out[live] = False
    return out
