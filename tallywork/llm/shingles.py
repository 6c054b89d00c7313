"""Word shingles as sets of 64-bit hashes, computed for many texts at once.

A word is a maximal run of bytes other than ASCII white space, with A-Z in lower case. Word hashes are polynomials over
a random table of bytes, taken from differences of one running sum per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that one chunk holds (a longer text is a chunk of its own).
CHUNK = 1 << 18

_RNG = np.random.default_rng(7919)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[np.arange(65, 91)] = _TABLE[np.arange(97, 123)]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        out = np.full(max(n, CHUNK + 65_536), base, np.uint64)
        out[0] = 1
        held = np.multiply.accumulate(out)
        if len(held) <= 8 * CHUNK:
            _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield first, held
            held, size, first = [], 0, k
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words start among them (with the end as last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_INVERSE, len(data))[starts])
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted; fewer words than ``words`` make one shingle, none make none."""
    for _, chunk in _chunks(texts):
        hashes, bounds = word_hashes(chunk)
        mixed = np.zeros(0, np.uint64)
        if len(hashes) >= words:
            mixed = np.zeros(len(hashes) - words + 1, np.uint64)
            for k in range(words):
                mixed = mix(mixed * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + len(mixed)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(mixed[a : b - words + 1])
            elif b > a:
                one = np.full(1, 1 + b - a, np.uint64)
                for h in hashes[a:b]:
                    one = mix(one * np.uint64(0xD6E8FEB86659FD93) + h)
                yield one
            else:
                yield np.zeros(0, np.uint64)
