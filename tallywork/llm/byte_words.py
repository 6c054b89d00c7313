"""Words of many texts at once, straight from the bytes of an Arrow column.

A lookup table turns each UTF-8 byte into its lower-case form or, for a byte between words, into 0; differences of the
mask of word bytes give all starts and ends; and the CRC-32 of all words advances a byte at a time, over all starts
together. Only bytes below 0x80 may stand between words, so words of bytes are words of characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked on together; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: Bytes of a word that advance in step with all others; what a longer word has beyond them goes through zlib.
IN_STEP = 48
START = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    """The table of the reflected polynomial of CRC-32."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> 1), value >> 1).astype(np.uint32)
    return value


TABLE = crc_table()


def byte_classes(between: bytes) -> np.ndarray:
    """Byte -> its form in a word (A-Z lower-cased), 0 for those of ``between``."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    out[list(between)] = 0
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls and the bounds of its texts (one more than texts)."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, bounds) for runs of whole texts of about CHUNK_BYTES."""
    data, bounds = column_bytes(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


class Words:
    """The words of a run of texts: starts, ends and text of each, and the bytes as the classes show them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, classes: np.ndarray):
        self.low = classes[data]
        inside = self.low != 0
        change = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = change == 1, change == -1
        # Two texts may meet inside a stretch of word bytes.
        cuts = bounds[(bounds > 0) & (bounds < len(data))]
        cuts = cuts[inside[cuts - 1] & inside[cuts]]
        starts[cuts] = ends[cuts] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.lengths = self.ends - self.starts
        self.text = np.searchsorted(bounds, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(bounds) - 1)
        self.order = np.argsort(-self.lengths, kind="stable")
        self.sorted_starts = self.starts[self.order]
        steps = min(IN_STEP, int(self.lengths.max(initial=0)))
        self.active = np.searchsorted(-self.lengths[self.order], -np.arange(steps), side="left")

    def advance(self, states: np.ndarray) -> np.ndarray:
        """The CRC states of all words after their bytes (states are not inverted)."""
        state = states[self.order]
        for step, n in enumerate(self.active):
            now = state[:n]
            state[:n] = TABLE[(now ^ self.low[self.sorted_starts[:n] + step]) & 0xFF] ^ (now >> np.uint32(8))
        if len(self.active) == IN_STEP:
            for k in range(int(np.searchsorted(-self.lengths[self.order], -IN_STEP, side="left"))):
                at = self.order[k]
                rest = self.low[self.starts[at] + IN_STEP : self.ends[at]].tobytes()
                state[k] = zlib.crc32(rest, int(~state[k])) ^ 0xFFFFFFFF
        out = np.empty_like(state)
        out[self.order] = state
        return out

    def states(self) -> np.ndarray:
        return self.advance(np.full(len(self.starts), START))

    def longer(self, states: np.ndarray) -> np.ndarray:
        """From the states of runs of words that end at each word: those of the runs, a blank and the next word.

        The state of word k is that of the run ending there; where the run would begin in an earlier text or before
        the first word it means nothing (``same_text`` tells).
        """
        before = np.roll(states, 1)
        return self.advance(TABLE[(before ^ np.uint32(0x20)) & 0xFF] ^ (before >> np.uint32(8)))

    def same_text(self, back: int) -> np.ndarray:
        """Whether the word ``back`` places before is in the same text."""
        out = np.zeros(len(self.text), bool)
        out[back:] = self.text[back:] == self.text[: len(self.text) - back]
        return out
