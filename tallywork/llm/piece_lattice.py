"""SentencePiece encoding and decoding with the N best segmentations.

A text is normalised as the model file says (identity, a leading dummy blank, blanks as U+2581) and cut where a blank
follows another character; no piece crosses such a cut, so the lattice of a text is the chain of its segments' lattices.
Forward Viterbi scores of a lattice are exact heuristics for a backward A-star search, which yields segmentations from
the best downwards. Among the N best of a text only the N - 1 segments with the smallest loss for their second-best path
can deviate; the search runs over the chain of those segments, and the others stay at their best.

A model file of merges holds ranks, not probabilities. A piece of rank r gets the probability 1 / (r + 1) over the sum
of that for all pieces (Zipf's law), so a path's score is the logarithm of its probability as a unigram sequence. The
library replays merges instead; ``by_library`` gives its segmentation with its score on the same scale. A character that
is no piece costs 10 more than the worst piece and is written as byte pieces. Of equal scores the path whose last piece
is longest wins, at every node.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.shared import documents, give_back, text_of

QUERY = "op3_sentencepiece_nbest"
ORACLE_SQL = None
BLANK = "▁"
BLANK_BYTES = BLANK.encode()
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, as columns; the longest that it does (in bytes), or works out with others (in characters).
MEMO, MEMO_CHARS = 200_000, 48
#: An odd number; hashes of pieces are polynomials over it.
HASH_BASE = 0x9E3779B97F4A7C15
SLOT_FACTOR, SLOT_SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(44)
SCHEMA = "doc_id long, n_pieces long, score double, ids_sha256 string, n_best int, best_scores array<double>, round_trip boolean, best_sha256 array<string>, segmentations array<array<int>>, decoded string"
#: Characters of text whose results a worker holds before it hands them on.
HELD_CHARS = 1_500_000
#: Lattices that a worker keeps.
LATTICES = 5_000


class Segment(NamedTuple):
    """What is known of a segment: its best path (score, packed ids, whether these decode to the segment) and what the
    second-best path loses."""

    score: float
    ids: bytes
    same: bool
    loss: float


class Segments(NamedTuple):
    """What is known of many segments, in columns: their bytes, scores and losses, whether their best paths decode to
    them, how many ids these have, and the ids of all in turn."""

    text: pa.Array
    score: np.ndarray
    loss: np.ndarray
    same: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        begins, sizes = np.cumsum(self.size) - self.size, self.size[which]
        return Segments(self.text.take(pa.array(which)), self.score[which], self.loss[which], self.same[which], sizes, self.ids[runs(begins[which], sizes)])

    @staticmethod
    def join(parts: list[Segments]) -> Segments:
        text, *others = zip(*parts, strict=True)
        return Segments(pa.concat_arrays(text), *map(np.concatenate, others))


def runs(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a large_binary column and the bounds of its texts (one more than texts)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class PieceModel:
    """The pieces of a model file with the lattice operations on them; ``zipf`` turns scores (ranks) to probabilities."""

    def __init__(self, path: str, zipf: bool = True):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.scores: dict[str, tuple[float, int]] = {}
        self.bytes_of, self.id_of_byte = [b""] * n, [-1] * 256
        self.unknown_id = model.unk_id()
        every = list(range(n))
        kinds = (model.is_byte(every), model.is_control(every), model.is_unknown(every), model.is_unused(every))
        for i, piece, rank, spells, *other in zip(every, model.id_to_piece(every), model.get_score(every), *kinds, strict=True):
            if spells:
                self.id_of_byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not any(other):
                self.scores[piece] = (rank, i)
                self.bytes_of[i] = piece.encode()
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.scores):
            raise ValueError("a piece of this model crosses the start of a word")
        if zipf:
            total = sum(1 / (1 - rank) for rank, _ in self.scores.values())
            self.scores = {p: (-math.log((1 - rank) * total), i) for p, (rank, i) in self.scores.items()}
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = min((s for s, _ in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.prefix = model.normalize("a") == BLANK + "a"
        if model.normalize("  a  b ") != BLANK * self.prefix + "  a  b ".replace(" ", BLANK):
            raise ValueError("this model rewrites text before segmentation")
        #: By id: scores, and which ids write a character that is no piece.
        self.score_of, self.spells = np.zeros(n), np.ones(n, bool)
        for score, i in self.scores.values():
            self.score_of[i], self.spells[i] = score, False
        #: Pieces and, with id -1, what only starts a piece.
        self.known = {p[:k]: (0.0, -1) for p in self.scores for k in range(1, len(p))} | self.scores
        self.spelling, self.byte_ids = pa.array(self.bytes_of, pa.large_binary()), np.array([i if i >= 0 else self.unknown_id for i in self.id_of_byte], np.int32)
        self.memo = Segments(pa.array([], pa.large_binary()), np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int32))
        hashes = np.array([self._hash(p) for p in self.known], np.uint64)
        order = np.argsort(hashes)
        # One slot for each value of some bits; where several keys share it (-1), they are searched for.
        slots = (hashes[order] * SLOT_FACTOR >> SLOT_SHIFT).astype(np.int64)
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[slots] = np.arange(len(order))
        self.slot[np.bincount(slots, minlength=1 << 20) > 1] = -1
        self.lattices: dict[str, tuple] = {}
        self.hashes, self.hash_scores, self.hash_ids = hashes[order], *(np.array([e[k] for e in self.known.values()], t)[order] for k, t in enumerate((float, np.int32)))

    def split(self, text: str) -> list[str]:
        distinct, places, _ = self.cut_up([self.normalise(text)])
        return [distinct[k].as_py().decode("utf-8", "surrogatepass") for k in places.tolist()]

    def normalise(self, text: str) -> str:
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def edges(self, segment: str) -> list[list[tuple[int, float, int]]]:
        """For each end its edges (start, score, id), longest first; id -1 stands for an unknown character."""
        scores, n, longest = self.scores, len(segment), self.longest
        out: list[list[tuple[int, float, int]]] = [[]]
        for end in range(1, n + 1):
            here = []
            for start in range(max(0, end - longest), end):
                found = scores.get(segment[start:end])
                if found:
                    here.append((start, *found))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, self.unknown, -1))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list[list[tuple[int, float, int]]]) -> tuple[list[float], list[tuple[int, float, int]]]:
        """Viterbi scores of all prefixes and the last edge of each."""
        best, last = [0.0], [(0, 0.0, -1)]
        for here in edges[1:]:
            top = here[0]
            score = best[top[0]] + top[1]
            for edge in here:
                s = best[edge[0]] + edge[1]
                if s > score:
                    score, top = s, edge
            best.append(score)
            last.append(top)
        return best, last

    def lattice(self, segment: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """Edges and forward scores; the segments with the smallest losses are often the same."""
        held = self.lattices.get(segment)
        if held is None:
            edges = self.edges(segment)
            held = edges, self.forward(edges)[0]
            if len(self.lattices) < LATTICES and len(segment) <= MEMO_CHARS:
                self.lattices[segment] = held
        return held

    def written(self, segment: str, path: list[tuple[int, int, int]]) -> list[int]:
        """Ids of a path of (start, end, id), unknown characters as bytes."""
        ids: list[int] = []
        for start, end, piece in path:
            if piece >= 0:
                ids.append(piece)
            else:
                for byte in segment[start:end].encode("utf-8", "surrogatepass"):
                    ids.append(self.id_of_byte[byte] if self.id_of_byte[byte] >= 0 else self.unknown_id)
        return ids

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * HASH_BASE + ord(c) + 1) & (2**64 - 1)
        return h

    def analyse(self, texts: pa.Array) -> Segments:
        """What is known of each of the distinct segments ``texts``, from the memo or worked out now."""
        held = self.memo
        at = pc.fill_null(pc.index_in(texts, value_set=held.text), -1).to_numpy().astype(np.int64)
        missing, unused = np.flatnonzero(at < 0), np.ones(len(held.text), bool)
        unused[at[at >= 0]] = False
        at[missing] = len(held.text) + np.arange(len(missing))
        known = Segments.join([held, self.work_out(texts.take(pa.array(missing)))])
        short = pc.less_equal(pc.binary_length(texts), MEMO_CHARS).to_numpy(zero_copy_only=False)
        self.memo = known.take(np.concatenate([at[short], np.flatnonzero(unused)])[:MEMO])  # what was used last comes first
        return known.take(at)

    def analyse_many(self, segments: list[str]) -> list[Segment]:
        """The same as ``_analyse`` for several segments."""
        known = self.work_out(pa.array([s.encode("utf-8", "surrogatepass") for s in segments], pa.large_binary()))
        ids = np.split(known.ids, np.cumsum(known.size)[:-1])
        return [Segment(x, i.tobytes(), same, loss) for x, i, same, loss in zip(known.score.tolist(), ids, known.same.tolist(), known.loss.tolist(), strict=True)]

    def work_out(self, texts: pa.Array) -> Segments:
        """What is known of each of ``texts`` (large_binary, none empty): the lattices of all segments of one length at
        once, and those of long segments one by one."""
        data, bounds = bytes_of(texts)
        begins = np.flatnonzero(data & 0xC0 != 0x80)  # of characters
        chars = np.searchsorted(begins, bounds)
        sizes = np.diff(chars)
        if len(long := np.flatnonzero(sizes > MEMO_CHARS)):
            short, parts = np.flatnonzero(sizes <= MEMO_CHARS), []
            for k in long:
                own = self._analyse(texts[k].as_py().decode("utf-8", "surrogatepass"))
                ids = np.frombuffer(own.ids, np.int32)
                parts.append(Segments(texts.slice(k, 1), *map(np.array, ([own.score], [own.loss], [own.same], [len(ids)])), ids))
            order = np.argsort(np.concatenate([short, long]))
            return Segments.join([self.work_out(texts.take(pa.array(short))), *parts]).take(order)
        codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        score, loss, owner = np.zeros(len(texts)), np.zeros(len(texts)), np.repeat(np.arange(len(texts)), sizes)
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        by_size = np.argsort(sizes, kind="stable")
        for alike in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
            for first in range(0, len(alike), 2048):
                some = alike[first : first + 2048]
                score[some], loss[some], row, start, ids = self.paths(codes[chars[some] + np.arange(sizes[some[0]])[:, None]].astype(np.uint64))
                places.append(chars[some[row]] + start)
                found.append(ids)
        place = np.concatenate(places)
        order = np.argsort(place)
        place, ids = place[order], np.concatenate(found)[order]
        lengths, unknown = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
        lengths[unknown] = np.diff(begins, append=len(data))[place[unknown]]
        ends = np.cumsum(lengths)
        ids = np.repeat(ids, lengths)
        ids[runs(ends[unknown] - lengths[unknown], lengths[unknown])] = self.byte_ids[data[runs(begins[place[unknown]], lengths[unknown])]]
        size = np.bincount(owner[place], weights=lengths, minlength=len(texts)).astype(np.int64)
        written, ends = bytes_of(self.spelling.take(pa.array(ids)))
        ends = ends[np.cumsum(size)]
        same = np.ones(len(texts), bool)
        if not (np.array_equal(ends, bounds[1:]) and np.array_equal(written, data)):
            same[:] = [written[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip([0, *ends[:-1]], ends, bounds[:-1], bounds[1:], strict=True)]
        return Segments(texts, score, loss, same, size, ids)

    def paths(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of segments of one length, one in each column of ``codes``: scores of the best paths, what the second-best
        lose, and (segment, start, id) of the pieces of the best."""
        (size, rows), codes = codes.shape, codes.ravel()
        longest = min(self.longest, size)
        # For each width and start the score and id of a piece there, if any; ``held`` tells where any segment has one.
        score, piece = np.empty((longest + 1, size, rows)), np.empty((longest + 1, size, rows), np.int32)
        held, used = np.zeros((longest + 1, size), bool), []
        at, h = np.arange(rows * size), np.zeros(rows * size, np.uint64)
        for width in range(1, longest + 1):
            if width > 1:
                inside = at < (size - width + 1) * rows
                at, h = at[inside], h[inside]
            if not len(at):
                break
            h = h * np.uint64(HASH_BASE) + codes[at + (width - 1) * rows] + np.uint64(1)
            place = self.slot[(h * SLOT_FACTOR >> SLOT_SHIFT).view(np.int64)]
            unsure = np.flatnonzero(place < 0)
            place[unsure] = np.minimum(np.searchsorted(self.hashes, h[unsure]), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[place] == h)
            at, h, place = at[hit], h[hit], place[hit]
            ids = self.hash_ids[place]
            whole = np.flatnonzero(ids >= 0)
            if width == 1 or len(whole):
                used.append(width)
                score[width], piece[width], held[width] = (self.unknown, -1, True) if width == 1 else (-np.inf, -1, False)
                spots = at[whole]
                score[width].ravel()[spots], piece[width].ravel()[spots] = self.hash_scores[place[whole]], ids[whole]
                held[width, spots // rows] = True
        best, step = np.zeros((size + 1, rows)), np.zeros((size + 1, rows), np.int8)
        reached, better = np.empty(rows), np.empty(rows, bool)
        for end in range(1, size + 1):
            top, width = best[end], step[end]
            top.fill(-np.inf)
            for w in reversed(used):  # of equal scores the longest
                if w <= end and held[w, end - w]:
                    np.add(best[end - w], score[w, end - w], out=reached)
                    np.greater(reached, top, out=better)
                    np.copyto(width, w, where=better)
                    np.maximum(top, reached, out=top)
        on_path, node, live = np.zeros((size, rows), np.int8), np.full(rows, size), np.arange(rows)
        while len(live):
            width = step[node[live], live]
            node[live] -= width
            on_path[node[live], live] = width
            live = live[node[live] > 0]
        after, second = np.zeros((size + 1, rows)), np.full(rows, -np.inf)
        rest, line = np.empty((len(used), rows)), np.zeros(longest + 1, np.int64)
        for start in range(size - 1, -1, -1):
            here = [w for w in used if start + w <= size and held[w, start]]
            for k, w in enumerate(here):
                line[w] = k
                np.add(score[w, start], after[start + w], out=rest[k])
            np.max(rest[: len(here)], axis=0, out=after[start])
            own = np.flatnonzero(on_path[start])
            rest[line[on_path[start, own]], own] = -np.inf
            np.max(rest[: len(here)], axis=0, out=reached)
            np.maximum(second, best[start] + reached, out=second)
        row, start = np.nonzero(on_path.T)
        return best[size], best[size] - second, row, start, piece[on_path[start, row], start, row]

    def by_library(self, text: str) -> tuple[bytes, float]:
        """Packed ids of the library for a text and their score."""
        ids = np.array(self.library.encode(text), np.int32)
        score, spelled = float(self.score_of[ids].sum()), ids[self.spells[ids]]
        if len(spelled):
            score += self.unknown * len(self.raw(spelled.tolist()).decode("utf-8", "replace"))
        return ids.tobytes(), score

    def _analyse(self, segment: str) -> Segment:
        n, known, minus = len(segment), self.known, -math.inf
        best, last, edges = [minus] * (n + 1), [0] * (n + 1), []
        best[0] = 0.0
        for start in range(n):
            base, end, single = best[start], start, False
            while end < n:
                end += 1
                found = known.get(segment[start:end])
                if found is None:
                    break
                score, piece = found
                if piece < 0:
                    continue
                single = single or end == start + 1
                if base + score > best[end]:
                    best[end], last[end] = base + score, len(edges)
                edges.append((start, end, score, piece))
            if not single:
                if base + self.unknown > best[start + 1]:
                    best[start + 1], last[start + 1] = base + self.unknown, len(edges)
                edges.append((start, start + 1, self.unknown, -1))
        path, at = [], n
        while at:
            path.append(last[at])
            at = edges[last[at]][0]
        # A second path leaves the best one; the best path through each other edge shows at which loss.
        after, top = [minus] * n + [0.0], minus
        on_path = set(path)
        for k in range(len(edges) - 1, -1, -1):
            start, end, score, _ = edges[k]
            through = score + after[end]
            if through > after[start]:
                after[start] = through
            if k not in on_path and best[start] + through > top:
                top = best[start] + through
        ids = self.written(segment, [(edges[k][0], edges[k][1], edges[k][3]) for k in reversed(path)])
        return Segment(best[n], array("i", ids).tobytes(), self.raw(ids) == segment.encode("utf-8", "surrogatepass"), best[n] - top)

    def search(self, segments: list[str], n: int) -> list[tuple[float, list[list[int]]]]:
        """The n best paths through the chain of ``segments``: (score, ids of each segment)."""
        lattices, forward = zip(*map(self.lattice, segments), strict=True) if segments else ((), ())
        before = [0.0]
        for f in forward:
            before.append(before[-1] + f[-1])
        # States lie between pieces, walked from the end; the score of the best prefix is what the rest will add.
        heap = [(-before[-1], 0, len(segments) - 1, len(segments[-1]) if segments else 0, 0.0, None)]
        found, made = [], 1
        while heap and len(found) < n:
            total, _, k, end, done, path = heapq.heappop(heap)
            while k >= 0 and end == 0:
                k -= 1
                end = len(segments[k]) if k >= 0 else 0
            if k < 0:
                paths: list[list[tuple[int, int, int]]] = [[] for _ in segments]
                while path is not None:
                    at, edge, path = path
                    paths[at].append(edge)
                # Sums of one path differ by rounding with the order of adding: never above the path before.
                score = min(-total, found[-1][0]) if found else -total
                found.append((score, [self.written(s, p) for s, p in zip(segments, paths, strict=True)]))
                continue
            for start, score, piece in lattices[k][end]:
                reached = done + score
                heapq.heappush(heap, (-(reached + before[k] + forward[k][start]), made, k, start, reached, (k, (start, end, piece), path)))
                made += 1
        return found

    @staticmethod
    def cut_up(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct segments of normalised texts, the place among them of each segment in turn, and where the
        segments of each text begin (with the end as last)."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined, sizes = b"".join(data), np.array([len(d) for d in data], np.int64)
        raw, begins = np.frombuffer(joined, np.uint8), np.cumsum(sizes) - sizes
        at = np.flatnonzero(raw[:-2] == BLANK_BYTES[0])
        at = at[(raw[at + 1] == BLANK_BYTES[1]) & (raw[at + 2] == BLANK_BYTES[2])]
        blank, first = np.zeros((2, len(raw)), bool)
        blank[at] = True
        first[at[(at < 3) | ~blank[at - 3]]] = True
        first[begins[sizes > 0]] = True
        starts = np.flatnonzero(first)
        buffers = [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(joined)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(starts, np.append(begins, len(raw)))

    def segmentations(self, texts: list[str], n: int) -> Iterator[tuple[list[float], list[bytes], str | None]]:
        """For each text the scores and packed ids of the n best segmentations and the text that all of them stand for
        (None if they differ). Every different segment is worked out and decoded once."""
        normal = [self.normalise(t) for t in texts]
        distinct, places, bounds = self.cut_up(normal)
        if not len(distinct):
            yield from (([0.0], [b""], "") for _ in texts)
            return
        _, scores, losses, sames, sizes, ids = self.analyse(distinct)
        begins = np.cumsum(sizes) - sizes
        for own, first, end in zip(normal, bounds[:-1], bounds[1:], strict=True):
            which = places[first:end]
            if not len(which):
                yield [0.0], [b""], ""
                continue
            flat, ends = ids[runs(begins[which], sizes[which])].tobytes(), np.cumsum(sizes[which])
            each, same = scores[which], bool(sames[which].all())
            chosen = self.deviating(losses[which], n) if n > 1 else []
            out, paths = [float(each.sum())], [flat]
            if chosen:
                fixed, out, paths = out[0] - float(each[chosen].sum()), [], []
                cuts = [(int(4 * (ends[k] - sizes[which[k]])), int(4 * ends[k])) for k in chosen]
                between = [flat[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(flat)], strict=True)]
                deviate = [distinct[which[k].item()].as_py().decode("utf-8", "surrogatepass") for k in chosen]
                for own_score, path in self.search(deviate, n):
                    pieces = [between[0]]
                    for segment, i, rest in zip(deviate, path, between[1:], strict=True):
                        pieces += [array("i", i).tobytes(), rest]
                        same = same and self.raw(i) == segment.encode("utf-8", "surrogatepass")
                    out.append(fixed + own_score)
                    paths.append(b"".join(pieces))
                if paths[0] != flat:  # of equal scores, the best path of the segments comes first
                    paths = [flat, *(p for p in paths if p != flat)][: len(paths)]
            yield out, paths, self.text_of(own) if same else None

    @staticmethod
    def deviating(lost: np.ndarray, n: int) -> list[int]:
        """The n - 1 segments with the smallest losses that have a second path, in order."""
        if len(lost) >= n:
            some = np.flatnonzero(lost <= np.partition(lost, n - 2)[n - 2])
            some = some[np.argsort(lost[some], kind="stable")][: n - 1]
        else:
            some = np.arange(len(lost))
        return np.sort(some[lost[some] < np.inf]).tolist()

    def n_best(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations as (score, ids), best first."""
        scores, packed, _ = next(self.segmentations([text], n))
        return [(s, np.frombuffer(p, np.int32).tolist()) for s, p in zip(scores, packed, strict=True)]

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.text_of(self.raw(ids).decode("utf-8", "surrogatepass"))

    def text_of(self, pieces: str) -> str:
        text = pieces.replace(BLANK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


_models: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """One model for each worker process and path."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, n_pieces, score and digest of the ids (packed as little-endian 32-bit integers) of
    the best segmentation, how many of the n best exist, their scores, whether decoding the ids of each gives the text,
    digests of the ids of each in the order of the scores, these ids, and the decoded text.

    Null and empty texts have one segmentation without pieces, of score 0. A text that holds U+2581 itself comes back
    with blanks there, so round_trip is false. Null ids and repeated rows pass through; other columns are not read.
    """
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.string()), pa.string()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def table(rows: list[tuple], packed: list[list[bytes]]) -> pa.RecordBatch:
        flat = [p for own in packed for p in own]
        inner = pa.array(np.cumsum([0, *(len(p) // 4 for p in flat)]), pa.int32())
        outer = pa.array(np.cumsum([0, *map(len, packed)]), pa.int32())
        ids = pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(inner, pa.array(np.frombuffer(b"".join(flat), np.int32))))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns[:-1], ids, columns[-1]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            for docs_of, texts in slices(batch):
                yield encoded(model, docs_of, texts)
                give_back()

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
        held: tuple[list, list[str]] = [], []
        chars = 0
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            held[0].append(doc.as_py())
            held[1].append(text.as_py())
            chars += len(held[1][-1])
            if chars >= HELD_CHARS:
                yield held
                held, chars = ([], []), 0
        if held[0]:
            yield held

    def encoded(model: PieceModel, docs_of: list, texts: list[str]) -> pa.RecordBatch:
        rows, held = [], []
        for doc, text, (scores, packed, decoded) in zip(docs_of, texts, model.segmentations(texts, n), strict=True):
            if decoded is None:
                decoded, same = model.decode(np.frombuffer(packed[0], np.int32).tolist()), False
            else:
                same = decoded == text
            digests = [hashlib.sha256(p).hexdigest() for p in packed]
            rows.append((doc, len(packed[0]) // 4, scores[0], digests[0], len(scores), scores, same, digests, decoded))
            held.append(packed)
        return table(rows, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the best segmentation and digests of all; the decoded text is told by ``round_trip``."""
    import public_tokenizers

    out = encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_pieces", "score", "ids_sha256", "n_best", "best_scores", "round_trip", "best_sha256", F.get("segmentations", F.lit(0)).alias("ids"))
