"""Periodic runs of words: stretches that repeat with a period, found by counts of matches at each lag.

A run of period q and at least 4 q words has 3 q neighbouring places whose word recurs q places on. So the number of
matches at each lag tells which periods are possible. Matches are counted exactly in two ways: words that occur often
by the autocorrelation of their places (fast Fourier transforms), rare ones by the differences of all pairs of their
places. Only lags with enough matches, after those that runs of a dividing period explain, are scanned for islands
(stretches of matches), and a scan first looks for one whole block of an island at fixed places.

Documents are independent: nothing is shuffled, and a worker holds the words of a few documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.shared import documents, text_of

QUERY = "op13_periodic_runs"
ORACLE_SQL = None
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Offsets of a block that are compared for all blocks together, before the blocks that are left are compared whole.
TOGETHER = 12
#: Words of documents whose rare words are counted together.
CHUNK_WORDS = 50_000


def heavy_count(n: int) -> int:
    """Occurrences from which a word of a text of n words is counted by the transform."""
    return max(32, int((n * np.log2(n + 2)) ** 0.5))


def _transform_counts(places: list[np.ndarray], n: int, lags: int) -> np.ndarray:
    """Matches at lags 0 to ``lags`` of words given by their places, summed: one inverse transform for all words."""
    size = 1 << int(n + lags).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        mark = np.zeros(size)
        mark[at] = 1.0
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text (an array of word numbers) the matches at lags 0 to n // 4; lag 0 means nothing."""
    sizes = np.array([len(t) for t in texts])
    lags = sizes // LEAST_PERIODS
    base = np.concatenate([[0], np.cumsum(lags + 1)])
    out = np.zeros(base[-1], np.int64)
    if not sizes.sum():
        return [out[base[k] : base[k + 1]] for k in range(len(texts))]
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    word = np.concatenate(texts) + np.repeat(np.cumsum([0, *(int(t.max(initial=-1)) + 1 for t in texts)])[:-1], sizes)
    order = np.argsort(word, kind="stable")
    word, place, text = word[order], place[order], text[order]
    n_word = np.bincount(word)
    heavy = n_word[word] >= np.array([heavy_count(n) for n in sizes])[text]
    if heavy.any():
        starts = np.concatenate([[0], np.cumsum(n_word)])
        for k in np.unique(text[heavy]):
            own = np.unique(word[heavy & (text == k)])
            out[base[k] : base[k + 1]] += _transform_counts([place[starts[w] : starts[w + 1]] for w in own], int(sizes[k]), int(lags[k]))
    light = np.flatnonzero(~heavy)
    word, place, reach, first = word[light], place[light], lags[text[light]], base[text[light]]
    left = np.arange(len(word))
    step = 1
    while len(left):
        # Places grow within a word: a pair beyond the reach or the word ends the pairs of its left side.
        left = left[left + step < len(word)]
        gap = place[left + step] - place[left]
        near = (word[left + step] == word[left]) & (gap <= reach[left])
        left = left[near]
        found = first[left] + gap[near]
        if len(found) < 64:
            np.add.at(out, found, 1)
        else:
            out += np.bincount(found, minlength=len(out))
        step += 1
    return [out[base[k] : base[k + 1]] for k in range(len(texts))]


def _stretch(same: np.ndarray, at: int, step: int) -> int:
    """How many places from ``at`` on (in direction ``step``) are true, looking at longer and longer pieces."""
    n, width = 0, 64
    while True:
        low, high = (at + n, at + n + width) if step > 0 else (at - n - width + 1, at - n + 1)
        piece = same[max(low, 0) : max(high, 0)][::step]
        stop = int(np.argmin(piece)) if len(piece) else 0
        if not len(piece) or not piece[stop]:
            return n + stop
        n += len(piece)
        if len(piece) < width:
            return n
        width *= 2


class _Matches:
    """words[k] == words[k + q], made only where it is looked at."""

    def __init__(self, words: np.ndarray, q: int):
        self.left, self.right = words[:-q], words[q:]

    def __getitem__(self, where) -> np.ndarray:
        return self.left[where] == self.right[where]


def islands(words: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, matches) of the maximal stretches of at least ``least`` places whose word recurs ``q`` places on."""
    same = _Matches(words, q)
    # A stretch of 2 * block - 1 places holds a whole block that begins at a multiple of its length.
    block = (least + 1) // 2
    starts = np.arange(0, len(words) - q - block + 1, block)
    for offset in range(min(block, TOGETHER)):
        starts = starts[same[starts + offset]]
        if not len(starts):
            return []
    out: list[tuple[int, int]] = []
    done = -1
    for at in starts.tolist():
        if at < done or not same[at : at + block].all():
            continue
        back = _stretch(same, at - 1, -1) if at else 0
        n = back + _stretch(same, at, 1)
        done = at - back + n
        if n >= least:
            out.append((at - back, n))
    return out


def find_runs(words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs by start, then period; ``counts`` are the matches at each lag."""
    least = lambda q: max(LEAST_WORDS, LEAST_PERIODS * q) - q
    lag = np.arange(1, len(counts))
    possible = lag[counts[1:] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag) - lag]
    explained: dict[int, int] = {}
    wanted = set(possible.tolist())
    runs: list[tuple[int, int, int]] = []
    seen: set[tuple[int, int]] = set()
    for q in possible.tolist():
        if counts[q] - explained.get(q, 0) < least(q):
            continue
        for start, n in islands(words, q, least(q)):
            length = n + q
            if (start, length) in seen:  # the same stretch has a smaller period
                continue
            seen.add((start, length))
            runs.append((start, length, q))
            # The places of this run match at all multiples of its period too; no other run of such a lag shares them.
            for more in range(2 * q, min(length, len(counts)), q):
                if more in wanted:
                    explained[more] = explained.get(more, 0) + length - more
    return sorted(runs, key=lambda r: (r[0], r[2]))


def planted(words: list, doc_id: int | None) -> list:
    """The words of the contract's query: one document in ten, by its hash, becomes periodic from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def keep_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run, or in the first period of every run that holds them."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


FIELDS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def detect(docs: DataFrame, change=None) -> DataFrame:
    """doc_id, runs (by start, then period) and the text without the repeats, words joined by one blank, for every row.

    Words lie between ASCII blanks. ``change`` (words, doc_id) -> words is applied first, if given. Null and empty
    texts have no words and no runs; null ids and repeated rows pass through; other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def solve(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbered = []
        for words in texts:
            number: dict[bytes, int] = {}
            numbered.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        runs, collapsed = [], []
        for words, own, counts in zip(texts, numbered, lag_counts(numbered), strict=True):
            found = find_runs(own, counts)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
            kept = [words[k] for k in np.flatnonzero(keep_mask(len(words), found)).tolist()] if found else words
            collapsed.append(b" ".join(kept).decode())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, schema.field("runs").type), pa.array(collapsed, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                words = text.as_py().encode().split()
                words = change(words, doc_id) if change else words
                if texts and size + len(words) > CHUNK_WORDS:
                    yield solve(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words)
            if ids:
                yield solve(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, FIELDS)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from runs and collapsed text."""
    runs = F.col("runs")
    better = lambda a, r: (a["period"].isNull()) | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(documents(spark, sf_dir), planted))
