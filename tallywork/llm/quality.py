"""Text quality by positive-unlabelled learning.

Trusted positives are the documents that labels mark as good, outside the held-out fold; all documents are the
unlabelled text. Labels of bad documents are never used. A linear classifier on statistics of whole texts minimises the
non-negative unbiased risk: with class prior p, the risk of positives counts p-fold, and the negative risk is that of
the unlabelled text minus p times that of the positives taken as negative, which may not fall below zero. With the
logistic loss the unbiased part is convex, and its scores estimate the probability of being good.

The prior is estimated from a first classifier of positives against unlabelled text: above any score the unlabelled
share is at least p times that of positives, so the least quotient over all scores (with a bound for chance) is p.

Statistics are made once for each document and written; every later pass reads only them, and a pass brings sums of a
fixed size to the driver: for each step of Newton's method one gradient and one matrix. All documents take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.byte_words import Words, byte_classes, chunks
from tallywork.llm.shared import cut, documents, drop, text_of

QUERY = "op11_quality"
ORACLE_SQL = None
CLASSES = byte_classes(b"\x09\x0a\x0b\x0c\x0d\x20")

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = (
    "the of and to in is it that was for on are as with be by this not or an at der die das und ist nicht ein eine zu mit den von im auf "
    "le la les de des et est dans pour que qui une un sur el los las y en es por con para del se lo"
).split()

_UPPER, _LOWER, _DIGIT, _MARK, _SYMBOL, _WIDE, _BLANK = (1 << k for k in range(7))
KINDS = np.zeros(256, np.uint8)
KINDS[0x80:] = _WIDE
for _b in range(0x80):
    _c = chr(_b)
    KINDS[_b] = _UPPER if _c.isupper() else _LOWER if _c.islower() else _DIGIT if _c.isdigit() else _MARK if _c in ".,;:!?'\"()-" else _BLANK if _c.isspace() else _SYMBOL

STATISTICS = [
    "log_words", "mean_length", "deviation_of_length", "uppercase", "digits", "marks", "symbols", "wide", "blanks", "lines",
    "words_without_letters", "words_in_capitals", "capitalised_words", "words_ending_sentences", "words_ending_in_two_signs", "long_words",
    "same_as_previous", "same_as_last_but_one", "distinct_words", "distinct_growth", "commonest_word", "distinct_pairs", "repeated_bytes", "function_words",
]
#: Statistics, their squares and a constant.
WIDTH = 2 * len(STATISTICS) + 1


def held_out(column: str = "doc_id"):
    """Rows of the held-out fold; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _function_words() -> np.ndarray:
    text = " ".join(FUNCTION_WORDS).encode()
    return np.unique(Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), CLASSES).states())


def _largest_group(text: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text how many different keys it has and how often the commonest occurs."""
    pairs = np.sort((text.astype(np.uint64) << np.uint64(32)) | key)
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(pairs)))
    owner = (pairs[first] >> np.uint64(32)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owner, sizes)
    return np.bincount(owner, minlength=n), most


def text_statistics(data: np.ndarray, bounds: np.ndarray, common: np.ndarray) -> np.ndarray:
    """STATISTICS of a run of texts, a row for each; shares of nothing are 0."""
    n = len(bounds) - 1
    words = Words(data, bounds, CLASSES)
    kinds = KINDS[data]
    size, count = np.diff(bounds), words.counts
    share = lambda found, of: np.asarray(found, float) / np.maximum(of, 1)

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(mask)])
        return share(upto[bounds[1:]] - upto[bounds[:-1]], size)

    def of_words(mask: np.ndarray) -> np.ndarray:
        return share(np.bincount(words.text[mask], minlength=n), count)

    def held(kind: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum((kinds & kind) != 0)])
        return upto[words.ends] - upto[words.starts]

    length = words.lengths.astype(float)
    mean = share(np.bincount(words.text, length, n), count)
    square = share(np.bincount(words.text, length * length, n), count)
    capitals, letters = held(_UPPER), held(_UPPER | _LOWER | _WIDE)
    last, last_but_one = (kinds[np.maximum(words.ends - k, words.starts)] & (_MARK | _SYMBOL) != 0 for k in (1, 2))
    states = words.states()
    same = [words.same_text(k) & (states == np.roll(states, k)) for k in (1, 2)]
    pairs_real = words.same_text(1)
    distinct, most = _largest_group(words.text, states, n)
    distinct_pairs, _ = _largest_group(words.text[pairs_real], words.longer(states)[pairs_real], n)
    thrice = np.zeros(len(data), bool)
    thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    for k in (0, 1):  # not across texts
        at = bounds[:-1] + k
        thrice[at[at < len(data)]] = False
    columns = [
        np.log1p(count), mean, np.sqrt(np.maximum(square - mean * mean, 0)),
        *(of_bytes((kinds & k) != 0) for k in (_UPPER, _DIGIT, _MARK, _SYMBOL, _WIDE, _BLANK)), of_bytes(data == 10),
        of_words(letters == 0), of_words((capitals == letters) & (letters > 1)), of_words(kinds[words.starts] & _UPPER != 0),
        of_words(np.isin(data[words.ends - 1], np.frombuffer(b".!?", np.uint8))), of_words(last & last_but_one & (words.lengths > 2)), of_words(words.lengths > 20),
        *(of_words(s) for s in same), share(distinct, count), share(np.log1p(distinct), np.log1p(count)) * (count > 0),
        share(most, count), share(distinct_pairs, count - 1), of_bytes(thrice), of_words(np.isin(states, common)),
    ]
    return np.column_stack(columns)


def statistics_of(docs: DataFrame) -> DataFrame:
    """doc_id and x (the STATISTICS as doubles in binary) of every row; null and empty texts have zeros."""
    common = _function_words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_statistics(data, bounds, common) for _, _, data, bounds in chunks(batch.column(1))]
            rows = np.concatenate(made) if made else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows.astype(np.float32)], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, x binary")


def mark_trusted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds trusted: the id is labelled good (and never bad) outside the held-out fold."""
    good = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    good = good.filter("quality = 1").select("doc_id", F.lit(True).alias("trusted"))
    known = rows.filter("doc_id is not null").join(good, "doc_id", "left").select("doc_id", "x", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    return known.unionByName(rows.filter("doc_id is null").withColumn("trusted", F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), len(STATISTICS)).astype(float)


def _expand(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / spread, -5, 5)
    return np.column_stack([z, z * z / 5, np.ones(len(z))])


def _sum_arrays(rows: DataFrame, sums, size: int) -> np.ndarray:
    """The sum over all rows of ``sums(matrix, trusted)``, an array of ``size``; added up by position in a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += sums(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["k", "v"])

    out = np.zeros(size)
    for r in rows.select("x", "trusted").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


_UPPER_PART = np.triu_indices(WIDTH)


def _moments(rows: DataFrame, scale, weights: np.ndarray) -> dict[str, np.ndarray | float]:
    """What a step needs, at these weights, with p, u for trusted rows and all rows.

    n_p, n_u: rows; loss_p, loss_u: mean losses of taking them as negative; x_p: mean features of trusted rows;
    g_p, g_u: gradients and h_p, h_u: Hessians of loss_p and loss_u; z_p: mean score of trusted rows.
    """
    mean, spread = scale
    half = len(_UPPER_PART[0])

    def sums(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        full = _expand(x, mean, spread)
        out = []
        for f in (full[trusted], full):
            z = f @ weights
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            out += [[len(f), np.logaddexp(0, z).sum(), z.sum()], f.sum(axis=0), s @ f, ((f * (s * (1 - s))[:, None]).T @ f)[_UPPER_PART]]
        return np.concatenate(out)

    total = _sum_arrays(rows, sums, 2 * (3 + 2 * WIDTH + half))
    found: dict[str, np.ndarray | float] = {}
    for side, part in zip("pu", np.split(total, 2), strict=True):
        n = max(part[0], 1.0)
        h = np.zeros((WIDTH, WIDTH))
        h[_UPPER_PART] = part[3 + 2 * WIDTH :] / n
        found |= {f"n_{side}": part[0], f"loss_{side}": part[1] / n, f"z_{side}": part[2] / n, f"x_{side}": part[3 : 3 + WIDTH] / n}
        found |= {f"g_{side}": part[3 + WIDTH : 3 + 2 * WIDTH] / n, f"h_{side}": h + np.triu(h, 1).T}
    return found


def _penalty(ridge: float) -> np.ndarray:
    out = np.full(WIDTH, ridge)
    out[-1] = 1e-9
    return out


def _shortened(step: np.ndarray, longest: float = 6.0) -> np.ndarray:
    return step * min(1.0, longest / max(float(np.linalg.norm(step)), 1e-12))


def fit_first(rows: DataFrame, scale, ridge: float, rounds: int = 6) -> np.ndarray:
    """Weights of positives against unlabelled text, both sides counting the same."""
    w, penalty = np.zeros(WIDTH), _penalty(ridge)
    for _ in range(rounds):
        m = _moments(rows, scale, w)
        # Loss of positives: loss_p - z_p, so its gradient is g_p - x_p.
        gradient = (m["g_p"] - m["x_p"] + m["g_u"]) / 2 + penalty * w
        step = _shortened(np.linalg.solve((m["h_p"] + m["h_u"]) / 2 + np.diag(penalty + 1e-9), gradient))
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def class_prior(rows: DataFrame, scale, weights: np.ndarray, bins: int = 2000, least_share: float = 0.05) -> float:
    """The share of good documents: the least quotient of unlabelled and positive shares above a score."""
    mean, spread = scale

    def sums(x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
        z = _expand(x, mean, spread) @ weights
        place = np.clip(((np.tanh(z / 8) + 1) / 2 * bins).astype(int), 0, bins - 1)
        return np.concatenate([np.bincount(place[trusted], minlength=bins), np.bincount(place, minlength=bins)])

    positive, every = (np.cumsum(part[::-1]) for part in np.split(_sum_arrays(rows, sums, 2 * bins), 2))
    n_p, n_u = positive[-1], every[-1]
    if not n_p:
        return 0.5
    q_p, q_u = positive / n_p, every / n_u
    chance = math.sqrt(math.log(40) / (2 * n_p)) + math.sqrt(math.log(40) / (2 * n_u))
    usable = q_p >= least_share
    bound = (q_u[usable] + chance) / q_p[usable]
    at = int(np.argmin(bound))
    return float(np.clip(q_u[usable][at] / q_p[usable][at], 0.01, 0.99))


def fit_risk(rows: DataFrame, scale, prior: float, ridge: float, rounds: int = 14) -> np.ndarray:
    """Weights of least non-negative unbiased risk, by Newton's method over all rows.

    Where the negative risk falls below zero, the step raises it instead, as in the non-negative estimator.
    """
    w, penalty = np.zeros(WIDTH), _penalty(ridge)
    best, best_risk = w, math.inf
    for _ in range(rounds):
        m = _moments(rows, scale, w)
        negative = m["loss_u"] - prior * m["loss_p"]
        risk = prior * (m["loss_p"] - m["z_p"]) + max(0.0, negative) + float(penalty @ (w * w)) / 2
        if risk < best_risk:
            best, best_risk = w, risk
        curvature = m["h_u"] + np.diag(penalty + 1e-9)
        if negative < 0:
            step = -np.linalg.solve(curvature, m["g_u"] - prior * m["g_p"]) / 2
        else:
            step = np.linalg.solve(curvature, m["g_u"] - prior * m["x_p"] + penalty * w)
        step = _shortened(step)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return best


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, ridge: float = 0.003) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts get the score of a text without words. Rows with a null id count as held out and are never
    trusted; an id with labels of both kinds isn't either; repeated rows each count. Without any trusted row all scores
    are 0.5. Other columns are not read.
    """
    made = cut(statistics_of(docs), "quality-statistics")
    rows = cut(mark_trusted(made, labels), "quality-marked")
    drop(made)
    k = len(STATISTICS)
    totals = _sum_arrays(rows, lambda x, t: np.concatenate([[len(x), t.sum()], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * k)
    n = max(totals[0], 1.0)
    mean = totals[2 : 2 + k] / n
    scale = mean, np.sqrt(np.maximum(totals[2 + k :] / n - mean * mean, 1e-8))
    weights = np.zeros(WIDTH)
    if totals[1]:
        prior = class_prior(rows, scale, fit_first(rows, scale, ridge))
        weights = fit_risk(rows, scale, prior, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _expand(_matrix(batch.column(1)), *scale) @ weights if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    scored = rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
