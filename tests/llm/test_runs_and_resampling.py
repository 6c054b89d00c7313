"""Periodic runs and importance resampling against brute force, and their small cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallywork.llm import byte_words, periodic_runs, resampling

ODD = [(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one"), (None, "a b c " * 30), (None, None), (5, "été \x00 \x1f x　y \x0b\x0c z"), (6, "ab " * 5000), (7, "w" * 300_000)]
SCHEMA = "doc_id long, text string"


def plain_runs(words):
    """All runs by looking at every period and place."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > k:
                length = end - k + q
                if length >= max(6, 4 * q) and not any(all(words[j] == words[j + p] for j in range(k, k + length - p)) for p in range(1, q)):
                    found.append((k, length, q))
            k = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def contract_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2])) if runs else None
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def random_texts(pick, count):
    for k in range(count):
        words = [pick.choice("abcdefgh"[: pick.randint(1, 8)]) for _ in range(pick.randint(0, 60))]
        for _ in range(pick.randint(0, 3)):
            at, period = pick.randint(0, len(words)), [pick.choice("abcxyz") for _ in range(pick.randint(1, 7))]
            words[at:at] = (period * 8)[: pick.randint(4, 7) * len(period) + pick.randint(0, 3)]
        yield k, pick.choice([" ", "\n", " \t"]).join(words)


def test_runs_against_brute_force(spark):
    rows = [*random_texts(random.Random(5), 400), (None, "a b " * 9), (None, None), (900, None), (901, "")]
    got = periodic_runs.digest(periodic_runs.detect(spark.createDataFrame(rows, SCHEMA).repartition(3), periodic_runs.planted)).collect()
    want = sorted((contract_row(*r) for r in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r["n_runs"] > 1 for r in got) > 30 and {"start", "length", "period", "exponent_milli"} <= set(got[0].asDict())


def test_lag_counts_of_frequent_and_rare_words():
    make = np.random.default_rng(1)
    texts = [make.integers(0, hi, n) for hi, n in ((2, 900), (40, 1500), (700, 1200), (1, 7), (3, 0), (1, 1), (5, 64))]
    for words, counts in zip(texts, periodic_runs.lag_counts(texts), strict=True):
        assert counts[1:].tolist() == [int((words[:-q] == words[q:]).sum()) for q in range(1, len(words) // 4 + 1)]
    assert (np.bincount(texts[0]) >= periodic_runs.heavy_count(900)).all() and np.bincount(texts[2]).max() < periodic_runs.heavy_count(1200)


def test_long_runs_and_hostile_texts():
    for words in (np.zeros(300_000, np.int64), np.arange(300_000) % 70_000, np.random.default_rng(2).integers(0, 2, 60_000)):
        runs = periodic_runs.find_runs(words, periodic_runs.lag_counts([words])[0])
        for start, length, q in runs:
            own = words[start : start + length]
            assert (own[:-q] == own[q:]).all() and length >= max(6, 4 * q)
    assert periodic_runs.find_runs(np.zeros(50_000, np.int64), periodic_runs.lag_counts([np.zeros(50_000, np.int64)])[0]) == [(0, 50_000, 1)]
    tiled = np.tile(np.random.default_rng(3).integers(0, 9, 97), 400)
    assert (0, 97 * 400, 97) in periodic_runs.find_runs(tiled, periodic_runs.lag_counts([tiled])[0])


def test_runs_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("runs", "start", "best", "collapsed", "period")})
    got = periodic_runs.detect(df).collect()
    assert len(got) == len(ODD) and periodic_runs.digest(periodic_runs.detect(df.limit(0))).count() == 0
    six = next(r for r in got if r["doc_id"] == 6)
    assert [tuple(r) for r in six["runs"]] == [(0, 5000, 1)] and six["collapsed"] == "ab"
    assert sum(r["runs"] == [] and r["collapsed"] == "one" for r in got) == 3
    assert [tuple(r) for r in next(r for r in got if r["doc_id"] is None and r["runs"])["runs"]] == [(0, 90, 3)]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = {}, {}
    for texts, counts in ((rows, raw), (target, aim)):
        for _, text in texts:
            for f in features(text)[1]:
                counts[bucket(f)] = counts.get(bucket(f), 0) + 1
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim.get(b, 0) + 1) * (s + buckets) / ((raw.get(b, 0) + 1) * (t + buckets))))
    out, enough = [], []
    for k, (doc_id, text) in enumerate(rows):
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if len(words) >= least:
            enough.append((-score, doc_id is None, doc_id or 0, k))
    for rank, (*_, k) in enumerate(sorted(enough)[: percent * len(enough) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=str)


def test_resampling_against_brute_force(spark):
    pick = random.Random(9)
    vocabulary = ["".join(pick.choice("aBcé中1") for _ in range(pick.randint(1, 9))) for _ in range(80)] + ["long" * 40, "LONG" * 60]
    text = lambda: "".join(pick.choice(vocabulary) + pick.choice([" ", ", ", "\n", "\x00", "-"]) for _ in range(pick.randint(0, 60)))
    rows = [(k, text()) for k in range(600)] + [(601, None), (602, ""), (603, "." * 50), (604, rows_text := text() * 3), (604, rows_text)]
    target = [(k, text()) for k in range(20)] + [(21, None)]
    docs, aim = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(target, SCHEMA)
    for percent, least in ((5, 20), (60, 20), (100, 1), (0, 20)):
        got = resampling.resample(docs, aim, percent=percent, least_words=least).collect()
        assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, 10_000, percent, least)


def test_resampling_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("score", "row", "range", "weight", "bucket", "n", "rank")})
    none = df.limit(0)
    assert resampling.resample(none, df).count() == 0 and resampling.resample(none, none).count() == 0
    for aim in (df, none):
        got = resampling.resample(df, aim, percent=100).collect()
        want = plain_resample(ODD, [] if aim is none else ODD, 10_000, 100, 20)
        assert sorted(map(tuple, got), key=str) == want
    # Equal scores: a third of all rows are one text, the smaller ids are drawn first.
    same = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("word " * 25).alias("text"))
    got = resampling.resample(same, none)
    assert got.agg(F.sum("rank")).first()[0] == 150 * 151 // 2


def test_words_of_bytes_across_texts_and_slices():
    column = pa.array(["skipped", "ab", "cd e", "", "x" * 200, "ü"]).slice(1)
    (first, end, data, bounds), *rest = byte_words.chunks(column)
    words = byte_words.Words(data, bounds, resampling.CLASSES)
    assert (first, end, rest) == (0, 5, []) and words.counts.tolist() == [1, 2, 0, 1, 1]
    assert (~words.states()).tolist() == [zlib.crc32(w.encode()) for w in ("ab", "cd", "e", "x" * 200, "ü")]
    assert words.same_text(1).tolist() == [False, False, True, False, False]
    assert list(byte_words.chunks(pa.array([], pa.string()))) == []


def test_scores_of_the_n_best_never_rise(spark):
    from tallywork.llm import piece_lattice

    rising = piece_lattice.query(spark, "/root/testdata/sf0.01").filter("exists(sequence(1, size(best_scores) - 1), k -> get(best_scores, k) > get(best_scores, k - 1)) and size(best_scores) > 1")
    assert rising.count() == 0
