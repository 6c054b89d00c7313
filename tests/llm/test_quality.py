"""Quality scores: statistics against plain Python, the risk against a plain minimiser, held-out accuracy, small cases."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import quality

SCHEMA = "doc_id long, text string"


def plain_statistics(text):
    raw = text.encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    share = lambda n, of: n / max(of, 1)
    mark, symbol = b".,;:!?'\"()-", bytes(b for b in range(0x80) if not chr(b).isalnum() and not chr(b).isspace())
    letters = lambda w: sum(chr(b).isalpha() and b < 0x80 or b >= 0x80 for b in w)
    capitals = lambda w: sum(0x41 <= b <= 0x5A for b in w)
    n, pairs = len(words), list(zip(low, low[1:], strict=False))
    of_bytes = lambda f: share(sum(map(f, raw)), len(raw))
    of_words = lambda f: share(sum(map(f, words)), n)
    lengths = [len(w) for w in words]
    mean = share(sum(lengths), n)
    common = {w.encode() for w in quality.FUNCTION_WORDS}
    return [
        math.log1p(n), mean, math.sqrt(max(share(sum(k * k for k in lengths), n) - mean * mean, 0)),
        of_bytes(lambda b: 0x41 <= b <= 0x5A), of_bytes(lambda b: 0x30 <= b <= 0x39), of_bytes(lambda b: b in mark), of_bytes(lambda b: b in symbol and b not in mark),
        of_bytes(lambda b: b >= 0x80), of_bytes(lambda b: b < 0x80 and chr(b).isspace()), of_bytes(lambda b: b == 10),
        of_words(lambda w: not letters(w)), of_words(lambda w: capitals(w) == letters(w) > 1), of_words(lambda w: capitals(w[:1])), of_words(lambda w: w[-1:] in (b".", b"!", b"?")),
        of_words(lambda w: len(w) > 2 and w[-1] in symbol and w[-2] in symbol), of_words(lambda w: len(w) > 20),
        share(sum(a == b for a, b in pairs), n), share(sum(a == b for a, b in zip(low, low[2:], strict=False)), n), share(len(set(low)), n),
        share(math.log1p(len(set(low))), math.log1p(n)) if n else 0, share(max((low.count(w) for w in set(low)), default=0), n), share(len(set(pairs)), n - 1),
        share(sum(raw[k] == raw[k - 1] == raw[k - 2] for k in range(2, len(raw))), len(raw)), share(sum(w in common for w in low), n),
    ]


def test_statistics_against_plain_python(spark):
    pick = random.Random(4)
    vocabulary = ["The", "the", "OF", "x", "été", "12%%%", "wow!!", "...", "SHOUT", "und", "a|b", "中文", "w" * 60, "Aaa."]
    texts = ["", *("".join(pick.choice(vocabulary) + pick.choice([" ", "\n", "  ", "\t"]) for _ in range(pick.randint(0, 40))) for _ in range(120))]
    got = quality.statistics_of(spark.createDataFrame(list(enumerate([None, *texts])), SCHEMA)).collect()
    for doc_id, x in got:
        want = plain_statistics(([None, *texts])[doc_id] or "")
        assert np.frombuffer(x, np.float32) == pytest.approx(want, rel=1e-5, abs=1e-6), doc_id


def table_of(make, n, share):
    """Good documents are prose, bad ones repeat words; half of the good ones are trusted."""
    vocabulary = [f"word{k}" for k in range(300)]
    rows, good = [], []
    for k in range(n):
        fine = make.random() < share
        words = [vocabulary[j] for j in make.integers(0, 300, make.integers(20, 80))]
        rows.append((k, " ".join(words) + "." if fine else " ".join(w for w in words[:8] for _ in range(6))))
        good.append(fine)
    return rows, good


def test_prior_and_scores_on_separable_text(spark):
    make = np.random.default_rng(8)
    for share in (0.35, 0.8):
        rows, good = table_of(make, 3000, share)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        labels = spark.createDataFrame([(k, 1) for k, g in enumerate(good) if g and k % 2], "doc_id long, quality int")
        statistics = quality.cut(quality.mark_trusted(quality.statistics_of(docs), labels), "test")
        x = np.array([np.frombuffer(r["x"], np.float32) for r in statistics.collect()], float)
        scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
        assert quality.class_prior(statistics, scale, quality.fit_first(statistics, scale, 0.003)) == pytest.approx(share, abs=0.06)
        got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
        right = [got[k]["predicted"] == g for k, g in enumerate(good)]
        assert np.mean(right) > 0.99 and all(0 <= r["score"] <= 1 for r in got.values())


def test_risk_against_a_plain_minimiser(spark):
    make = np.random.default_rng(3)
    rows, good = table_of(make, 400, 0.6)
    labels = spark.createDataFrame([(k, 1) for k, g in enumerate(good) if g and k % 3], "doc_id long, quality int")
    held = quality.cut(quality.mark_trusted(quality.statistics_of(spark.createDataFrame(rows, SCHEMA)), labels), "test")
    data = held.collect()
    x, trusted = np.array([np.frombuffer(r["x"], np.float32) for r in data], float), np.array([r["trusted"] for r in data])
    scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-4)
    full = quality._expand(x, *scale)
    for prior, ridge in ((0.6, 0.05), (0.95, 0.01)):  # with too large a prior the negative risk reaches zero
        penalty = quality._penalty(ridge)

        def risk(w):
            z = full @ w
            p, u = z[trusted], z
            return prior * np.logaddexp(0, -p).mean() + max(0.0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()) + penalty @ (w * w) / 2

        w = quality.fit_risk(held, scale, prior, ridge)
        here = risk(w)
        assert here < risk(np.zeros(len(w)))
        if prior == 0.6:
            assert all(risk(w + make.standard_normal(len(w)) * 0.02) > here for _ in range(50))


def test_bad_labels_and_the_held_out_fold_are_not_read(spark):
    rows, good = table_of(np.random.default_rng(5), 600, 0.7)
    docs = spark.createDataFrame(rows, SCHEMA)
    folds = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out().alias("h")).collect()}
    one = [(k, 1) for k, g in enumerate(good) if g and not folds[k] and k % 2]
    more = [(k, int(k % 3 == 0)) for k in folds if folds[k]] + [(k, 0) for k, g in enumerate(good) if not g]
    a, b = (quality.score_quality(docs, spark.createDataFrame(ls, "doc_id long, quality int")) for ls in (one, one + more))
    first, second = ({r["doc_id"]: r["score"] for r in f.collect()} for f in (a, b))
    assert all(first[k] == pytest.approx(second[k], abs=1e-9) for k in first)


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (3, "one"), (4, "one"), (4, "one"), (None, "one two"), (None, None), (5, "\x00 \n\n"), (6, "ab " * 50_000), (7, "w" * 2_000_000)]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit("x") for c in ("x", "trusted", "score", "quality", "k", "v")})
    labels = spark.createDataFrame([(3, 1, "x"), (4, 1, "x"), (4, 0, "x"), (6, 0, "x"), (99, 1, "x"), (None, 1, "x"), (5, None, "x")], "doc_id long, quality int, trusted string")
    for ls in (labels, labels.limit(0)):
        got = quality.score_quality(df, ls).collect()
        assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert all(r["held_out"] for r in got if r["doc_id"] is None)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert all(r["score"] == 0.5 for r in got)
    assert quality.score_quality(df.limit(0), labels).count() == 0 and quality.score_quality(df.limit(0), labels.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    scores = {r["doc_id"]: r for r in quality.query(spark, d).collect()}
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if scores[r["doc_id"]]["held_out"]]
    good, bad = ([scores[r["doc_id"]]["score"] for r in labels if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s >= 0.3 for s in bad]) < 0.1
