"""Chunks, the stored index and long concatenations against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywork.operators import text as X
from tallywork.operators.index import TextIndex


def test_split_column_gives_the_chunks_of_the_recursive_function(spark):
    pick = random.Random(1)
    rows = []
    for k in range(200):
        part = lambda: pick.choice(["a", "bb", "ccc" * pick.randint(1, 8), "é中", "\x85", "　x"]) + pick.choice([" ", " ", "\n", "\n\n", "  ", "\n\n\n", ""])
        rows.append((k, "".join(part() for _ in range(pick.randint(0, 80)))))
    rows += [(1000, None), (1001, ""), (1002, " \n \n\n "), (1003, "x" * 95), (1004, " " * 50), (1005, "ab " * 300), (1006, "\n".join("y" * pick.randint(1, 60) for _ in range(50)))]
    df = spark.createDataFrame(rows, "id long, text string")
    for size, overlap in ((30, 8), (20, 0), (50, 49)):
        got = {r[0]: r[1] for r in df.select("id", X.split_column("text", size, overlap)).collect()}
        assert all(got[k] == (X.split_recursively(t, size, overlap) if t else []) for k, t in rows)


def brute_search(texts, queries, k, k1=1.2, b=0.75):
    words = lambda t: [w for w in re.split(r"\W+", (t or "").lower(), flags=re.A) if w]
    docs = {d: words(t) for d, t in texts if words(t)}
    mean = sum(map(len, docs.values())) / len(docs)
    holders: dict = {}
    for d, ws in docs.items():
        for w in set(ws):
            holders[w] = holders.get(w, 0) + 1
    out = []
    for q, t in queries:
        scores: dict = {}
        for w in words(t):
            if w not in holders:
                continue
            idf = math.log(1 + (len(docs) - holders[w] + 0.5) / (holders[w] + 0.5))
            for d, ws in docs.items():
                tf = ws.count(w)
                if tf:
                    scores[d] = scores.get(d, 0.0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
        out += [(q, r, d, round(scores[d], 6)) for r, d in enumerate(best, 1)]
    return sorted(out)


def same_ranks(found, want):
    got = sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in found.collect())
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-6)


def test_index_search_against_scores_of_all_keys(spark, tmp_path):
    pick = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    shares = [1.0 / (k + 1) for k in range(400)]
    text = lambda n: " ".join(pick.choices(vocabulary, shares, k=n))
    texts = [(k, text(pick.randint(5, 60))) for k in range(900)] + [(2000, None), (2001, ""), (2002, same := text(30)), (2003, same), (2004, same)]
    queries = [(k, texts[k * 7][1][:60]) for k in range(25)] + [(100, "nothing known"), (101, None), (102, same), (103, "w399 w399 W1, w0")]
    docs = spark.createDataFrame(texts, "id long, text string").withColumns({c: F.lit("x") for c in ("term", "k", "n", "range")}).repartition(4)
    path = str(tmp_path / "index")
    TextIndex.build(docs, "id", "text", path, width=8)
    found, read = TextIndex.open(spark, path, "id").search(spark.createDataFrame(queries, "qid long, text string"), "qid", "text", k=4)
    same_ranks(found, brute_search(texts, queries, 4))
    whole, opened = read.agg(F.sum("n_postings"), F.sum("n_opened")).first()
    assert opened < 0.6 * whole
    # As many as all keys: nothing may be left out.
    found, _ = TextIndex.open(spark, path, "id").search(spark.createDataFrame(queries[:3], "qid long, text string"), "qid", "text", k=1000)
    same_ranks(found, brute_search(texts, queries[:3], 1000))


def test_index_shuffles_no_single_postings(spark, tmp_path):
    pick = random.Random(11)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(pick.paretovariate(0.6)) % 500}" for _ in range(40))) for k in range(600)], "id long, text string")
    queries = spark.createDataFrame([(k, " ".join(f"w{int(pick.paretovariate(0.6)) % 500}" for _ in range(30))) for k in range(40)], "qid long, text string")
    index = TextIndex.build(docs, "id", "text", str(tmp_path / "index"))
    terms = index._query_terms(queries, "qid", "text").withColumn("open", F.lit(True))
    summed = index._summed(terms, 4)
    summed.collect()
    plan = summed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Blocks are dealt by range; no posting of a query is.
    assert re.search(r"Exchange hashpartitioning\(range#", plan) and not re.search(r"Exchange hashpartitioning\(q#\w+, (range|k)#", plan)


def test_index_of_an_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    TextIndex.build(none, "id", "text", str(tmp_path / "none"))
    found, read = TextIndex.open(spark, str(tmp_path / "none"), "id").search(spark.createDataFrame([(1, "a")], "qid long, text string"), "qid", "text")
    assert found.count() == 0 and read.count() == 0


def test_combine_splits_a_hot_group_by_position(spark, monkeypatch):
    monkeypatch.setattr(X, "PIECE_ROWS", 50)
    pick = random.Random(5)
    rows = [("hot", k, pick.choice(["", "a", "b c", "é"]) + str(k % 7)) for k in range(4000)] + [(f"g{k % 300}", k % 5, str(k)) for k in range(1500)] + [("none", 1, None), ("none", 2, None), (None, 1, "x"), (None, None, "first"), ("ties", 1, "b"), ("ties", 1, "a"), ("ties", 1, "a"), ("gap", 1, "a"), ("gap", 2, None), ("gap", 3, "")]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "piece string, part long, at string").repartition(6)
    want: dict = {}
    for g, o, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        want.setdefault(g, []).append(t)
    combined = X.combine(df, "piece", "part", "at", "|")
    assert {r["piece"]: r["combined"] for r in combined.collect()} == {g: "|".join(t for t in ts if t is not None) for g, ts in want.items()}
    # What a task gathers of the hot group: pieces, of at most so many rows each.
    pieces = X.pieces(df, "piece", "part", "at", "|")
    assert pieces.agg(F.max("rows")).first()[0] <= 50 and pieces.filter("_by = 'hot'").count() >= 80
    assert X.combine(df.limit(0), "piece", "part", "at").count() == 0
