"""What the stages of the pipeline send over a shuffle."""

import numpy as np
from pyspark.sql import functions as F

from tallywork.llm import line_dedup, ngram_join


def test_postings_are_dealt_narrow_and_with_short_keys(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(60))) for k in range(40)], "doc_id long, text string")
    posted = ngram_join._postings(docs, 5, 80)
    keys = np.array([r[0] for r in posted.select("term").collect()])
    assert ((keys & 0xFFFF) < 4).all() and len(np.unique(keys >> 16)) > 100
    plan = ngram_join._lists(posted)._jdf.queryExecution().executedPlan().toString()
    # No aggregate below the exchange: its rows hold a term and a node only.
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(term") :]


def test_list_of_keys_that_fall_together_loses_no_candidate(spark):
    rows = [(5, 1, 20, bytes([2] * 16)), (5, 2, 20, bytes([2] * 16)), (5, 3, 400, bytes([8] * 50)), (5, 4, 400, bytes([8] * 50)), (5, 9, 400, bytes(50))]
    listed = spark.createDataFrame(rows, "term long, node long, size long, counts binary")
    assert {frozenset(r) for r in ngram_join._list_edges(listed, 80).collect()} == {frozenset((1, 2)), frozenset((3, 4))}


def test_only_texts_that_may_lose_lines_are_shuffled(spark):
    held = spark.range(20_000).withColumnRenamed("id", "n").withColumn("id", F.when(F.col("n") > 0, F.col("n")))
    marks = line_dedup.marked_ids(held.filter("n % 100 = 1").select("id"))
    some, others = (line_dedup.may_be_in(held, marks, w).cache() for w in (True, False))
    assert some.count() + others.count() == 20_000 and some.filter("n % 100 = 1").count() == 200
    assert some.count() < 220 and others.filter("n = 0").count() == 1


def test_line_dedup_with_and_without_lost_lines(spark):
    rows = [(k, f"a line of its own {k}\n" + ("a line that many hold" if k % 3 else f"another of its own {k}")) for k in range(60)] + [(None, "a line that many hold"), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"], tuple(r["keep_bitmap"])) for r in line_dedup.dedup_lines(docs).collect()}
    lost = lambda k: k is not None and k < 1000 and k % 3 and k > 1
    assert out == {(k, t.split("\n")[0] if lost(k) else t or "", 1 + (t or "").count("\n"), int(bool(lost(k))), (1, 1) if lost(k) else (1 + (t or "").count("\n"),)) for k, t in rows}
