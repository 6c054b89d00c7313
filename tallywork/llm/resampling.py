"""Importance resampling towards a target distribution, by hashed features of one to three words.

Texts are read as bytes (``byte_words``): a lookup table classifies them, differences find the words, and the CRC-32 of
all runs of words advances over all starts at once. A first pass counts features by bucket, of the corpus and of the
target; gains of buckets are the logarithms of smoothed ratios. A second pass sums gains by document. Weights plus
Gumbel noise of a hash of the id rank the documents, and the highest are drawn without replacement.

Both passes keep one array of bucket counts or gains for each task. No text is shuffled; ranks need a sort of ids and
scores that an approximate percentile (whose count is checked) leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.llm.byte_words import Words, byte_classes, chunks
from tallywork.llm.shared import cut, documents, text_of

QUERY = "op12_importance_resampling"
ORACLE_SQL = None
#: What separates words: ASCII but for digits and letters.
BETWEEN = bytes(b for b in range(0x80) if not chr(b).isalnum())
CLASSES = byte_classes(BETWEEN)


def feature_buckets(words: Words, buckets: int, most: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all runs of 1 to ``most`` words, a pair of arrays for each length."""
    states = words.states()
    for k in range(most):
        if k:
            states = words.longer(states)
        real = words.same_text(k)
        yield words.text[real], (~states[real]).astype(np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int) -> dict[int, int]:
    """Features by bucket over the column ``text``; at most ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                for _, found in feature_buckets(Words(data, bounds, CLASSES), buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    counts = texts.select(text_of().alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in counts.collect()}


def bucket_gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the logarithm of the smoothed ratio of target to corpus, rounded down."""
    all_raw, all_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * all_raw / ((raw.get(b, 0) + 1) * all_target))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, weight = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for first, end, data, bounds in chunks(batch.column(1)):
                words = Words(data, bounds, CLASSES)
                n_words[first:end] = words.counts
                for text, found in feature_buckets(words, buckets):
                    sums = np.concatenate([[0], np.cumsum(gains[found])])
                    upto = np.searchsorted(text, np.arange(end - first + 1))
                    weight[first:end] += sums[upto[1:]] - sums[upto[:-1]]
            n_features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, rounded down, from a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, eligible, wanted: int) -> DataFrame:
    """row and rank of the ``wanted`` eligible rows of highest score, ties to the smaller id, then to the earlier row.

    ``scored`` (doc_id, score, row) is a written table: it is read several times.
    """
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    rows = scored.filter(eligible).select("doc_id", "score", "row")
    total = rows.count()
    if wanted <= 0 or not total:
        return spark.createDataFrame([], "row long, rank long")
    # A little below the wanted percentile; without enough rows above it, all rows are sorted.
    least = rows.agg(F.percentile_approx("score", max(0.0, 1.0 - 1.05 * wanted / total - 0.001), 10_000)).first()[0]
    above = rows.filter(F.col("score") >= least)
    if above.count() < wanted:
        above = rows
    # Ranks: ranges of the order are numbered one by one, after the sizes of those before.
    dealt = cut(above.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "resampling-ranges")
    sizes, before = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count("*").alias("n")).collect()}, {}
    for part in sorted(sizes):
        before[part] = sum(sizes[p] for p in before)
    starts = spark.createDataFrame(list(before.items()), "range int, before long")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = dealt.join(F.broadcast(starts), "range").select("row", (F.col("before") + inside).cast("long").alias("rank"))
    return ranked.filter(F.col("rank") <= wanted)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``docs``.

    Of the rows with ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn. Null and empty texts have
    no features and weight 0. A null id hashes as the empty string and loses ties; repeated rows are ranked each by
    itself. Empty tables are allowed for either side. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    weighed = weigh(docs, gains).withColumn("row", F.monotonically_increasing_id())
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    enough = F.col("n_words") >= least_words
    ranks = draw(scored, enough, percent * scored.filter(enough).count() // 100)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
