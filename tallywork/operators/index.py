"""An inverted index over a text column, stored as a table of blocks, and its search for the best k.

The keys are dealt into ranges of about ``width`` keys. A row of the table is the block of one term in one range: keys
and their weights (BM25 without the factor of the term) by falling weight, and the largest weight. A smaller table has
the factor and the largest impact of every term. Texts are dealt by range before they are cut into words, so that an
index is built with one shuffle of the texts and none of the words.

A search starts from the table of terms. The terms of highest impact give a few good keys, whose exact scores set a
threshold for the k-th place. Terms whose largest impacts together stay below it can't bring a key to it alone: only
the postings of the others are opened. A key found there goes on if its impacts so far and the largest impacts of the
other terms in its range reach the threshold, and only blocks of such ranges are opened for exact scores. The result is
that of scoring every key. Blocks are dealt by range before the postings meet the queries: impacts of a key are summed
where they are opened, and what is shuffled is a block for each term, not a posting for each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.sources.io import shared_path

#: Postings that a query's terms of highest impact open, for each of the k best, before there is a threshold.
SEED_POSTINGS = 20
#: Keys of a task, about.
PART_KEYS = 8192
#: Tables of terms, ranges and keys of a search are broadcast up to so many rows.
BROADCAST_ROWS = 500_000
#: Bounds are sums in another order than scores, and not rounded: they get this much more.
SLACK = 1.0 + 1e-8


def terms_of(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and underscores, as an array."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


@dataclass(frozen=True)
class TextIndex:
    """An index at ``path``; blocks: range, term, top, n, keys, weights; terms: term, df, idf, most; totals: n, mean."""

    spark: SparkSession
    path: str
    key: str

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str, width: int = 16, k1: float = 1.2, b: float = 0.75) -> TextIndex:
        """Index the rows of ``df`` at ``path``. Rows of one key count as one text; null keys and texts aren't indexed."""
        index = cls(df.sparkSession, path, key)
        rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k is not null and t is not null")
        sized = rows.groupBy("k").agg(F.sum(F.size(terms_of(F.col("t")))).alias("size")).filter("size > 0")
        sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).write.parquet(f"{path}/totals")
        total = index._table("totals").first()
        n, mean = total["n"], total["mean"] or 1.0
        ranges = max(1, math.ceil(n / width))
        dealt = rows.withColumn("range", F.pmod(F.xxhash64("k"), F.lit(ranges))).repartition(index._parts(n), "range")
        # All that follows groups by the range too and stays in its task.
        size = F.sum(F.size(terms_of(F.col("t")))).over(Window.partitionBy("range", "k"))
        words = dealt.withColumn("size", size).select("range", "k", "size", F.explode(terms_of(F.col("t"))).alias("term"))
        counts = words.groupBy("range", "k", "size", "term").agg(F.count("*").alias("tf"))
        weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / mean))
        pairs = F.sort_array(F.collect_list(F.struct("weight", "k")), asc=False)
        blocks = counts.withColumn("weight", weight).groupBy("range", "term").agg(F.max("weight").alias("top"), F.count("*").cast("int").alias("n"), pairs.alias("p"))
        blocks = blocks.select("range", "term", "top", "n", F.col("p.k").alias("keys"), F.col("p.weight").alias("weights"))
        blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
        terms = index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
        idf = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        terms.select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most")).write.parquet(f"{path}/vocabulary")
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, key: str) -> TextIndex:
        return cls(spark, path, key)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def blocks(self) -> DataFrame:
        return self._table("blocks")

    def _parts(self, n: int) -> int:
        """Tasks over the ranges of n keys."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PART_KEYS))

    def _query_terms(self, queries: DataFrame, query: str, text: str) -> DataFrame:
        """q, term, weight (how often q holds it), df, idf, most (its largest impact on a key) of known terms."""
        words = queries.select(F.col(query).alias("q"), F.explode(terms_of(F.col(text))).alias("term")).filter("q is not null")
        terms = words.groupBy("q", "term").agg(F.count("*").alias("weight")).join(self._table("vocabulary"), "term")
        return terms.select("q", "term", "weight", "df", "idf", (F.col("weight") * F.col("most")).alias("most"))

    def _summed(self, terms: DataFrame, parts: int) -> DataFrame:
        """q, range, k and partial (the sum of impacts) of the postings of (q, term, weight, idf, open) where ``open`` holds.

        A row without a key has for each q and range in ``more`` the sum of the largest impacts of the other terms.
        """
        used = terms.groupBy("term").agg(F.first("idf").alias("idf"), F.bool_or("open").alias("opened"))
        postings = F.when(F.col("opened"), F.arrays_zip("keys", "weights")).alias("postings")
        dealt = self.blocks.join(_small(used), "term").select("term", "range", "top", "idf", postings).repartition(parts, "range")
        rows = dealt.join(_small(terms.select("q", "term", "weight", "open")), "term")
        each = rows.select("q", "range", "weight", "idf", "top", F.explode_outer(F.when(F.col("open"), F.col("postings"))).alias("p"))
        impact = F.col("weight") * (F.col("idf") * F.col("p.weights"))
        bound = F.when(F.col("p").isNull(), F.col("weight") * (F.col("idf") * F.col("top")))
        return each.select("q", "range", F.col("p.keys").alias("k"), impact.alias("impact"), bound.alias("bound")).groupBy("q", "range", "k").agg(F.sum("impact").alias("partial"), F.sum("bound").alias("more"))

    def _exact(self, keys: DataFrame, terms: DataFrame) -> DataFrame:
        """q, k and the score of (q, range, k), rounded to nine places so that equal texts tie; opens blocks of their ranges."""
        looked = keys.select("q", "range").distinct()
        rows = self.blocks.select("term", "range", "keys", "weights").join(_small(looked), "range").join(_small(terms.select("q", "term", "weight", "idf")), ["q", "term"])
        each = rows.select("q", "weight", "idf", F.explode(F.arrays_zip("keys", "weights")).alias("p")).select("q", F.col("p.keys").alias("k"), (F.col("weight") * (F.col("idf") * F.col("p.weights"))).alias("impact"))
        return each.join(_small(keys.select("q", "k")), ["q", "k"], "left_semi").groupBy("q", "k").agg(F.round(F.sum("impact"), 9).alias("score"))

    def search(self, queries: DataFrame, query: str, text: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """(query, rank, key, score) of the k best keys of every query, ties to the smaller key; and what it read.

        The second frame has the query, its postings and how many of them were opened. Queries without a known term
        have no rows. Terms that a query repeats count as often as it holds them.
        """
        path = shared_path(self.spark, "index-search")
        parts = self._parts(self._table("totals").first()["n"])

        def kept(rows: DataFrame, name: str) -> DataFrame:
            rows.write.parquet(f"{path}/{name}")
            return self.spark.read.schema(rows.schema).parquet(f"{path}/{name}")

        terms = kept(self._query_terms(queries, query, text), "terms")
        falling = Window.partitionBy("q").orderBy(F.desc("most"), "term").rowsBetween(Window.unboundedPreceding, -1)
        seeds = kept(terms.withColumn("before", F.coalesce(F.sum("df").over(falling), F.lit(0))).filter(F.col("before") < SEED_POSTINGS * k).withColumn("open", F.lit(True)), "seeds")
        best = lambda by: Window.partitionBy("q").orderBy(F.desc(by), "k")

        def promising(partial: DataFrame, name: str) -> DataFrame:
            return kept(partial.withColumn("at", F.row_number().over(best("partial"))).filter(F.col("at") <= 2 * k).select("q", "range", "k"), name)

        def kth(scores: DataFrame, name: str) -> DataFrame:
            return kept(scores.withColumn("at", F.row_number().over(best("score"))).filter(F.col("at") == k).select("q", (F.col("score") / SLACK).alias("least")), name)

        first = promising(self._summed(seeds, parts), "first")
        scores = kept(self._exact(first, terms), "scores")
        threshold = kth(scores, "threshold")
        # The terms of least impact, together below the threshold, bring no key of their own.
        rising = Window.partitionBy("q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        judged = kept(terms.join(threshold, "q", "left").withColumn("open", F.col("least").isNull() | (F.sum("most").over(rising) >= F.col("least"))), "judged")
        bounds = judged.groupBy("q").agg(F.first("least").alias("least"), F.sum(F.when(~F.col("open"), F.col("most")).otherwise(0.0)).alias("others"))
        # Keys that the largest impacts of the other terms anywhere don't bring to the threshold go before those in a range count.
        partial = self._summed(judged, parts).join(_small(bounds), "q").filter(F.col("k").isNull() | F.col("least").isNull() | (F.col("partial") + F.col("others") >= F.col("least")))
        reach = F.col("partial") + F.coalesce(F.max("more").over(Window.partitionBy("q", "range")), F.lit(0.0))
        passed = partial.withColumn("reach", reach).filter(F.col("k").isNotNull() & (F.col("least").isNull() | (F.col("reach") >= F.col("least"))))
        passed = kept(passed.select("q", "range", "k", "partial", "reach"), "passed")
        # The best of what the others bring give a higher threshold.
        second = promising(passed, "second")
        threshold = kth(scores.unionByName(self._exact(second, terms)).groupBy("q", "k").agg(F.min("score").alias("score")), "higher")
        near = passed.join(_small(threshold), "q", "left").filter(F.col("least").isNull() | (F.col("reach") >= F.col("least")))
        near = kept(near.select("q", "range", "k"), "near")
        ranked = self._exact(near, terms).withColumn("rank", F.row_number().over(best("score"))).filter(F.col("rank") <= k)
        looked = near.union(first).union(second).select("q", "range").distinct()
        opened = judged.filter("open").select("q", "term").union(seeds.select("q", "term")).distinct().withColumn("whole", F.lit(True))
        marks = terms.join(opened, ["q", "term"], "left")
        whole = marks.groupBy("q").agg(F.sum("df").alias("n_postings"), F.sum(F.when(F.col("whole"), F.col("df")).otherwise(0)).alias("n_whole"))
        rest = self.blocks.select("term", "range", "n").join(looked, "range").join(marks.filter("whole is null").select("q", "term"), ["q", "term"]).groupBy("q").agg(F.sum("n").alias("n_part"))
        read = whole.join(rest, "q", "left").select(F.col("q").alias(query), "n_postings", (F.col("n_whole") + F.coalesce("n_part", F.lit(0))).alias("n_opened"))
        return ranked.select(F.col("q").alias(query), "rank", F.col("k").alias(self.key), "score"), read


def _small(rows: DataFrame) -> DataFrame:
    """For a broadcast, if ``rows`` are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
