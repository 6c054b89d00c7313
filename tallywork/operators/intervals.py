"""Joins by order: values in intervals, and the last row before a time, with hot keys and hot stretches split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of bins are powers of this; an interval lies in at most two bins of the width next above its length.
BASE = 4.0
#: Shares of all points from which a bin is dealt over several tasks: at most SPLIT bins can be that large.
SPLIT = 1000
#: Stretches of time, of about equally many rows, that a key's rows are dealt into.
BUCKETS = 256


def _level(length: Column) -> Column:
    """A power of BASE that is no smaller than a length, as a whole number; that of 1e-9 for shorter ones."""
    return F.ceil(F.log(F.greatest(length, F.lit(1e-9))) / F.log(F.lit(BASE)) + 1e-9).cast("int")


def _bin(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(BASE), level)).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, by: Sequence[str] = (), closed: bool = False, split: int = SPLIT) -> DataFrame:
    """Pairs of a point and an interval (of equal ``by``) with low <= value < high, or <= high if ``closed``.

    An equi-join of bins: intervals are entered by width into at most two bins, points into one bin for each width that
    occurs. Bins with more than one in ``split`` of the points (they are at most as many as ``split``) are dealt: each
    of their points goes to one of several copies of the bin's intervals. Nulls and empty intervals meet nothing. The
    two sides must not share names but ``by``, which come from the points.
    """
    x, a, b = F.col(value).cast("double"), F.col(low).cast("double"), F.col(high).cast("double")
    real = intervals.filter((a <= b) if closed else (a < b))
    # Widths that occur: a handful, since they are powers.
    levels = sorted(r[0] for r in real.select(_level(b - a).alias("l")).distinct().collect())
    keys = [f"_by{k}" for k in range(len(by))]
    left = points.filter(x.isNotNull()).select("*", *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("_level"))
    left = left.withColumn("_bin", _bin(x, F.col("_level")))
    ends = F.array_distinct(F.array(_bin(a, F.col("_level")), _bin(b, F.col("_level"))))
    right = real.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *(c for c in intervals.columns if c not in by), _level(b - a).alias("_level")).withColumn("_bin", F.explode(ends))
    on = [*keys, "_level", "_bin"]
    counts = left.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(1, total // split)
    hot = counts.filter(F.col("_n") > least).select(*on, F.ceil(F.col("_n") / least).cast("int").alias("_copies"))
    hot = F.broadcast(hot)
    copies = F.coalesce("_copies", F.lit(1))
    left = left.join(hot, on, "left").withColumn("_copy", F.pmod(F.monotonically_increasing_id(), copies).cast("int")).drop("_copies")
    right = right.join(hot, on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    met = left.join(right, [*on, "_copy"]).filter((a <= x) & ((x <= b) if closed else (x < b)))
    return met.drop(*on, "_copy")


def time_buckets(rows: DataFrame, time: str, buckets: int = BUCKETS) -> Column:
    """The stretch of time of a row: how many of the splits, taken from a sketch of all rows, are no later."""
    number = F.col(time).cast("double") if dict(rows.dtypes)[time] != "timestamp_ntz" else F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    shares = F.array(*(F.lit((k + 1) / buckets) for k in range(buckets - 1)))
    splits = sorted(set(rows.agg(F.percentile_approx(number, shares, 10_000)).first()[0] or []))
    if not splits:
        return F.lit(0)
    # Halving: the place among the splits in as many steps as their number has bits.
    held, bits = F.array(*map(F.lit, splits)), len(splits).bit_length()
    step = lambda at, k: F.when(F.get(held, at + k - 1) <= number, at + k).otherwise(at)
    widths = F.array(*(F.lit(1 << k) for k in reversed(range(bits))))
    return F.aggregate(widths, F.lit(0), step)


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` with the same key and no later time; null if there is none.

    Of rows of ``right`` at one time the one with the greatest ``columns`` counts. Rows of ``left`` with a null key or
    time stay, with nulls. Values are carried forward inside (key, stretch of time) groups, then from stretch to stretch
    by one row for each; so a key with most of the rows is as many groups as there are stretches.
    """
    values = F.struct(*(F.col(c).alias(c) for c in columns))
    known = right.filter(F.col(by).isNotNull() & F.col(time).isNotNull())
    one = left.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_left"), F.lit(None).alias("_value"))
    two = known.select(F.col(by).alias("_by"), F.col(time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), values.alias("_value"))
    both = two.unionByName(one)
    placed = both.withColumn("_bucket", F.coalesce(time_buckets(both, "_time", buckets), F.lit(-1)))
    inside = Window.partitionBy("_by", "_bucket").orderBy("_time", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumn("_own", F.last("_value", ignorenulls=True).over(inside)).filter("_side = 1")
    lasts = placed.groupBy("_by", "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_time", "_value"))).alias("_last"))
    before = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(F.col("_by").alias("_key"), F.col("_bucket").alias("_at"), F.last("_last", ignorenulls=True).over(before)["_value"].alias("_carried"))
    out = filled.join(carried, (F.col("_by") == F.col("_key")) & (F.col("_bucket") == F.col("_at")), "left")
    found = F.when(F.col("_by").isNotNull() & F.col("_time").isNotNull(), F.coalesce("_own", "_carried"))
    return out.select("_left", found.alias("_found")).select("_left.*", *(F.col("_found")[c].alias(c) for c in columns))
