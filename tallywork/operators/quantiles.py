"""Exact quantiles by selection: brackets of values that narrow until few values are left in them.

One pass makes a quantile sketch of each group and with it a bracket around every wanted rank, whatever the spread of
the values: outliers move no bracket, since brackets hold shares of the rows and not of the range. While a bracket may
hold too many values, a pass counts what lies below and at its ends and sketches its inside for a narrower one. The
last pass counts the values inside, each distinct value once, and reads off the ranks. Brackets are a few rows; values
never leave the executors, and no task sorts more than ``most_inside`` distinct values of a bracket.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.sources.io import shared_path

#: Relative accuracy of a sketch: ranks are off by at most one row in ACCURACY.
ACCURACY = 10_000
#: How far a bracket reaches to either side of its rank, as a share of the rows; groups of fewer than SMALL rows are
#: their own bracket, since the sketch of so few is no narrower.
REACH, SMALL = 3.0 / ACCURACY, 15_000
#: Distinct values that one task may sort for a bracket.
MOST_INSIDE = 1_000_000
#: Bracket rows that the driver holds and a join broadcasts; of more groups they stay a table.
MOST_ROWS = 20_000
#: Cells of the sketch that narrows a bracket.
CELLS = 256


def _held(rows: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """Rows whose plan is cut: as a local table if there are at most MOST_ROWS (then True), else a written one."""
    spark = rows.sparkSession
    few = rows.limit(MOST_ROWS + 1).collect()
    if len(few) <= MOST_ROWS:
        return spark.createDataFrame(few, rows.schema), True
    path = shared_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), False


def _by_group(rows: DataFrame, brackets: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the columns of the brackets of their group, once for each bracket."""
    renamed = brackets.withColumnsRenamed({k: f"{k}_of" for k in keys})
    if not keys:  # the brackets of the whole table are a handful of literals
        fields = [f for f in brackets.schema]
        items = [F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields)) for r in brackets.collect()]
        empty = F.array().cast(T.ArrayType(brackets.schema))
        return rows.select("*", F.explode(F.array(*items) if items else empty).alias("_b")).select(*rows.columns, "_b.*")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys))
    return rows.join(F.broadcast(renamed) if few else renamed, same).drop(*(f"{k}_of" for k in keys))


def _first_brackets(base: DataFrame, keys: list[str], probabilities: Mapping[str, float]) -> DataFrame:
    """A row for each group and quantile: q, at (its place), n, low and high."""
    places = [F.struct(F.lit(q).alias("q"), ((F.col("_n") - 1) * F.lit(float(p))).alias("at"), F.get("_sketch", F.lit(2 * k)).alias("low"), F.get("_sketch", F.lit(2 * k + 1)).alias("high")) for k, (q, p) in enumerate(probabilities.items())]
    rows = base.filter("_n > 0").select(*keys, "_n", "_min", "_max", F.explode(F.array(*places)).alias("w"))
    small = F.col("_n") < SMALL
    return rows.select(*keys, "w.q", "w.at", F.col("_n").alias("n"), F.when(small, F.col("_min")).otherwise(F.col("w.low")).alias("low"), F.when(small, F.col("_max")).otherwise(F.col("w.high")).alias("high"))


def _narrowed(x: DataFrame, brackets: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Brackets after one more pass: n is what lay strictly inside the old one."""
    inside = (F.col("x") > F.col("low")) & (F.col("x") < F.col("high"))
    cells = F.array(*(F.lit(k / CELLS) for k in range(CELLS + 1)))
    counted = _by_group(x, brackets, keys, few).filter("x <= high").groupBy(*keys, "q", "at", "low", "high").agg(
        F.count_if(F.col("x") < F.col("low")).alias("below"),
        F.count_if(F.col("x") == F.col("low")).alias("at_low"),
        F.count_if(inside).alias("n"),
        F.percentile_approx(F.when(inside, F.col("x")), cells, ACCURACY).alias("grid"),
    )
    first = F.col("below") + F.col("at_low")

    def end(rank: Column, step: int) -> Column:
        cell = F.floor((rank - first) / F.col("n") * CELLS).cast("int") + step
        return F.when(rank < first, F.col("low")).when(rank < first + F.col("n"), F.get("grid", F.least(F.greatest(cell, F.lit(0)), F.lit(CELLS)))).otherwise(F.col("high"))

    return counted.select(*keys, "q", "at", "n", end(F.floor("at"), -1).alias("low"), end(F.ceil("at"), 2).alias("high"))


def _values_inside(x: DataFrame, brackets: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """keys, q, at, v, n: how often each value of a bracket occurs; a null v counts what lies below."""
    rows = _by_group(x, brackets.drop("n"), keys, few).filter("x <= high")
    value = F.when(F.col("x") >= F.col("low"), F.col("x"))
    return rows.groupBy(*keys, "q", "at", value.alias("v")).agg(F.count("*").alias("n"))


def brackets_of(x: DataFrame, base: DataFrame, keys: list[str], probabilities: Mapping[str, float], most_inside: int = MOST_INSIDE) -> tuple[DataFrame, bool]:
    """Brackets (keys, q, at, n, low, high) that hold at most ``most_inside`` rows strictly inside, and whether they are few."""
    brackets, few = _held(_first_brackets(base, keys, probabilities), "brackets")
    # A bracket holds 2 (REACH + sketch error) of the rows of its group, or all rows of a small one.
    share = 2 * (REACH + 1.0 / ACCURACY)
    largest = brackets.agg(F.max(F.when(F.col("n") < SMALL, F.col("n")).otherwise(F.col("n") * share))).first()[0] or 0
    while largest > most_inside:
        narrower, few = _held(_narrowed(x, brackets, keys, few), "brackets")
        most = narrower.agg(F.max("n")).first()[0] or 0
        if most <= most_inside:
            return brackets.drop("n"), few
        brackets, largest = narrower, math.ceil(most * 4 / CELLS)
    return brackets.drop("n"), few


def described_quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float], *by: str, statistics: Mapping[str, Column] | None = None, most_inside: int = MOST_INSIDE) -> DataFrame:
    """Every group with ``statistics`` (aggregates over its rows) and exact quantiles, linear between neighbours.

    Nulls of ``value`` don't count; groups without a value have null quantiles; a null group is a group. NaN counts as
    greater than all other values. Two passes over ``df`` where brackets are narrow at once.
    """
    statistics = dict(statistics or {})
    keys = [f"_k{j}" for j in range(len(by))]
    named = {f"_s{j}": c for j, c in enumerate(statistics.values())}
    ends = [min(1.0, max(0.0, p + side * REACH)) for p in probabilities.values() for side in (-1, 1)]
    number = F.col(value).cast("double")
    base = df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(
        F.count(number).alias("_n"),
        F.min(number).alias("_min"),
        F.max(number).alias("_max"),
        F.percentile_approx(number, F.array(*map(F.lit, ends)), ACCURACY).alias("_sketch"),
        *(c.alias(k) for k, c in named.items()),
    )
    base, _ = _held(base, "groups")
    x = df.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), number.alias("x")).filter("x is not null")
    brackets, few = brackets_of(x, base, keys, probabilities, most_inside)
    held = _values_inside(x, brackets, keys, few)
    upto = F.sum("n").over(Window.partitionBy(*keys, "q").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("end", upto)
    at_rank = lambda rank: F.max(F.when(F.col("v").isNotNull() & (rank < F.col("end")) & (rank >= F.col("end") - F.col("n")), F.col("v")))
    found = held.groupBy(*keys, "q", "at").agg(at_rank(F.floor("at")).alias("a"), at_rank(F.ceil("at")).alias("b"))
    missed = F.raise_error(F.lit("a bracket doesn't hold its rank")).cast("double")
    part = F.col("at") - F.floor("at")
    exact = F.when(part == 0, F.coalesce("a", missed)).otherwise(F.coalesce(F.col("a") * (1 - part) + F.col("b") * part, missed))
    wide = found.withColumn("y", exact).groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col("y"))).alias(f"_q{j}") for j, q in enumerate(probabilities)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys), F.lit(True))
    out = base.join(wide.withColumnsRenamed({k: f"{k}_of" for k in keys}), same, "left")
    return out.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), *(F.col(k).alias(c) for c, k in zip(statistics, named, strict=True)), *(F.col(f"_q{j}").alias(q) for j, q in enumerate(probabilities)))


def exact_quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float], *by: str, most_inside: int = MOST_INSIDE) -> DataFrame:
    """Exact quantiles of the values that are not null, a column for each name, for every group that has a value."""
    out = described_quantiles(df, value, probabilities, *by, statistics={"_count": F.count(F.col(value).cast("double"))}, most_inside=most_inside)
    return out.filter("_count > 0").drop("_count")
