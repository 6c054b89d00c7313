"""Frequencies, crosstabs and descriptive statistics, each with one grouped pass over the data."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywork.operators.quantiles import described_quantiles, exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequencies of the values that are not null, most frequent first, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def crosstab(df: DataFrame, row: str, column: str, *by: str) -> DataFrame:
    """Long form (row, column, n) with zeros for empty cells, of rows without nulls; a table of its own for each key ``by``."""
    counts = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(*by, row, column).agg(F.count("*").alias("n"))
    # The categories of two variables: the grid has as many rows as the table has cells.
    sets = counts.groupBy(*by).agg(F.collect_set(row).alias("_rows"), F.collect_set(column).alias("_columns"))
    grid = sets.select(*by, F.explode("_rows").alias(row), "_columns").select(*by, row, F.explode("_columns").alias(column))
    names = [*by, row, column]
    held = counts.withColumnsRenamed({c: f"{c}_of" for c in names})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in names))
    return grid.join(held, same, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


def margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """All cells, row sums, column sums and the total in one pass; level says which (grouping bits)."""
    return df.cube(row, column).agg(F.count("*").alias("n"), F.grouping_id(row, column).cast("int").alias("level"))


def expected(cells: DataFrame, row: str, column: str, n: str = "n", *by: str) -> DataFrame:
    """Cells with row_n, column_n, total and the expected count."""
    total = lambda *of: F.sum(n).over(Window.partitionBy(*by, *of))
    out = cells.withColumns({"row_n": total(row), "column_n": total(column), "total": total()})
    return out.withColumn("expected", F.col("row_n") * F.col("column_n") / F.col("total"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear) and max of a column, by group or over all."""
    x = F.col(value).cast("double")
    statistics = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
    out = described_quantiles(df, value, QUARTILES, *by, statistics=statistics)
    return out.select(*by, "count", "mean", "std", "min", *QUARTILES, "max")


def box(df: DataFrame, value: str, by: str) -> DataFrame:
    """What a box plot draws: quartiles and the whiskers, the farthest values within 1.5 interquartile ranges."""
    x = F.col(value).cast("double")
    q = exact_quantiles(df.filter(F.col(by).isNotNull()), value, QUARTILES, by)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = df.join(q, by).filter(x.between(F.col("q25") - reach, F.col("q75") + reach))
    return inside.groupBy(by, "q25", "q50", "q75").agg(F.min(x).alias("whisker_low"), F.max(x).alias("whisker_high"))


def arg_extreme(df: DataFrame, label: str, by: str, order: str) -> DataFrame:
    """Labels of the smallest and the largest value; of equal ones the first in ``order``."""
    key = F.struct(F.col(by), F.col(order))
    low = F.struct(F.negative(F.col(by)), F.col(order))
    return df.agg(F.min_by(label, key).alias("argmin"), F.min_by(label, low).alias("argmax"))


def symbol_counts(df: DataFrame, text: str, symbols: str) -> DataFrame:
    """How often each given symbol occurs over all rows, zero included."""
    s = F.col(text)
    columns = [F.coalesce(F.sum(F.length(s) - F.length(F.replace(s, F.lit(c)))), F.lit(0)).cast("long").alias(f"n_{c}") for c in symbols]
    return df.agg(*columns)


def pieces_of(text: Column, width: int) -> Column:
    """Pieces of ``width`` characters without overlap (the last may be shorter); none of an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def piece_counts(df: DataFrame, text: str, width: int) -> DataFrame:
    # The outer form: else a filter on the size of the array makes all pieces twice.
    return df.select(F.explode_outer(pieces_of(F.col(text), width)).alias("piece")).filter("piece is not null").groupBy("piece").agg(F.count("*").alias("n"))
