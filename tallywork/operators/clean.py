"""Cleaning and recoding of coded columns; every function gives a column or a frame and no pass of its own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_map(codes: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))


def missing_to_null(column: Column, codes: Iterable) -> Column:
    """Codes that stand for a missing value become null; nulls stay null."""
    return F.when(~column.isin(*codes), column)


def recode(column: Column, codes: Mapping) -> Column:
    """Value by value; what has no entry becomes null."""
    return F.try_element_at(literal_map(codes), column)


def rename_categories(column: Column, names: Mapping) -> Column:
    """Value by value; what has no entry keeps its label."""
    return F.coalesce(recode(column, names), column)


def keep_valid(df: DataFrame, valid: Mapping[str, Iterable] | None = None, refused: Mapping[str, Iterable] | None = None) -> DataFrame:
    """Rows whose columns hold only valid codes and none of the refused ones (a null is not refused)."""
    for name, codes in (valid or {}).items():
        df = df.filter(F.col(name).isin(*codes))
    for name, codes in (refused or {}).items():
        df = df.filter(~F.coalesce(F.col(name).isin(*codes), F.lit(False)))
    return df


def clean_codes(df: DataFrame, missing: Mapping[str, Iterable], required: Iterable[str] = ()) -> DataFrame:
    """Missing codes to null per column, then rows with a null in a required column go."""
    out = df.withColumns({name: missing_to_null(F.col(name), codes) for name, codes in missing.items()})
    required = list(required)
    return out.na.drop(subset=required) if required else out


def removed_rows(df: DataFrame, valid: Column) -> DataFrame:
    """n_before, n_after and n_removed in one pass."""
    counts = df.agg(F.count("*").alias("n_before"), F.count_if(valid).alias("n_after"))
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def mean_index(*items: Column) -> Column:
    """Mean of the items of a scale; null if any item is."""
    total = items[0]
    for item in items[1:]:
        total = total + item
    return total / F.lit(float(len(items)))


def leading_number(column: Column) -> Column:
    """The first run of digits in free text as an integer, else null."""
    return F.regexp_extract(column, r"(\d+)", 1).try_cast("int")


def group_key(*columns: str) -> Column:
    return F.concat_ws("_", *columns)


def depends_on(df: DataFrame, key: str, *dependents: str) -> DataFrame:
    """Keys that occur with more than one combination of the dependents (none: a functional dependency)."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*dependents)).alias("n_values")).filter("n_values > 1")


def lookup(df: DataFrame, codes: DataFrame, on: str, most_rows: int = 100_000) -> DataFrame:
    """Left join to a code table: broadcast if it is checked to be small, else a shuffled join."""
    small = codes.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(codes) if small else codes, on, "left")
