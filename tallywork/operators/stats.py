"""Hypothesis tests: sufficient statistics in one grouped pass, closed forms on the few rows that remain.

Every test takes key columns ``by`` and gives a row (or a row for each effect or pair) per key; without any, one for the
whole table. Probabilities and intervals are columns (``functions.tails``): nothing is collected. Where a statistic is
not defined (no spread, too few rows) it and its probability are null. A null key is a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.functions import special, tails
from tallywork.operators.aggregate import crosstab, expected
from tallywork.operators.quantiles import exact_quantiles


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on equal names, null matching null; no names: ``right`` has one row."""
    if not on:
        return left.crossJoin(right)
    other = right.withColumnsRenamed({k: f"{k}_right" for k in on})
    return left.join(other, reduce(and_, (F.col(k).eqNullSafe(F.col(f"{k}_right")) for k in on))).drop(*(f"{k}_right" for k in on))


def _chi_square_sums(df: DataFrame, row: str, column: str, *by: str) -> DataFrame:
    cells = expected(crosstab(df, row, column, *by), row, column, "n", *by)
    e, gap = F.col("expected"), F.abs(F.col("n") - F.col("expected"))
    closer = gap - F.least(F.lit(0.5), gap)
    sums = cells.groupBy(*by).agg(F.sum(gap * gap / e).alias("chi2"), F.sum(closer * closer / e).alias("corrected"), F.count_distinct(row).alias("rows"), F.count_distinct(column).alias("columns"), F.sum("n").alias("n"))
    return sums.withColumn("dof", (F.col("rows") - 1) * (F.col("columns") - 1))


def chi_square(df: DataFrame, row: str, column: str, *by: str) -> DataFrame:
    """chi2, dof and n of the test of independence (without a continuity correction)."""
    return _chi_square_sums(df, row, column, *by).select(*by, "chi2", "dof", "n")


def chi_square_test(df: DataFrame, row: str, column: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """With a 2 x 2 table the statistic has Yates' correction; one row or column of cells has p = 1."""
    sums = _chi_square_sums(df, row, column, *by).withColumn("chi2", F.when(F.col("dof") == 1, F.col("corrected")).otherwise(F.col("chi2")))
    p = F.when(F.col("dof") == 0, 1.0).otherwise(tails.chi2_sf(F.col("chi2"), F.col("dof")))
    return sums.select(*by, "chi2", F.col("dof").cast("int").alias("dof"), p.alias("p")).withColumn("reject_h0", F.col("p") < alpha)


def moments(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean and variance by group: what all tests on means need."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("variance"))


def pooled_t(df: DataFrame, value: str, group: str, first, second, *by: str) -> DataFrame:
    """t, dof, the difference of means and its standard error for two groups of equal variance."""
    x, g = F.col(value).cast("double"), F.col(group)
    side = lambda f, k: f(F.when(g == F.lit(k), x))
    s = df.filter(g.isin(first, second)).groupBy(*by).agg(*(side(f, k).alias(f"{name}{i}") for i, k in enumerate((first, second), 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    s = s.withColumn("dof", F.col("n1") + F.col("n2") - 2).withColumn("diff", F.col("m1") - F.col("m2"))
    pooled = F.try_divide((F.col("n1") - 1) * F.coalesce("v1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("v2", F.lit(0.0)), F.col("dof"))
    s = s.withColumn("se", F.sqrt(pooled * (F.try_divide(F.lit(1), F.col("n1")) + F.try_divide(F.lit(1), F.col("n2")))))
    return s.select(*by, F.try_divide("diff", "se").alias("t"), "dof", "diff", "se")


def one_sample_t(df: DataFrame, value: str, mean: float, *by: str) -> DataFrame:
    x = F.col(value).cast("double")
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    s = s.withColumn("se", F.try_divide("sd", F.sqrt("n")))
    return s.select(*by, "n", "mean", "sd", F.try_divide(F.col("mean") - mean, F.col("se")).alias("t"), (F.col("n") - 1).alias("dof"), "se")


def paired_t(df: DataFrame, first: str, second: str, *by: str) -> DataFrame:
    return one_sample_t(df.select(*by, (F.col(first).cast("double") - F.col(second).cast("double")).alias("_d")), "_d", 0.0, *by)


def t_test(statistics: DataFrame, estimate: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """p (two-sided) and the confidence interval of ``estimate`` of every row with t, dof and se."""
    reach = tails.t_quantile(1 - alpha / 2, F.col("dof")) * F.col("se")
    p = tails.t_two_sided(F.col("t"), F.col("dof"))
    out = statistics.select(*by, "t", F.col("dof").cast("long").alias("dof"), p.alias("p"), F.col(estimate).alias("_estimate"), reach.alias("_reach"))
    low, high = F.col("_estimate") - F.col("_reach"), F.col("_estimate") + F.col("_reach")
    return out.select(*by, "t", "dof", "p", low.alias("low"), high.alias("high"), (F.col("p") < alpha).alias("reject_h0"))


def one_way(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """f, dof and sums of squares between and within groups."""
    g = moments(df, value, *by, group)
    total = g.groupBy(*by).agg(F.sum("n").alias("_n"), F.count("*").alias("_k"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"), F.sum((F.col("n") - 1) * F.col("variance")).alias("ss_within"))
    away = F.col("mean") - F.col("_mean")
    s = _joined(g, total, by).groupBy(*by, "_n", "_k", "ss_within").agg(F.sum(F.col("n") * away * away).alias("ss_between"))
    out = s.select(*by, "ss_between", "ss_within", (F.col("_k") - 1).alias("df_between"), (F.col("_n") - F.col("_k")).alias("df_within"))
    return out.withColumn("f", F.try_divide(F.try_divide("ss_between", "df_between"), F.try_divide("ss_within", "df_within")))


def f_test(statistics: DataFrame, *by: str, alpha: float = 0.05) -> DataFrame:
    p = tails.f_sf(F.col("f"), F.col("df_between"), F.col("df_within"))
    out = statistics.select(*by, "f", F.col("df_between").cast("long").alias("df1"), F.col("df_within").cast("long").alias("df2"), p.alias("p"))
    return out.withColumn("reject_h0", F.col("p") < alpha)


def levene(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Equality of variances around the group medians: a one-way analysis of the distances."""
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull() & F.col(group).isNotNull())
    medians = exact_quantiles(rows, value, {"_median": 0.5}, *by, group)
    away = _joined(rows.select(*by, group, x.alias("_x")), medians, [*by, group]).select(*by, group, F.abs(F.col("_x") - F.col("_median")).alias("_away"))
    return one_way(away, "_away", group, *by)


def _normal_equations(cells: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Per key: matrix, the rows of the equations for the levels of ``b`` after those of ``a`` are eliminated, with the
    right side as last element, and diagonal, the sizes of the levels.

    ``cells`` has n, mean and, by level of ``a``, n_a and mean_a. The matrix is summed up from pairs of cells of one
    level of ``a``; a key's row holds the square of its levels of ``b``.
    """
    one = cells.select(*by, F.col(a).alias("_a"), F.col(b).alias("_row"), F.col("n").alias("_n1"), "n_a")
    two = cells.select(*by, F.col(a).alias("_a"), F.col(b).alias("_column"), F.col("n").alias("_n2"))
    same = F.when(F.col("_row").eqNullSafe(F.col("_column")), F.col("_n1")).otherwise(0)
    entries = _joined(one, two, [*by, "_a"]).groupBy(*by, "_row", "_column").agg(F.sum(same - F.col("_n1") * F.col("_n2") / F.col("n_a")).alias("v"))
    lines = entries.groupBy(*by, "_row").agg(F.map_from_entries(F.collect_list(F.struct("_column", "v"))).alias("line"))
    right = cells.groupBy(*by, F.col(b).alias("_row")).agg(F.sum(F.col("n") * (F.col("mean") - F.col("mean_a"))).alias("q"), F.sum("n").cast("double").alias("size"))
    items = F.sort_array(F.collect_list(F.struct("_row", "q", "size", F.map_entries("line").alias("line"))))
    each = _joined(lines, right, [*by, "_row"]).groupBy(*by).agg(items.alias("_rows"))
    row_of = lambda r: F.concat(F.transform("_rows", lambda c: F.coalesce(F.try_element_at(F.map_from_entries(r["line"]), c["_row"]), F.lit(0.0))), F.array(r["q"]))
    return each.select(*by, F.transform("_rows", row_of).alias("matrix"), F.transform("_rows", lambda r: r["size"]).alias("diagonal"))


def _eliminate(matrix: Column, diagonal: Column) -> Column:
    """ss and rank: Gaussian elimination of symmetric equations, whose pivots weigh the squares of their right sides.

    A pivot that is nothing beside the size of its level belongs to a level that the others determine: it is passed.
    """

    def step(s: Column, k: Column) -> Column:
        pivot = F.get(F.get(s["m"], k), k)
        real = pivot > F.get(diagonal, k) * 1e-9
        line = F.get(s["m"], k)
        below = F.transform(s["m"], lambda row: F.zip_with(row, line, lambda x, y: x - F.get(row, k) * y / pivot))
        q = F.element_at(line, -1)
        return F.struct(F.when(real, below).otherwise(s["m"]).alias("m"), F.when(real, s["ss"] + q * q / pivot).otherwise(s["ss"]).alias("ss"), (s["rank"] + real.cast("int")).alias("rank"))

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("ss"), F.lit(0).alias("rank"))
    return F.aggregate(F.sequence(F.lit(0), F.size(matrix) - 1), start, step, lambda s: F.struct(s["ss"].alias("ss"), s["rank"].alias("rank")))


def two_way(df: DataFrame, value: str, a: str, b: str, *by: str) -> DataFrame:
    """Type II sums of squares of two factors and their interaction: effect, ss, dof, f and p, with a residual.

    Main effects are judged against the model with both main effects, the interaction against the full model. Any
    number of levels and empty cells are allowed: the normal equations of ``b`` after ``a`` come from the statistics of
    the cells and are solved in array functions. Rows without a level are left out.
    """
    cells = moments(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), value, *by, a, b)
    level = lambda c, n, m: cells.groupBy(*by, c).agg(F.sum("n").alias(n), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias(m))
    cells = _joined(_joined(cells, level(a, "n_a", "mean_a"), [*by, a]), level(b, "n_b", "mean_b"), [*by, b])
    apart = lambda m: F.sum(F.col("n") * (F.col("mean") - F.col(m)) * (F.col("mean") - F.col(m)))
    sums = cells.groupBy(*by).agg(
        apart("mean_a").alias("_apart_a"), apart("mean_b").alias("_apart_b"), F.sum((F.col("n") - 1) * F.col("variance")).alias("_within"),
        F.sum("n").alias("_n"), F.count("*").alias("_cells"), F.count_distinct(a).alias("_levels_a"), F.count_distinct(b).alias("_levels_b"),
    )
    solved = _normal_equations(cells, a, b, by).select(*by, _eliminate(F.col("matrix"), F.col("diagonal")).alias("_b"))
    t = _joined(sums, solved, by)
    ss_b, rank, both = F.col("_b.ss"), F.col("_b.rank"), F.col("_levels_a") + F.col("_b.rank")
    ss_a, ss_ab = F.col("_apart_b") - F.col("_apart_a") + ss_b, F.col("_apart_a") - ss_b
    df_within = (F.col("_n") - F.col("_cells")).cast("int")
    effects = [(a, ss_a, both - F.col("_levels_b")), (b, ss_b, rank), (f"{a} × {b}", ss_ab, F.col("_cells") - both), ("residual", F.col("_within"), df_within)]
    rows = F.array(*(F.struct(F.lit(name).alias("effect"), ss.alias("ss"), dof.cast("int").alias("dof")) for name, ss, dof in effects))
    out = t.select(*by, "_within", df_within.alias("_df_within"), F.explode(rows).alias("_e")).select(*by, "_within", "_df_within", "_e.*")
    f = F.when(F.col("effect") != "residual", F.try_divide(F.try_divide("ss", "dof"), F.try_divide("_within", "_df_within")))
    return out.withColumn("f", f).select(*by, "effect", "ss", "dof", "f", tails.f_sf(F.col("f"), F.col("dof"), F.col("_df_within")).alias("p"))


def two_way_by_two(df: DataFrame, value: str, a: str, b: str) -> DataFrame:
    """The same in one lazy plan where factor ``a`` has exactly two levels: ss and dof of each effect and the residual."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x = F.col(value).cast("double")
    low = rows.agg(F.min(a).alias("_low"))
    cells = moments(rows, value, a, b).crossJoin(low)
    side = lambda column, first: F.sum(F.when((F.col(a) == F.col("_low")) == first, F.col(column)))
    per_b = cells.groupBy(b).agg(side("n", True).alias("n0"), side("n", False).alias("n1"), side("mean", True).alias("m0"), side("mean", False).alias("m1"), F.sum((F.col("n") - 1) * F.col("variance")).alias("within"))
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    weight = n0 * n1 / (n0 + n1)
    gap = F.coalesce(F.col("m1") - F.col("m0"), F.lit(0.0))
    s = per_b.agg(F.sum(weight * gap).alias("wd"), F.sum(weight).alias("w"), F.sum(weight * gap * gap).alias("wdd"), F.sum("within").alias("rss_cells"), F.sum(n0 + n1).alias("n"), F.count("*").alias("levels"), F.sum((n0 > 0).cast("int") + (n1 > 0).cast("int")).alias("cells"))
    by_a = moments(rows, value, a).agg(F.sum((F.col("n") - 1) * F.col("variance")).alias("rss_a"))
    t = s.crossJoin(by_a)
    ss_a = F.col("wd") * F.col("wd") / F.col("w")
    both = F.col("rss_cells") + F.col("wdd") - ss_a
    return t.select(ss_a.alias("ss_a"), (F.col("rss_a") - both).alias("ss_b"), (both - F.col("rss_cells")).alias("ss_ab"), F.col("rss_cells").alias("ss_residual"), (F.col("n") - F.col("cells")).alias("df_residual"), (F.col("levels") - 1).alias("df_b"))


def tukey_pairs(df: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """Every pair of groups (in order of labels) with the difference of means, its standard error and q."""
    g = moments(df.filter(F.col(group).isNotNull()), value, *by, group)
    error = g.groupBy(*by).agg(F.try_divide(F.sum((F.col("n") - 1) * F.col("variance")), F.sum("n") - F.count("*")).alias("mse"), (F.sum("n") - F.count("*")).alias("dof"), F.count("*").alias("k"))
    one = g.select(*by, F.col(group).alias("group1"), F.col("n").alias("na"), F.col("mean").alias("ma"))
    two = g.select(*by, F.col(group).alias("group2"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
    # Pairs of group labels, not of rows.
    pairs = _joined(one, two, by).filter("group1 < group2")
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    diff = F.col("mb") - F.col("ma")
    return _joined(pairs, error, by).select(*by, "group1", "group2", diff.alias("meandiff"), se.alias("se"), F.try_divide(F.abs(diff), se).alias("q"), "dof", "k")


def tukey_test(df: DataFrame, value: str, group: str, *by: str, alpha: float = 0.05) -> DataFrame:
    """p and intervals of all pairs, adjusted by the studentised range; its integrals run on the rows of pairs, in batches."""

    @F.pandas_udf("double")
    def adjusted(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
        known = q.notna() & dof.notna() & (dof > 0)
        return pd.Series([special.studentized_range_sf(*r) if ok else None for ok, *r in zip(known, q, k, dof, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def critical(k: pd.Series, dof: pd.Series) -> pd.Series:
        found = {}
        for r in set(zip(k, dof, strict=True)):
            found[r] = special.studentized_range_quantile(1 - alpha, *r) if r[1] > 0 else None
        return pd.Series([found[r] for r in zip(k, dof, strict=True)], dtype="float64")

    pairs = tukey_pairs(df, value, group, *by)
    rows = pairs.withColumns({"p_adj": adjusted("q", "k", "dof"), "_reach": critical("k", "dof")})
    reach = F.col("_reach") * F.col("se")
    return rows.select(*by, F.col("group1").cast("string").alias("group1"), F.col("group2").cast("string").alias("group2"), "meandiff", "p_adj", (F.col("meandiff") - reach).alias("low"), (F.col("meandiff") + reach).alias("high"), (F.col("q") > F.col("_reach")).alias("reject_h0"))


def decide(effects: DataFrame, alpha: float = 0.05) -> DataFrame:
    """significance in bands and reject_h0 for a frame with a column p."""
    band = F.when(F.col("p") < 0.001, "p < .001").when(F.col("p") < 0.05, "p < .05").otherwise("not significant")
    return effects.withColumns({"significance": band, "reject_h0": F.col("p") < alpha})


def effect_label(term: Column) -> Column:
    """C(a):C(b) as a × b."""
    return F.regexp_replace(F.regexp_replace(term, r"C\((\w+)\)", "$1"), ":", " × ")
