"""Crosstabs, descriptions and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.operators import aggregate, clean, stats
from tallywork.plans.catalogue import r6, register, table


def _orders_with_segment(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select("c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice")


_CELLS = """
WITH j AS (SELECT c_mktsegment AS a, o_orderpriority AS b FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT a, b, count(*) AS n FROM j WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
g AS (SELECT a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT a FROM c) CROSS JOIN (SELECT DISTINCT b FROM c) LEFT JOIN c USING (a, b)),
m AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS rn, sum(n) OVER (PARTITION BY b) AS cn, sum(n) OVER () AS t FROM g),
e AS (SELECT *, rn * cn / t::DOUBLE AS e FROM m)
"""


@register("chi2_segment_priority", _CELLS + "SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof, CAST(sum(n) AS BIGINT) AS n FROM e")
def chi2_segment_priority(spark, d):
    return stats.chi_square(_orders_with_segment(spark, d), "c_mktsegment", "o_orderpriority").select(r6(F.col("chi2"), "chi2"), "dof", "n")


@register("expected_freq", _CELLS + "SELECT a AS segment, b AS priority, n, round(e, 2) AS expected FROM e")
def expected_freq(spark, d):
    cells = aggregate.crosstab(_orders_with_segment(spark, d), "c_mktsegment", "o_orderpriority")
    out = aggregate.expected(cells, "c_mktsegment", "o_orderpriority")
    return out.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), "n", F.round("expected", 2).alias("expected"))


@register("crosstab_margins", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS INT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def crosstab_margins(spark, d):
    return aggregate.margins(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register(
    "crosstab_flag_status",
    "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM lineitem GROUP BY l_returnflag",
)
def crosstab_flag_status(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().na.fill(0)
    return wide.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"))


_DESCRIBE = """count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@register("describe_quantity_by_flag", f"SELECT l_returnflag, {_DESCRIBE} FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY l_returnflag")
def describe_quantity_by_flag(spark, d):
    return _rounded(aggregate.describe(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"))


@register("describe_totalprice", f"SELECT {_DESCRIBE} FROM (SELECT o_totalprice AS x FROM orders)")
def describe_totalprice(spark, d):
    return _rounded(aggregate.describe(table(spark, d, "orders"), "o_totalprice"))


@register(
    "box_acctbal",
    """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS q50, quantile_cont(c_acctbal, 0.75) AS q75 FROM customer GROUP BY 1)
    SELECT c_mktsegment, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, min(c_acctbal) AS whisker_low, max(c_acctbal) AS whisker_high
    FROM customer JOIN q USING (c_mktsegment) WHERE c_acctbal BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) GROUP BY ALL""",
)
def box_acctbal(spark, d):
    out = aggregate.box(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


@register("value_counts_priority", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1")
def value_counts_priority(spark, d):
    return aggregate.value_counts(table(spark, d, "orders"), "o_orderpriority")


@register("distinct_counts", "SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n_rows"), F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@register(
    "argmin_argmax_price",
    "SELECT (SELECT p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 1) AS argmin, (SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1) AS argmax",
)
def argmin_argmax_price(spark, d):
    return aggregate.arg_extreme(table(spark, d, "part"), "p_name", "p_retailprice", "p_partkey")


_TWO = """s AS (SELECT count(x) FILTER (g = 0) AS n1, count(x) FILTER (g = 1) AS n2, avg(x) FILTER (g = 0) AS m1, avg(x) FILTER (g = 1) AS m2,
 var_samp(x) FILTER (g = 0) AS v1, var_samp(x) FILTER (g = 1) AS v2 FROM r WHERE g IN (0, 1)),
e AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS se FROM s)
SELECT round((m1 - m2) / se, 6) AS t, n1 + n2 - 2 AS dof, round(m1 - m2, 6) AS diff, round(se, 6) AS se FROM e"""


@register("ttest_pooled_quality", "WITH r AS (SELECT quality AS g, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), " + _TWO)
def ttest_pooled_quality(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return stats.pooled_t(rows, "n_chars", "quality", 0, 1).select(r6(F.col("t"), "t"), "dof", r6(F.col("diff"), "diff"), r6(F.col("se"), "se"))


_ONE = """SELECT n, round(m, 6) AS mean, round(sd, 6) AS sd, round((m - {mu}) / (sd / sqrt(n)), 6) AS t, n - 1 AS dof, round(sd / sqrt(n), 9) AS se
FROM (SELECT count({x}) AS n, avg({x}) AS m, stddev_samp({x}) AS sd FROM lineitem)"""


def _one_sample(df):
    return df.select("n", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), r6(F.col("t"), "t"), "dof", F.round("se", 9).alias("se"))


@register("ttest_onesample_discount", _ONE.format(x="l_discount", mu="0.05"))
def ttest_onesample_discount(spark, d):
    return _one_sample(stats.one_sample_t(table(spark, d, "lineitem"), "l_discount", 0.05))


@register("ttest_paired_discount_tax", _ONE.format(x="(l_discount - l_tax)", mu="0.0"))
def ttest_paired_discount_tax(spark, d):
    return _one_sample(stats.paired_t(table(spark, d, "lineitem"), "l_discount", "l_tax"))


_ANOVA = """g AS (SELECT g, count(x) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM r GROUP BY g),
t AS (SELECT sum(n * m) / sum(n) AS gm, count(*) - 1 AS df_between, sum(n) - count(*) AS df_within, sum((n - 1) * v) AS ss_within FROM g),
b AS (SELECT sum(n * (m - gm) * (m - gm)) AS ss_between FROM g, t)
SELECT CAST(df_between AS BIGINT) AS df_between, CAST(df_within AS BIGINT) AS df_within, round((ss_between / df_between) / (ss_within / df_within), 6) AS f FROM t, b"""


def _f(df):
    return df.select("df_between", "df_within", r6(F.col("f"), "f"))


@register("anova_oneway_acctbal_segment", "WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), " + _ANOVA)
def anova_oneway_acctbal_segment(spark, d):
    return _f(stats.one_way(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@register(
    "levene_acctbal",
    "WITH m AS (SELECT c_mktsegment AS g, median(c_acctbal) AS md FROM customer GROUP BY 1), r AS (SELECT c_mktsegment AS g, abs(c_acctbal - md) AS x FROM customer JOIN m ON c_mktsegment = g), " + _ANOVA,
)
def levene_acctbal(spark, d):
    return _f(stats.levene(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


@register(
    "anova_type2_quantity",
    """WITH c AS (SELECT l_linestatus AS a, l_returnflag AS b, count(*) AS n, avg(l_quantity) AS m, coalesce(var_samp(l_quantity), 0) AS v FROM lineitem GROUP BY 1, 2),
    p AS (SELECT b, coalesce(sum(n) FILTER (a = 'F'), 0) AS n0, coalesce(sum(n) FILTER (a = 'O'), 0) AS n1, sum(m) FILTER (a = 'F') AS m0, sum(m) FILTER (a = 'O') AS m1, sum((n - 1) * v) AS w FROM c GROUP BY b),
    q AS (SELECT *, n0 * n1 / (n0 + n1)::DOUBLE AS k, coalesce(m1 - m0, 0) AS g FROM p),
    s AS (SELECT sum(k * g) * sum(k * g) / sum(k) AS ss_a, sum(k * g * g) AS dd, sum(w) AS rss, sum(n0 + n1) AS n, count(*) AS lv, sum((n0 > 0)::INT + (n1 > 0)::INT) AS cells FROM q),
    ra AS (SELECT sum((n - 1) * v) AS r FROM (SELECT l_linestatus, count(*) AS n, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1))
    SELECT round(ss_a, 4) AS ss_a, round(r - (rss + dd - ss_a), 4) AS ss_b, round(dd - ss_a, 4) AS ss_ab, round(rss, 2) AS ss_residual, CAST(n - cells AS BIGINT) AS df_residual, lv - 1 AS df_b FROM s, ra""",
)
def anova_type2_quantity(spark, d):
    out = stats.two_way_by_two(table(spark, d, "lineitem"), "l_quantity", "l_linestatus", "l_returnflag")
    return out.select(*(F.round(c, 4).alias(c) for c in ("ss_a", "ss_b", "ss_ab")), F.round("ss_residual", 2).alias("ss_residual"), "df_residual", "df_b")


@register(
    "tukey_pairs_segment",
    """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
    e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
    SELECT a.g AS group1, b.g AS group2, round(b.m - a.m, 6) AS meandiff, round(sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS se,
    round(abs(b.m - a.m) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q FROM g a JOIN g b ON a.g < b.g, e""",
)
def tukey_pairs_segment(spark, d):
    out = stats.tukey_pairs(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("group1", "group2", r6(F.col("meandiff"), "meandiff"), r6(F.col("se"), "se"), r6(F.col("q"), "q"))


def _chi2_tail(x: str, dof: str) -> str:
    """P(X > x) for even degrees of freedom, as a finite sum."""
    return f"CASE WHEN {dof} = 0 THEN 1.0 ELSE exp(-({x}) / 2) * list_sum([exp(k * ln(greatest({x}, 1e-300) / 2) - lgamma(k + 1.0)) FOR k IN range(0, CAST({dof} // 2 AS BIGINT))]) END"


def _f_tail(f: str, df1: str, df2: str) -> str:
    """P(F > f) for an even number of degrees of freedom of the numerator, as a finite sum."""
    x, rest = f"({df2} / ({df2} + {df1} * ({f})::DOUBLE))", f"({df1} * ({f})::DOUBLE / ({df2} + {df1} * ({f})::DOUBLE))"
    return f"exp({df2} / 2.0 * ln({x})) * list_sum([exp(lgamma({df2} / 2.0 + j) - lgamma({df2} / 2.0) - lgamma(j + 1.0)) * pow({rest}, j) FOR j IN range(0, CAST({df1} // 2 AS BIGINT))])"


def _t_tail(t: str, dof: str) -> str:
    """P(|T| > t) by the finite sums for even and odd degrees of freedom."""
    angle = f"atan(({t}) / sqrt({dof}::DOUBLE))"
    even = f"sin({angle}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({angle}), 2 * k) FOR k IN range(0, CAST({dof} // 2 AS BIGINT))])"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({angle}), 2 * k) FOR k IN range(0, CAST(({dof} - 1) // 2 AS BIGINT))]), 0))"
    return f"(1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)"


def t_test_sql(source: str, keys: str = "") -> str:
    """SQL of a t-test over ``s`` (keys, t, dof, estimate, se): the quantile of each number of degrees by bisection."""
    return f"""WITH RECURSIVE {source},
    b AS (SELECT dof, 0.0::DOUBLE AS low, 100.0::DOUBLE AS high, 0 AS step FROM (SELECT DISTINCT dof FROM s WHERE dof > 0) UNION ALL
      SELECT dof, CASE WHEN p > 0.05 THEN middle ELSE low END, CASE WHEN p > 0.05 THEN high ELSE middle END, step + 1
      FROM (SELECT *, (low + high) / 2 AS middle, {_t_tail("(low + high) / 2", "dof")} AS p FROM b WHERE step < 60)),
    u AS (SELECT {keys} t, dof, {_t_tail("abs(t)", "dof")} AS p, estimate - high * se AS lower_end, estimate + high * se AS upper_end FROM s JOIN b USING (dof) WHERE step = 60)
    SELECT {keys} round(t, 6) AS t, CAST(dof AS BIGINT) AS dof, round(abs(p), 6) AS p, round(lower_end, 6) AS low, round(upper_end, 6) AS high, p < 0.05 AS reject_h0 FROM u"""


def _rounded_test(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register("tukey_test_segment_p")
def tukey_test_segment_p(spark, d):
    return stats.tukey_test(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")


_CHI = "SELECT {keys} sum((n - e) * (n - e) / e) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM e {group}"
_CHI_TEST = "SELECT {keys} round(x, 6) AS chi2, CAST(dof AS INT) AS dof, round({p}, 6) AS p, {p} < 0.05 AS reject_h0 FROM ({source})"


@register("chi2_segment_priority_p", _CELLS + _CHI_TEST.format(keys="", p=_chi2_tail("x", "dof"), source=_CHI.format(keys="", group="")))
def chi2_segment_priority_p(spark, d):
    return _rounded_test(stats.chi_square_test(_orders_with_segment(spark, d), "c_mktsegment", "o_orderpriority"), "chi2", "p")


@register(
    "chi2_by_nation",
    """WITH j AS (SELECT c_nationkey AS k, c_mktsegment AS a, o_orderpriority AS b FROM orders JOIN customer ON o_custkey = c_custkey),
    c AS (SELECT k, a, b, count(*) AS n FROM j GROUP BY ALL),
    g AS (SELECT k, a, b, coalesce(n, 0) AS n FROM (SELECT DISTINCT k, a FROM c) JOIN (SELECT DISTINCT k, b FROM c) USING (k) LEFT JOIN c USING (k, a, b)),
    e AS (SELECT *, sum(n) OVER (PARTITION BY k, a) * sum(n) OVER (PARTITION BY k, b) / (sum(n) OVER (PARTITION BY k))::DOUBLE AS e FROM g) """
    + _CHI_TEST.format(keys="k AS c_nationkey,", p=_chi2_tail("x", "dof"), source=_CHI.format(keys="k,", group="GROUP BY k")),
)
def chi2_by_nation(spark, d):
    """The same test for every nation by itself: one plan, a row for each."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return _rounded_test(stats.chi_square_test(rows, "c_mktsegment", "o_orderpriority", "c_nationkey"), "chi2", "p")


_POOLED = """r AS (SELECT quality AS g, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)),
    m AS (SELECT count(x) FILTER (g = 0) AS n1, count(x) FILTER (g = 1) AS n2, avg(x) FILTER (g = 0) AS m1, avg(x) FILTER (g = 1) AS m2, var_samp(x) FILTER (g = 0) AS v1, var_samp(x) FILTER (g = 1) AS v2 FROM r),
    w AS (SELECT *, n1 + n2 - 2 AS dof, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS se FROM m),
    s AS (SELECT (m1 - m2) / se AS t, dof, m1 - m2 AS estimate, se FROM w)"""


@register("ttest_pooled_quality_p", t_test_sql(_POOLED))
def ttest_pooled_quality_p(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return _rounded_test(stats.t_test(stats.pooled_t(rows, "n_chars", "quality", 0, 1), "diff"), "t", "p", "low", "high")


_SUPPLIER = """m AS (SELECT l_suppkey, count(l_discount) AS n, avg(l_discount) AS m, stddev_samp(l_discount) AS sd FROM lineitem GROUP BY 1),
    s AS (SELECT l_suppkey, (m - 0.04) / (sd / sqrt(n)) AS t, n - 1 AS dof, m AS estimate, sd / sqrt(n) AS se FROM m WHERE sd > 0)"""


@register("ttest_discount_by_supplier", t_test_sql(_SUPPLIER, "l_suppkey,"))
def ttest_discount_by_supplier(spark, d):
    """A test and an interval for every supplier, made on the executors."""
    tests = stats.t_test(stats.one_sample_t(table(spark, d, "lineitem"), "l_discount", 0.04, "l_suppkey"), "mean", "l_suppkey")
    return _rounded_test(tests.filter("t is not null"), "t", "p", "low", "high")


_F_TEST = """g AS (SELECT {keys} g, count(x) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM r GROUP BY ALL),
t AS (SELECT {keys} sum(n * m) / sum(n) AS gm, count(*) - 1 AS df1, sum(n) - count(*) AS df2, sum((n - 1) * v) AS ss_within FROM g {group}),
b AS (SELECT {keys} any_value(df1) AS df1, any_value(df2) AS df2, (sum(n * (m - gm) * (m - gm)) / any_value(df1)) / (any_value(ss_within) / any_value(df2)) AS f FROM g JOIN t {using} {group})
SELECT {keys} round(f, 6) AS f, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, round({p}, 6) AS p, {p} < 0.05 AS reject_h0 FROM b"""


@register("anova_oneway_acctbal_segment_p", "WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer), " + _F_TEST.format(keys="", group="", using="ON true", p=_f_tail("f", "df1", "df2")))
def anova_oneway_acctbal_segment_p(spark, d):
    return _rounded_test(stats.f_test(stats.one_way(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")), "f", "p")


@register(
    "anova_price_by_nation",
    "WITH r AS (SELECT c_nationkey, o_orderpriority AS g, o_totalprice AS x FROM orders JOIN customer ON o_custkey = c_custkey), "
    + _F_TEST.format(keys="c_nationkey,", group="GROUP BY c_nationkey", using="USING (c_nationkey)", p=_f_tail("f", "df1", "df2")),
)
def anova_price_by_nation(spark, d):
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return _rounded_test(stats.f_test(stats.one_way(rows, "o_totalprice", "o_orderpriority", "c_nationkey"), "c_nationkey"), "f", "p")


@register(
    "anova_type2_price_p",
    # The status has three levels: after the priorities are eliminated, two equations are left, solved in closed form.
    f"""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n, avg(o_totalprice) AS m, coalesce(var_samp(o_totalprice), 0) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    w AS (SELECT *, sum(n) OVER (PARTITION BY b) AS nb, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mb, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ma FROM c),
    q AS (SELECT a, sum(n * (m - mb)) AS q FROM w GROUP BY a),
    k AS (SELECT x.a AS r, y.a AS s, sum(CASE WHEN x.a = y.a THEN x.n ELSE 0 END - x.n * y.n / x.nb::DOUBLE) AS k FROM w x JOIN w y USING (b) GROUP BY ALL),
    p AS (SELECT (SELECT q FROM q WHERE a = 'F') AS qf, (SELECT q FROM q WHERE a = 'O') AS qo, (SELECT k FROM k WHERE r = 'F' AND s = 'F') AS ff, (SELECT k FROM k WHERE r = 'O' AND s = 'O') AS oo, (SELECT k FROM k WHERE r = 'F' AND s = 'O') AS fo),
    z AS (SELECT (qf * qf * oo - 2 * qf * qo * fo + qo * qo * ff) / (ff * oo - fo * fo) AS ss_a FROM p),
    t AS (SELECT sum(n * (m - ma) * (m - ma)) AS apart_a, sum(n * (m - mb) * (m - mb)) AS apart_b, sum((n - 1) * v) AS within, sum(n) - count(*) AS df, count(*) AS cells, count(DISTINCT a) AS la, count(DISTINCT b) AS lb FROM w),
    e AS (SELECT 'o_orderstatus' AS effect, ss_a AS ss, la - 1 AS dof, within, df FROM t, z UNION ALL SELECT 'o_orderpriority', apart_a - apart_b + ss_a, lb - 1, within, df FROM t, z
      UNION ALL SELECT 'o_orderstatus × o_orderpriority', apart_b - ss_a, cells - la - lb + 1, within, df FROM t, z UNION ALL SELECT 'residual', within, df, NULL, df FROM t),
    f AS (SELECT *, (ss / dof) / (within / df) AS f FROM e),
    g AS (SELECT *, CASE WHEN effect <> 'residual' THEN {_f_tail("f", "dof", "df")} END AS p FROM f)
    SELECT effect, round(ss / 1e6, 1) AS ss_millions, CAST(dof AS INT) AS dof, round(f, 4) AS f, round(p, 6) AS p,
    CASE WHEN p < 0.001 THEN 'p < .001' WHEN p < 0.05 THEN 'p < .05' ELSE 'not significant' END AS significance, p < 0.05 AS reject_h0 FROM g""",
)
def anova_type2_price_p(spark, d):
    out = stats.decide(stats.two_way(_orders_with_segment(spark, d), "o_totalprice", "o_orderstatus", "o_orderpriority"))
    return out.select("effect", F.round(F.col("ss") / 1e6, 1).alias("ss_millions"), "dof", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"), "significance", "reject_h0")


@register(
    "missing_codes_null",
    "SELECT count(*) AS n_before, count(*) FILTER (p_size NOT IN (1, 50)) AS n_after, count(*) FILTER (p_size IN (1, 50)) AS n_removed, round(avg(CASE WHEN p_size NOT IN (1, 50) THEN p_size END), 6) AS mean_size FROM part",
)
def missing_codes_null(spark, d):
    part = table(spark, d, "part").select(clean.missing_to_null(F.col("p_size"), [1, 50]).alias("p_size"))
    counts = part.agg(F.count("*").alias("n_before"), F.count("p_size").alias("n_after"), r6(F.avg("p_size"), "mean_size"))
    return counts.withColumn("n_removed", F.col("n_before") - F.col("n_after"))


@register("clean_codes_rows", "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 50) AND p_brand IS NOT NULL")
def clean_codes_rows(spark, d):
    return clean.clean_codes(table(spark, d, "part"), {"p_size": [1, 50]}, ["p_size", "p_brand"]).select("p_partkey", "p_size")


@register("removed_rows", "SELECT count(*) AS n_before, count(*) FILTER (o_orderstatus = 'F') AS n_after, count(*) FILTER (o_orderstatus <> 'F') AS n_removed FROM orders")
def removed_rows(spark, d):
    return clean.removed_rows(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@register(
    "recode_segment_left",
    "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' END AS code, count(*) AS n FROM customer GROUP BY 1",
)
def recode_segment_left(spark, d):
    code = clean.recode(F.col("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"})
    return table(spark, d, "customer").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@register(
    "recode_by_code_table",
    "SELECT label, count(*) AS n FROM orders LEFT JOIN (VALUES ('F', 'filled'), ('O', 'open')) c(o_orderstatus, label) USING (o_orderstatus) GROUP BY label",
)
def recode_by_code_table(spark, d):
    codes = spark.createDataFrame([("F", "filled"), ("O", "open")], "o_orderstatus string, label string")
    return clean.lookup(table(spark, d, "orders"), codes, "o_orderstatus").groupBy("label").agg(F.count("*").alias("n"))


@register("rename_keep_unmapped", "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS priority, count(*) AS n FROM orders GROUP BY 1")
def rename_keep_unmapped(spark, d):
    name = clean.rename_categories(F.col("o_orderpriority"), {"1-URGENT": "now", "5-LOW": "later"})
    return table(spark, d, "orders").groupBy(name.alias("priority")).agg(F.count("*").alias("n"))


@register("likert_index", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_discount + l_tax) / 3.0, 6) AS score, l_returnflag || '_' || l_linestatus AS cell FROM lineitem")
def likert_index(spark, d):
    score = clean.mean_index(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(score, "score"), clean.group_key("l_returnflag", "l_linestatus").alias("cell"))


@register("functional_dependency", "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_values FROM orders GROUP BY 1 HAVING n_values > 1")
def functional_dependency(spark, d):
    return clean.depends_on(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@register("leading_number", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INT) AS n FROM part")
def leading_number(spark, d):
    return table(spark, d, "part").select("p_partkey", clean.leading_number(F.col("p_brand")).alias("n"))


@register("isin_notequal_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P' AND o_totalprice > 1000")
def isin_notequal_filter(spark, d):
    rows = clean.keep_valid(table(spark, d, "orders"), {"o_orderpriority": ["1-URGENT", "2-HIGH"]}, {"o_orderstatus": ["P"]})
    return rows.filter("o_totalprice > 1000").select("o_orderkey")
