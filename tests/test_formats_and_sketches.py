"""Decimals as printf writes them, and sketches that keep no state for single keys."""

import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tallywork.functions import scalar as S
from tallywork.plans import catalogue

ODD = [0.0, -0.0, -0.001, 0.005, 0.125, 0.375, -0.625, 0.995, 1.005, 2.675, 1.115, 99.995, 0.045, 0.055, 0.0625, 2.0**-8, 1e-300, 12345678.125, 1e15 + 0.125, 2.0**53, 9e18, 0.05, 0.15, 0.25, 0.35, 9.95]


def test_fixed_rounds_the_exact_value_of_a_double(spark):
    pick = random.Random(3)
    values = ODD + [-x for x in ODD] + [pick.randint(-10**6, 10**6) / 1000 for _ in range(3000)] + [pick.randint(0, 200) / 1000 for _ in range(300)] + [pick.uniform(-1e4, 1e4) for _ in range(300)]
    x = F.col("x")
    shown = [S.fixed(x, 2, 10), S.fixed(x, 2, 10, zeros=True), S.fixed(x, 2, 10, plus=True), S.fixed(x, 2, 10, plus=True, zeros=True), S.fixed(x, 1), S.fixed(x, 2)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select("x", *shown).collect()
    formats = ("%10.2f", "%010.2f", "%+10.2f", "%+010.2f", "%.1f", "%.2f")
    assert [tuple(r)[1:] for r in rows] == [tuple(f % v for f in formats) for v in values] + [(None,) * 6]


def test_format_decimals_against_sql_on_odd_balances(spark, tmp_path):
    balances = ODD + [-x for x in ODD] + [float("nan"), float("inf"), float("-inf")]
    frame = pd.DataFrame({"c_custkey": range(len(balances)), "c_acctbal": balances})
    con = duckdb.connect()
    con.execute(f"COPY (SELECT c_custkey, c_acctbal FROM frame UNION ALL SELECT 1000, NULL) TO '{tmp_path}/customer.parquet'")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(catalogue.oracle_sql()["format_decimals"]).fetchall()
    got = catalogue.queries()["format_decimals"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_approximations_keep_no_sketch_for_each_key(spark, sf_dir):
    plan = catalogue.queries()["approximations"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if re.search(r"Aggregate\(keys?=\[l_orderkey", line)]
    assert lines and not any("percentile_approx" in line or "approx_count_distinct" in line for line in lines)
