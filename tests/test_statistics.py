"""Distribution tails against published values, and tests against cell statistics of survey fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from tallywork.functions import special
from tallywork.operators import stats

CROSSTAB = {"Left": [14, 19, 19, 77, 87, 68], "Neutral": [45, 37, 47, 45, 44, 58], "Right": [97, 67, 67, 9, 14, 7]}


def cell_rows(n: int, mean: float, sd: float) -> list[float]:
    """n values with exactly this mean and sample deviation."""
    half = n // 2
    x = [1.0] * half + [-1.0] * half + [0.0] * (n % 2)
    scale = sd * math.sqrt((n - 1) / sum(v * v for v in x))
    return [mean + scale * v for v in x]


def test_tails():
    assert special.chi2_sf(281.3236272334706, 10) == pytest.approx(1.3686157659860877e-54, rel=1e-9)
    assert special.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert special.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert special.studentized_range_cdf(3.877, 3, 10) == pytest.approx(0.95, abs=5e-4)
    assert special.studentized_range_cdf(3.633, 4, math.inf) == pytest.approx(0.95, abs=5e-4)
    assert special.studentized_range_quantile(0.95, 4, 899) == pytest.approx(3.63996, abs=1e-3)


def test_chi_square(spark):
    rows = [(a, b, k) for a, counts in CROSSTAB.items() for b, n in enumerate(counts) for k in range(n)]
    df = spark.createDataFrame(rows, "a string, b int, k int")
    r = stats.chi_square(df, "a", "b").first()
    assert (r["chi2"], r["dof"], r["n"]) == (pytest.approx(281.3236272334706), 10, 821)
    assert stats.chi_square_test(df, "a", "b").first()["p"] == pytest.approx(1.3686157659860877e-54, rel=1e-6)


def test_pooled_t_and_one_way(spark):
    cells = {1: (429, 50.33566433566433, 11.972872797589268), 2: (474, 54.938818565400844, 11.47340206954608)}
    df = spark.createDataFrame([(g, v) for g, c in cells.items() for v in cell_rows(*c)], "g int, y double")
    r = stats.t_test(stats.pooled_t(df, "y", "g", 1, 2), "diff").first()
    assert r["t"] == pytest.approx(-5.8972487, abs=1e-6) and r["dof"] == 901
    assert r["p"] == pytest.approx(5.2236e-09, rel=1e-3) and (r["low"], r["high"]) == (pytest.approx(-6.135081, abs=1e-5), pytest.approx(-3.071228, abs=1e-5))
    f = stats.f_test(stats.one_way(df, "y", "g")).first()
    assert f["f"] == pytest.approx(r["t"] ** 2) and f["p"] == pytest.approx(r["p"], rel=1e-6)


def test_tukey(spark):
    cells = {"Analyst": (186, 45.96774193548387, 11.564111877798135), "Diplomat": (254, 56.48031496062992, 10.648795432779352), "Sentinel": (227, 52.89867841409691, 11.385962014210536), "Explorer": (236, 53.94491525423729, 11.89140291963244)}
    df = spark.createDataFrame([(g, v) for g, c in cells.items() for v in cell_rows(*c)], "g string, y double")
    got = {(r["group1"], r["group2"]): r for r in stats.tukey_test(df, "y", "g").collect()}
    one = got["Diplomat", "Sentinel"]
    assert (one["meandiff"], one["p_adj"], one["low"], one["high"]) == (pytest.approx(-3.5816, abs=1e-4), pytest.approx(0.0033, abs=2e-4), pytest.approx(-6.2515, abs=1e-3), pytest.approx(-0.9117, abs=1e-3))
    assert not got["Diplomat", "Explorer"]["reject_h0"] and got["Diplomat", "Explorer"]["p_adj"] == pytest.approx(0.0655, abs=5e-4)
    f = stats.one_way(df, "y", "g").first()
    assert f["f"] == pytest.approx(32.128292, abs=1e-5)


def test_two_way_forms_agree(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("a"), (F.col("id") % 7 % 3).alias("b"), ((F.col("id") * 37) % 101).cast("double").alias("y"))
    lazy = stats.two_way_by_two(df, "y", "a", "b").first()
    full = {r["effect"]: r for r in stats.two_way(df, "y", "a", "b").collect()}
    assert (lazy["ss_a"], lazy["ss_b"], lazy["ss_ab"]) == (pytest.approx(full["a"]["ss"]), pytest.approx(full["b"]["ss"]), pytest.approx(full["a × b"]["ss"]))
    assert lazy["df_residual"] == full["residual"]["dof"] == 394


def test_two_way_with_an_empty_cell(spark):
    df = spark.createDataFrame([("x", "p", 1.0), ("x", "p", 2.0), ("x", "q", 4.0), ("y", "p", 3.0), ("y", "p", 5.0), ("z", "q", 4.5)], "a string, b string, y double")
    assert {r["effect"] for r in stats.two_way(df, "y", "a", "b").collect()} == {"a", "b", "a × b", "residual"}


def test_interval_of_a_mean_and_one_sample_p(spark):
    df = spark.createDataFrame([(v,) for v in cell_rows(913, 5.096386, 1.507844)], "x double")
    got = stats.t_test(stats.one_sample_t(df, "x", 5.0), "mean").first()
    assert (got["t"], got["p"]) == (pytest.approx(1.9314826, abs=2e-5), pytest.approx(0.0537330, abs=3e-6))
    assert (got["low"], got["high"]) == (pytest.approx(4.998449, abs=2e-6), pytest.approx(5.194322, abs=2e-6)) and not got["reject_h0"]


def test_paired_p(spark):
    df = spark.createDataFrame([(v + 1.0, 1.0) for v in cell_rows(913, 0.640745, 1.020709)], "a double, b double")
    got = stats.t_test(stats.paired_t(df, "a", "b"), "mean").first()
    assert got["t"] == pytest.approx(18.9678691, abs=1e-4) and math.log10(got["p"]) == pytest.approx(math.log10(6.9276e-68), abs=1e-3) and got["reject_h0"]


def test_exact_quantiles_against_a_sort(spark):
    import random

    from tallywork.operators import aggregate, quantiles

    pick = random.Random(2)
    data = {"a": [pick.gauss(0, 1) for _ in range(999)], "b": [pick.choice([1.0, 2.0, 1e9]) for _ in range(500)], "c": [5.0] * 7, None: [3.0, 4.0], "e": [1.0]}
    rows = [(g, v) for g, values in data.items() for v in values] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, v double")

    def linear(values, p):
        values, at = sorted(values), (len(values) - 1) * p
        low = int(at)
        return values[low] if at == low else values[low] * (1 - at + low) + values[low + 1] * (at - low)

    ps = {"p0": 0.0, "p1": 0.1, "p5": 0.5, "p9": 0.93, "p10": 1.0}
    got = {r["g"]: [r[k] for k in ps] for r in quantiles.exact_quantiles(df, "v", ps, "g").collect()}
    assert set(got) == set(data)
    for g, values in data.items():
        assert got[g] == pytest.approx([linear(values, p) for p in ps.values()])
    assert quantiles.exact_quantiles(df.limit(0), "v", ps, "g").count() == 0
    described = {r["g"]: r for r in aggregate.describe(df, "v", "g").collect()}
    assert described["f"]["count"] == 0 and described["f"]["q50"] is None and described[None]["q50"] == 3.5


def test_quantiles_of_heavy_tails_and_ties_sort_few_values(spark):
    import numpy as np

    from tallywork.operators import quantiles

    make = np.random.default_rng(6)
    tail = np.concatenate([make.lognormal(0, 3, 120_000), [1e12, -1e12]])
    ties = np.concatenate([np.zeros(60_000), np.ones(58_000), make.uniform(0, 1, 2_001)])
    rows = [(g, float(v)) for g, values in (("tail", tail), ("ties", ties)) for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    ps = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q999": 0.999}
    x = df.selectExpr("g as _k0", "v as x")
    for most in (1_000_000, 40):
        for r in quantiles.exact_quantiles(df, "v", ps, "g", most_inside=most).collect():
            assert [r[k] for k in ps] == pytest.approx(list(np.quantile(tail if r["g"] == "tail" else ties, list(ps.values()))), rel=1e-12)
        base = df.groupBy(F.col("g").alias("_k0")).agg(
            F.count("v").alias("_n"), F.min("v").alias("_min"), F.max("v").alias("_max"),
            F.percentile_approx("v", F.array(*(F.lit(min(1.0, max(0.0, p + s * quantiles.REACH))) for p in ps.values() for s in (-1, 1))), quantiles.ACCURACY).alias("_sketch"),
        )
        brackets, few = quantiles.brackets_of(x, base, ["_k0"], ps, most)
        # What one task sorts: the distinct values of a bracket.
        sizes = quantiles._values_inside(x, brackets, ["_k0"], few).groupBy("_k0", "q").agg(F.count("v").alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= min(most + 2, 200) and sizes.count() == 10
    alone = quantiles.exact_quantiles(df.filter("g = 'tail'"), "v", ps).first()
    assert list(alone) == pytest.approx(list(np.quantile(tail, list(ps.values()))), rel=1e-12)


def test_quantiles_of_many_groups_stay_a_table(spark, monkeypatch):
    from tallywork.operators import quantiles

    monkeypatch.setattr(quantiles, "MOST_ROWS", 100)
    df = spark.range(6000).select((F.col("id") % 600).alias("g"), (F.col("id") * 7919 % 6000).alias("v"))
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.expr("percentile(v, 0.3)").alias("m")).collect()}
    got = {r["g"]: r["p"] for r in quantiles.exact_quantiles(df, "v", {"p": 0.3}, "g").collect()}
    assert got == pytest.approx(want) and len(got) == 600


GENDER_PERSONALITY = {
    (1, 1): (86, 44.06976744186046, 11.3901822509557), (1, 2): (125, 54.176, 10.149737005968312), (1, 3): (106, 50.424528301886795, 12.274594834323878), (1, 4): (112, 50.776785714285715, 12.188245571690377),
    (2, 1): (100, 47.6, 11.51897863036774), (2, 2): (129, 58.713178294573645, 10.683072034802313), (2, 3): (121, 55.06611570247934, 10.108359195232167), (2, 4): (124, 56.806451612903224, 10.895421145634032),
}
REALISM_CONTEXT = {
    (1, 1): (115, 5.034782608695652), (1, 2): (118, 4.864406779661017), (1, 3): (108, 4.851851851851852), (1, 4): (117, 4.94017094017094),
    (2, 1): (117, 6.418803418803419), (2, 2): (110, 5.818181818181818), (2, 3): (117, 6.282051282051282), (2, 4): (111, 5.396396396396397),
}


def test_two_way_of_gender_and_personality(spark):
    rows = [(a, b, v) for (a, b), cell in GENDER_PERSONALITY.items() for v in cell_rows(*cell)]
    got = {r["effect"]: r for r in stats.two_way(spark.createDataFrame(rows, "a int, b int, y double"), "y", "a", "b").collect()}
    want = {"a": (5071.228022, 1, 40.993689, 2.4624e-10), "b": (12731.956568, 3, 34.306606, 5.4272e-21), "a × b": (168.694731, 3, 0.454553, 0.714140)}
    for effect, (ss, dof, f, p) in want.items():
        assert (got[effect]["ss"], got[effect]["dof"], got[effect]["f"]) == (pytest.approx(ss, abs=1e-4), dof, pytest.approx(f, abs=1e-5))
        assert got[effect]["p"] == pytest.approx(p, rel=1e-4)
    assert (got["residual"]["ss"], got["residual"]["dof"]) == (pytest.approx(110718.238775, abs=1e-4), 895)


def test_two_way_of_realism_and_context(spark):
    # The residual sum of squares is spread over the cells in proportion to their degrees of freedom.
    sd = math.sqrt(354.995339 / 905)
    rows = [(a, b, v) for (a, b), (n, mean) in REALISM_CONTEXT.items() for v in cell_rows(n, mean, sd)]
    df = spark.createDataFrame(rows, "realism int, context int, y double")
    got = {r["effect"]: r for r in stats.decide(stats.two_way(df, "y", "realism", "context")).collect()}
    want = {"realism": (254.420023, 648.600405, 2.5999e-108), "context": (41.085745, 34.913697, 2.3502e-21), "realism × context": (35.189298, 29.903035, 1.9451e-18)}
    for effect, (ss, f, p) in want.items():
        assert (got[effect]["ss"], got[effect]["f"]) == (pytest.approx(ss, abs=1e-5), pytest.approx(f, abs=1e-4)) and got[effect]["p"] == pytest.approx(p, rel=1e-3)
        assert got[effect]["significance"] == "p < .001" and got[effect]["reject_h0"]
    assert got["residual"]["dof"] == 905 and got["residual"]["p"] is None


def least_squares(rows):
    """Type II sums of squares by least squares on the rows themselves."""
    import numpy as np

    y = np.array([r[-1] for r in rows])
    mark = lambda k: np.array([[float(r[k] == level) for level in sorted({r[k] for r in rows})] for r in rows])
    a, b = mark(0), mark(1)
    cells = np.array([[float(r[:2] == c) for c in sorted({r[:2] for r in rows})] for r in rows])

    def fit(*parts):
        x = np.hstack([np.ones((len(y), 1)), *parts])
        beta, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
        return float(((y - x @ beta) ** 2).sum()), int(rank)

    (ra, ka), (rb, kb), (rab, kab), (rc, kc) = fit(a), fit(b), fit(a, b), fit(cells)
    return {"a": (rb - rab, kab - kb), "b": (ra - rab, kab - ka), "a × b": (rab - rc, kc - kab), "residual": (rc, len(y) - kc)}


def test_two_way_for_any_levels_and_keys(spark):
    import numpy as np

    make, tables = np.random.default_rng(4), {}
    for key, (na, nb, n) in {"three by four": (3, 4, 300), "six by two": (6, 2, 90), "sparse": (5, 5, 22), "one": (1, 3, 30), None: (2, 2, 40)}.items():
        tables[key] = [(int(i), int(j), float(i * 2 - j + make.normal() * 3)) for i, j in zip(make.integers(0, na, n), make.integers(0, nb, n), strict=True)]
    df = spark.createDataFrame([(k, *r) for k, rows in tables.items() for r in rows], "key string, a int, b int, y double")
    got: dict = {}
    for r in stats.two_way(df, "y", "a", "b", "key").collect():
        got.setdefault(r["key"], {})[r["effect"]] = r
    assert set(got) == set(tables)
    for key, rows in tables.items():
        for effect, (ss, dof) in least_squares(rows).items():
            r = got[key][effect]
            assert (r["ss"], r["dof"]) == (pytest.approx(ss, abs=1e-7), dof), (key, effect)
            assert (r["f"] is None) == (effect == "residual" or dof == 0)


def test_tests_of_thousands_of_keys_without_collecting(spark):
    import random

    pick = random.Random(3)
    data: dict = {}
    for key in range(3000):
        data[key] = [(pick.choice("ab"), pick.choice("xyz"), pick.gauss(key % 3, 1 + key % 2)) for _ in range(pick.randint(3, 14))]
    df = spark.createDataFrame([(k, *r) for k, rows in data.items() for r in rows], "key long, g string, h string, y double").repartition(4)
    t = {r["key"]: r for r in stats.t_test(stats.one_sample_t(df, "y", 1.0, "key"), "mean", "key").collect()}
    two = {r["key"]: r for r in stats.t_test(stats.pooled_t(df, "y", "g", "a", "b", "key"), "diff", "key").collect()}
    f = {r["key"]: r for r in stats.f_test(stats.one_way(df, "y", "g", "key"), "key").collect()}
    chi = {r["key"]: r for r in stats.chi_square_test(df, "g", "h", "key").collect()}
    assert len(t) == len(two) == len(f) == len(chi) == 3000
    for key, rows in data.items():
        y = [r[2] for r in rows]
        n, mean = len(y), sum(y) / len(y)
        se = math.sqrt(sum((v - mean) ** 2 for v in y) / (n - 1) / n)
        assert t[key]["t"] == pytest.approx((mean - 1) / se) and t[key]["p"] == pytest.approx(special.t_two_sided((mean - 1) / se, n - 1), rel=1e-9)
        if key < 200:
            assert t[key]["high"] - mean == pytest.approx(special.t_quantile(0.975, n - 1) * se, rel=1e-8)
        sizes = {g: sum(r[0] == g for r in rows) for g in "ab"}
        if min(sizes.values()) and n > 2:
            assert f[key]["p"] == pytest.approx(two[key]["p"], rel=1e-8) and f[key]["f"] == pytest.approx(two[key]["t"] ** 2)
        else:
            assert two[key]["p"] is None and f[key]["p"] is None
        cells = {(g, h): sum(r[:2] == (g, h) for r in rows) for g in {r[0] for r in rows} for h in {r[1] for r in rows}}
        levels = [len({c[k] for c in cells}) for k in (0, 1)]
        dof, chi2 = (levels[0] - 1) * (levels[1] - 1), 0.0
        for (g, h), count in cells.items():
            e = sum(v for c, v in cells.items() if c[0] == g) * sum(v for c, v in cells.items() if c[1] == h) / n
            gap = abs(count - e)
            chi2 += (gap - (min(0.5, gap) if dof == 1 else 0)) ** 2 / e
        assert (chi[key]["chi2"], chi[key]["dof"]) == (pytest.approx(chi2, abs=1e-9), dof)
        assert chi[key]["p"] == pytest.approx(special.chi2_sf(chi2, dof) if dof else 1.0, abs=1e-9)


def test_tails_as_columns(spark):
    from tallywork.functions import tails

    grid = [(x, float(d)) for d in (1, 2, 3, 7, 30, 901, 20_000) for x in (0.01, 0.7, 1.96, 5.0, 40.0)]
    x, d = F.col("x"), F.col("d")
    named = {"t": tails.t_two_sided(x, d), "f": tails.f_sf(x, F.lit(3), d), "c": tails.chi2_sf(x * d, d), "q": tails.t_quantile(0.995, d)}
    for r in spark.createDataFrame(grid, "x double, d double").select("x", "d", *(c.alias(k) for k, c in named.items())).collect():
        want = (special.t_two_sided(r["x"], r["d"]), special.f_sf(r["x"], 3, r["d"]), special.chi2_sf(r["x"] * r["d"], r["d"]), special.t_quantile(0.995, r["d"]))
        assert [r[k] for k in "tfcq"] == [pytest.approx(w, rel=1e-8) for w in want]
    # Large degrees of freedom: the limits are the normal and the chi-square distribution.
    r = spark.range(1).select(tails.t_two_sided(F.lit(5.0), F.lit(1e12)).alias("t"), tails.f_sf(F.lit(5.0), F.lit(7), F.lit(1e12)).alias("f"), tails.t_quantile(0.975, F.lit(1e9)).alias("q"), tails.t_two_sided(F.lit(None), F.lit(3)).alias("n"), tails.t_quantile(0.9, F.lit(0)).alias("z")).first()
    assert r["t"] == pytest.approx(math.erfc(5 / math.sqrt(2)), rel=1e-8) and r["f"] == pytest.approx(special.chi2_sf(35.0, 7), rel=1e-8) and r["q"] == pytest.approx(1.9599639845, abs=1e-8)
    assert r["n"] is None and r["z"] is None
