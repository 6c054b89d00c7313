"""Joins by order against brute force, with hot keys and without nested loops."""

import random

from pyspark.sql import functions as F

from tallywork.operators import intervals as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join_against_all_pairs(spark):
    pick = random.Random(2)
    points = [(k, pick.choice(["a", "b", None]), pick.choice([pick.uniform(-50, 50), float(pick.randint(-9, 9)), None])) for k in range(700)] + [(k, "a", 3.0) for k in range(1000, 1400)] + [(1500, "a", 6.0), (1501, "b", float("inf")), (1502, "a", 1e300)]
    spans = [(j, pick.choice(["a", "b"]), low := pick.choice([float(pick.randint(-9, 9)), pick.uniform(-60, 60)]), low + pick.choice([0.0, 1e-12, 0.3, 1.0, 4.0, 4.0000000004, 16.0, 100.0, -2.0, pick.random() * 40])) for j in range(150)] + [(900, "a", None, 1.0), (901, None, 0.0, 9.0), (902, "b", -1e9, 1e9), (903, "a", 3.9999999999, 8.0000000003)]
    left = spark.createDataFrame(points, "id long, g string, x double").repartition(4)
    right = spark.createDataFrame(spans, "span long, g string, low double, high double")
    for closed in (False, True):
        inside = lambda x, a, b: x is not None and a is not None and a <= x and (x <= b if closed else x < b)  # noqa: B023, E731
        got = I.interval_join(left, right.drop("g"), "x", "low", "high", closed=closed, split=20)
        assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
        want = sorted((p, s) for p, _, x in points for s, _, a, b in spans if inside(x, a, b))
        assert sorted((r["id"], r["span"]) for r in got.collect()) == want
        keyed = I.interval_join(left, right, "x", "low", "high", ["g"], closed=closed, split=20)
        want = sorted((p, s) for p, g, x in points for s, h, a, b in spans if g is not None and g == h and inside(x, a, b))
        assert sorted((r["id"], r["span"]) for r in keyed.collect()) == want and set(keyed.columns) == {"id", "g", "x", "span", "low", "high"}
    assert I.interval_join(left, right.limit(0).drop("g"), "x", "low", "high").count() == 0 and I.interval_join(left.limit(0), right.drop("g"), "x", "low", "high").count() == 0


def brute_asof(left, right):
    out = []
    for k, g, t in left:
        before = [(s, v) for h, s, v in right if g is not None and t is not None and h == g and s is not None and s <= t]
        out.append((k, max(before, key=lambda r: (r[0], r[1] is not None, r[1] or 0))[1] if before else None))
    return sorted(out)


def test_asof_join_with_a_hot_key(spark):
    pick = random.Random(8)
    key = lambda: pick.choice(["hot", "hot", "hot", "b", "c", None])
    left = [(k, key(), pick.choice([pick.randint(0, 2000), pick.randint(0, 2000), None])) for k in range(600)]
    right = [(key(), pick.choice([pick.randint(0, 2000), pick.randint(0, 2000), None]), pick.choice([None, pick.random()])) for _ in range(500)] + [("late", 5000, 1.0)]
    one, two = spark.createDataFrame(left, "id long, g string, t long").repartition(3), spark.createDataFrame(right, "g string, t long, v double").repartition(3)
    for buckets in (1, 16):
        got = I.asof_join(one, two, "g", "t", ["v"], buckets)
        assert "NestedLoop" not in plan(got) and sorted((r["id"], r["v"]) for r in got.select("id", "v").collect()) == brute_asof(left, right)
    # What one window task can hold of the hot key.
    rows = one.select("g", F.col("t").alias("_time"))
    sizes = rows.filter("g = 'hot'").withColumn("b", I.time_buckets(rows, "_time", 16)).filter("_time is not null").groupBy("b").count()
    assert sizes.count() >= 14 and sizes.agg(F.max("count")).first()[0] < 60
    assert I.asof_join(one, two.limit(0), "g", "t", ["v"]).filter("v is not null").count() == 0 and I.asof_join(one.limit(0), two, "g", "t", ["v"]).count() == 0
