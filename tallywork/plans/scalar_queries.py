"""Strings, numbers, dates, arrays, maps, JSON and row-wise kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywork.functions import scalar as S
from tallywork.operators import aggregate
from tallywork.plans.catalogue import r6, register, table


@register(
    "bmi_projection",
    """WITH b AS (SELECT p_partkey, round((p_size + 40) / (((p_retailprice / 10 + 100) / 100.0) * ((p_retailprice / 10 + 100) / 100.0)), 1) AS bmi FROM part)
    SELECT p_partkey, bmi, CASE WHEN bmi >= 25 THEN 'over' WHEN bmi >= 18.5 THEN 'normal' WHEN bmi IS NOT NULL THEN 'under' END AS band FROM b""",
)
def bmi_projection(spark, d):
    value = F.round(S.bmi(F.col("p_size") + 40, F.col("p_retailprice") / 10 + 100), 1)
    return table(spark, d, "part").select("p_partkey", value.alias("bmi")).withColumn("band", S.bmi_band(F.col("bmi")))


@register("like_prefix_ci", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'p%1' OR p_type LIKE 'S%'")
def like_prefix_ci(spark, d):
    return table(spark, d, "part").filter(S.like_any_case(F.col("p_name"), "p%1") | F.col("p_type").startswith("S")).select("p_partkey", "p_name")


@register("substr_parts", "SELECT c_custkey, substr(c_name, 3) AS tail, substr(c_name, 3, 2) AS two, substr(c_name, 1, 1) AS first FROM customer")
def substr_parts(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.substring(name, F.lit(3), F.length(name)).alias("tail"), F.substring(name, 3, 2).alias("two"), F.substring(name, 1, 1).alias("first"))


@register(
    "string_toolkit",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_name) AS low, trim('  ' || p_name || ' ') AS stripped, p_name || p_brand AS joined, repeat(p_brand, 2) AS doubled,
    instr(p_name, 'a') - 1 AS first_a, CASE WHEN instr(p_name, 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END AS last_a,
    len(list_filter(string_split_regex(p_type, '\\s+'), lambda x: x <> '')) AS n_words, regexp_full_match(CAST(p_size AS VARCHAR), '[0-9]+') AS digits FROM part""",
)
def string_toolkit(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower(n).alias("low"), S.strip(F.concat(F.lit("  "), n, F.lit(" "))).alias("stripped"), F.concat(n, "p_brand").alias("joined"), F.repeat("p_brand", F.lit(2)).alias("doubled"),
        S.find(n, "a").alias("first_a"), S.find_last(n, "a").alias("last_a"), F.size(S.words(F.col("p_type"))).alias("n_words"), S.is_digits(F.col("p_size").cast("string")).alias("digits"),
    )


@register(
    "format_numbers",
    "SELECT o_orderkey, printf('%04d', o_orderkey) AS padded, printf('%+d', o_orderkey) AS signed, format('{:,}', o_orderkey) AS grouped, printf('%.2f', o_totalprice) AS price, printf('%012.2f', o_totalprice) AS wide FROM orders",
)
def format_numbers(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.format_string("%04d", k).alias("padded"), F.format_string("%+d", k).alias("signed"), F.format_string("%,d", k).alias("grouped"), S.fixed(p, 2).alias("price"), S.fixed(p, 2, 12, zeros=True).alias("wide"))


@register("char_repeat", "SELECT n_nationkey, list_aggregate(list_transform(string_split(n_name, ''), lambda c: repeat(c, 3)), 'string_agg', '') AS repeated FROM nation")
def char_repeat(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.repeat_each(F.col("n_name"), F.lit(3)).alias("repeated"))


_LETTERS = " || ' ' || ".join(f"CAST(instr(lower(n_name), '{chr(c)}') - 1 AS VARCHAR)" for c in range(97, 123))


@register("alphabet_positions", f"SELECT n_nationkey, {_LETTERS} AS positions FROM nation")
def alphabet_positions(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.letter_positions(F.lower("n_name")).alias("positions"))


@register(
    "hotel_room",
    "WITH r AS (SELECT o_orderkey, (o_orderkey + 6) % 7 + 1 AS f, CAST(ceil(o_orderkey / 7.0) AS BIGINT) AS r FROM orders) SELECT o_orderkey, f || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS room FROM r",
)
def hotel_room(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.room_number(F.lit(7), F.col("o_orderkey")).alias("room"))


@register(
    "alarm_45",
    "WITH t AS (SELECT event_id, ((hour(ts) * 60 + minute(ts) - 45) % 1440 + 1440) % 1440 AS m FROM events) SELECT event_id, CAST(m // 60 AS INT) AS h, CAST(m % 60 AS INT) AS m FROM t",
)
def alarm_45(spark, d):
    hour, minute = S.minutes_earlier(F.hour("ts"), F.minute("ts"), 45)
    return table(spark, d, "events").select("event_id", hour.alias("h"), minute.alias("m"))


@register(
    "right_triangle",
    """WITH s AS (SELECT p_partkey, list_sort([p_size % 13, p_partkey % 13, (p_size + p_partkey) % 14]) AS l FROM part)
    SELECT p_partkey, l[1] > 0 AND l[1] * l[1] + l[2] * l[2] = l[3] * l[3] AS is_right FROM s""",
)
def right_triangle(spark, d):
    a, b = F.col("p_size").cast("long"), F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", S.right_triangle(a % 13, b % 13, (a + b) % 14).alias("is_right"))


@register(
    "scale_class",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr('1234567812345678', CAST(p_partkey % 8 + 1 AS INT), 8) WHEN 1 THEN substr('8765432187654321', CAST(p_partkey % 8 + 1 AS INT), 8) ELSE '12345' || CAST(p_partkey % 1000 AS VARCHAR) END AS notes FROM part)
    SELECT p_partkey, notes, CASE WHEN length(notes) = 8 AND contains('1234567812345678', notes) THEN 'ascending' WHEN length(notes) = 8 AND contains('8765432187654321', notes) THEN 'descending' ELSE 'mixed' END AS kind FROM s""",
)
def scale_class(spark, d):
    k = F.col("p_partkey")
    at = (k % 8 + 1).cast("int")
    notes = F.when(k % 3 == 0, F.substring(F.lit("1234567812345678"), at, F.lit(8))).when(k % 3 == 1, F.substring(F.lit("8765432187654321"), at, F.lit(8))).otherwise(F.concat(F.lit("12345"), (k % 1000).cast("string")))
    return table(spark, d, "part").select("p_partkey", notes.alias("notes")).withColumn("kind", S.scale_class(F.col("notes")))


@register("digits_concat", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_orderkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) AS BIGINT) - l_partkey AS value FROM lineitem")
def digits_concat(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.digits_sum(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("value"))


@register("codon_counts", "SELECT piece, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(text) + 1, 3), lambda i: substr(text, i, 3))) AS piece FROM documents) GROUP BY piece")
def codon_counts(spark, d):
    return aggregate.piece_counts(table(spark, d, "documents"), "text", 3)


@register("symbol_counts", "SELECT " + ", ".join(f"CAST(sum(length(text) - length(replace(text, '{c}', ''))) AS BIGINT) AS n_{c}" for c in "atgc") + " FROM documents")
def symbol_counts(spark, d):
    return aggregate.symbol_counts(table(spark, d, "documents"), "text", "atgc")


@register(
    "math_functions",
    """SELECT p_partkey, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t, CAST(floor(p_retailprice) AS BIGINT) AS lo, CAST(ceil(p_retailprice) AS BIGINT) AS hi,
    round(sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS hyp, round(4.0 / 3 * 3.14159 * p_size * p_size * p_size, 4) AS volume, round(pow(p_size, 3), 6) AS cube,
    CAST(factorial(p_size % 10) AS BIGINT) AS fact, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS fdiv, CAST((p_size - 25) - 7 * floor((p_size - 25) / 7.0) AS BIGINT) AS fmod FROM part""",
)
def math_functions(spark, d):
    x, p = F.col("p_size"), F.col("p_retailprice")
    off = x.cast("long") - 25
    return table(spark, d, "part").select(
        "p_partkey", r6(F.sin(x), "s"), r6(F.cos(x), "c"), r6(F.tan(x), "t"), F.floor(p).alias("lo"), F.ceil(p).alias("hi"), r6(F.hypot(x, p), "hyp"),
        F.round(F.lit(4.0) / 3 * F.lit(3.14159) * x * x * x, 4).alias("volume"), r6(F.pow(x, F.lit(3)), "cube"), F.factorial(x % 10).alias("fact"),
        S.floor_div(off, F.lit(7)).alias("fdiv"), S.floor_mod(off, F.lit(7)).cast("long").alias("fmod"),
    )


@register(
    "dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd, strftime(o_orderdate, '%Y/%m/%d') AS shown,
    strftime(o_orderdate + INTERVAL 8 DAY, '%Y-%m-%d') AS later, strftime(o_orderdate + INTERVAL 14 MONTH, '%Y-%m-%d') AS moved FROM orders""",
)
def dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.year(t).alias("y"), F.month(t).alias("m"), F.dayofmonth(t).alias("dd"), F.date_format(t, "yyyy/MM/dd").alias("shown"), F.date_format(t + F.expr("INTERVAL '8' DAY"), "yyyy-MM-dd").alias("later"), F.date_format(F.add_months(t, 14), "yyyy-MM-dd").alias("moved"))


@register("view_birth_parts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS bdate, strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%d') AS dd FROM orders")
def view_birth_parts(spark, d):
    table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("bdate")).createOrReplaceTempView("tallywork_dated")
    year, month, day = S.date_parts(F.col("bdate"))
    out = spark.sql("SELECT o_orderkey, bdate FROM tallywork_dated").select("o_orderkey", "bdate", year.alias("yyyy"), month.alias("mm"), day.alias("dd"))
    spark.catalog.dropTempView("tallywork_dated")  # the frame holds the plan of the view
    return out


@register(
    "array_ops",
    """WITH a AS (SELECT p_partkey, [p_size, 3, 1, 3, p_size] AS l FROM part)
    SELECT p_partkey, CAST(list_sort(l) AS VARCHAR) AS up, CAST(list_reverse(l) AS VARCHAR) AS back, CAST(list_concat(l, l) AS VARCHAR) AS doubled, len(list_distinct(l)) AS n_distinct,
    list_contains(l, 50) AS has50, list_max(l) AS hi, CAST(list_sum(l) AS BIGINT) AS total, CAST(list_transform(l, lambda x: x * x) AS VARCHAR) AS squares, CAST(list_filter(l, lambda x: x % 2 = 1) AS VARCHAR) AS odd, CAST(l[2:3] AS VARCHAR) AS part FROM a""",
)
def array_ops(spark, d):
    a = F.array(F.col("p_size"), F.lit(3), F.lit(1), F.lit(3), F.col("p_size"))
    show = lambda c, n: F.concat(F.lit("["), S.join_text(c, ", "), F.lit("]")).alias(n)
    return table(spark, d, "part").select(
        "p_partkey", show(F.array_sort(a), "up"), show(F.reverse(a), "back"), show(S.twice(a), "doubled"), F.size(F.array_distinct(a)).alias("n_distinct"), F.array_contains(a, 50).alias("has50"), F.array_max(a).alias("hi"),
        F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), show(F.transform(a, lambda x: x * x), "squares"), show(F.filter(a, lambda x: x % 2 == 1), "odd"), show(F.slice(a, 2, 2), "part"),
    )


@register("list_edit", "SELECT p_partkey, CASE WHEN p_size = 3 THEN '1,3,9' WHEN p_size = 1 THEN '3,3,9' ELSE '1,3,3,9' END AS without_first FROM part")
def list_edit(spark, d):
    items = F.array(F.lit(1), F.lit(3), F.lit(3), F.lit(9))
    size = F.when(F.col("p_size") == 9, F.lit(0)).otherwise(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", S.join_text(S.remove_first(items, size), ",").alias("without_first"))


@register(
    "map_ops",
    "SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS absent, CAST(user_id AS VARCHAR) AS replaced, CAST(2 AS INT) AS n_keys, 'kind,user' AS sorted_keys FROM events",
)
def map_ops(spark, d):
    m = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.lit("old"), F.lit("gone"), F.lit("x"))
    m = S.without_key(S.put(m, F.lit("user"), F.col("user_id").cast("string")), F.lit("gone"))
    rows = table(spark, d, "events").select("event_id", m.alias("m"))
    return rows.select("event_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("none")).alias("absent"), F.try_element_at("m", F.lit("user")).alias("replaced"), F.size("m").alias("n_keys"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("sorted_keys"))


@register("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, '{\"id\":' || event_id || ',\"q\":null}' AS reply FROM events")
def json_props(spark, d):
    reply = S.as_json(F.struct(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("q")))
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), reply.alias("reply"))


@register("json_records", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_records(spark, d):
    return table(spark, d, "events").select("event_id", S.parse_record(F.col("props"), "k int")["k"].alias("k"))


@register("cast_skip", "SELECT CAST([1, 2, 3, 5, 6] AS VARCHAR) AS kept")
def cast_skip(spark, d):
    items = F.array(*(F.lit(x) for x in ("1", "2", "3", "four", "5", "6")))
    return spark.range(1).select(F.concat(F.lit("["), S.join_text(S.numbers_in(items), ", "), F.lit("]")).alias("kept"))


@register("csv_list_parse", "SELECT n_nationkey, len(string_split(n_name || ' , b,c', ',')) AS n, trim(string_split(n_name || ' , b,c', ',')[1]) AS first FROM nation")
def csv_list_parse(spark, d):
    items = S.parse_list(F.concat("n_name", F.lit(" , b,c")))
    return table(spark, d, "nation").select("n_nationkey", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first"))


@register("running_sum_threshold", "WITH r AS (SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderkey) AS s FROM orders) SELECT min(o_orderkey) AS first_key, count(*) AS n_after FROM r WHERE s >= 1000000")
def running_sum_threshold(spark, d):
    # Sums of ranges of keys first, so that no task runs through all rows.
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").withColumn("band", F.floor(F.col("o_orderkey") / 1024))
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = o.groupBy("band").agg(F.sum("o_totalprice").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0.0))).drop("s")
    run = F.sum("o_totalprice").over(Window.partitionBy("band").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    return o.withColumn("run", run).join(starts, "band").filter(F.col("run") + F.col("start") >= 1_000_000).agg(F.min("o_orderkey").alias("first_key"), F.count("*").alias("n_after"))


@register("cross_product", "SELECT r_regionkey, n_nationkey, r_regionkey * n_nationkey AS product FROM region CROSS JOIN nation")
def cross_product(spark, d):
    pairs = table(spark, d, "region").crossJoin(table(spark, d, "nation"))
    return pairs.select("r_regionkey", "n_nationkey", (F.col("r_regionkey") * F.col("n_nationkey")).alias("product"))


@register("fib_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 35) SELECT n, a AS fib FROM f")
def fib_recursive(spark, d):
    return spark.range(36).select(F.col("id").alias("n"), S.fibonacci(F.col("id").cast("int")).alias("fib"))


@register("argmax_function", "SELECT max_by(i, i * (100 - i)) AS i, max(i * (100 - i)) AS value FROM range(1, 100) t(i)")
def argmax_function(spark, d):
    i = F.col("id")
    return spark.range(1, 100).agg(F.max_by(i, i * (100 - i)).alias("i"), F.max(i * (100 - i)).alias("value"))


@register("pyramid_lines", "SELECT i AS line, repeat(' ', CAST(6 - i AS INT)) || repeat('*', CAST(2 * i + 1 AS INT)) AS text FROM range(0, 7) t(i)")
def pyramid_lines(spark, d):
    lines = spark.range(1).select(F.posexplode(S.pyramid(F.lit(7))).alias("line", "text"))
    return lines.select(F.col("line").cast("long").alias("line"), "text")


@register("partition_count", "SELECT 437420::BIGINT AS ways")
def partition_count(spark, d):
    return spark.range(1).select(F.lit(S.partitions_of(100)).cast("long").alias("ways"))


@register("sign_and_interval", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' WHEN c_acctbal < 0 THEN 'negative' ELSE 'zero' END AS sign, NOT (c_acctbal BETWEEN 0 AND 5000) AS outside FROM customer")
def sign_and_interval(spark, d):
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", S.sign_name(x).alias("sign"), (~x.between(0, 5000)).alias("outside"))
