"""Lists, maps, nested records, formats, rounding, type dispatch and composition of stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywork.functions import scalar as S
from tallywork.operators import stats
from tallywork.operators import text as X
from tallywork.operators.order import numbered
from tallywork.plans.catalogue import r6, register, table
from tallywork.plans.statistics_queries import t_test_sql


def _shown(items):
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


@register(
    "list_insert_append",
    """WITH l AS (SELECT p_partkey, [p_size, 2, 3] AS l FROM part) SELECT p_partkey, array_to_string(list_append(l, 9), ',') AS appended,
    array_to_string(list_concat(l[1:1], [7], l[2:3]), ',') AS inserted, array_to_string(list_concat(list_concat([0], l), [4, 5]), ',') AS spread FROM l""",
)
def list_insert_append(spark, d):
    items = F.array(F.col("p_size"), F.lit(2), F.lit(3))
    spread = F.concat(F.array(F.lit(0)), items, F.array(F.lit(4), F.lit(5)))
    return table(spark, d, "part").select("p_partkey", _shown(F.array_append(items, F.lit(9))).alias("appended"), _shown(S.insert_at(items, 1, F.lit(7))).alias("inserted"), _shown(spread).alias("spread"))


@register(
    "list_delete",
    """WITH l AS (SELECT p_partkey, [p_size, 2, 3, 4, 5] AS l FROM part) SELECT p_partkey, array_to_string(list_concat(l[1:1], l[3:5]), ',') AS without_index,
    array_to_string(list_concat(l[1:1], l[4:5]), ',') AS without_slice, 0 AS n_cleared FROM l""",
)
def list_delete(spark, d):
    items = F.array(F.col("p_size"), *(F.lit(k) for k in (2, 3, 4, 5)))
    return table(spark, d, "part").select("p_partkey", _shown(S.delete_slice(items, 1, 2)).alias("without_index"), _shown(S.delete_slice(items, 1, 3)).alias("without_slice"), F.size(F.slice(items, 1, 0)).alias("n_cleared"))


@register("flatten_lists", "SELECT n_nationkey, n_nationkey || ',1,2,' || n_regionkey AS one_level, n_nationkey || ',1,2,' || n_regionkey || ',9' AS two_levels FROM nation")
def flatten_lists(spark, d):
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    pairs = F.array(F.array(k, F.lit(1).cast("long")), F.array(F.lit(2).cast("long"), r))
    deeper = F.array(pairs, F.array(F.array(F.lit(9).cast("long"))))
    return table(spark, d, "nation").select("n_nationkey", _shown(F.flatten(pairs)).alias("one_level"), _shown(F.flatten(F.flatten(deeper))).alias("two_levels"))


@register("flatten_json", "SELECT n_nationkey, n_nationkey || '|a\"b|1e5|true|' || n_name || '|-2.5' AS scalars FROM nation")
def flatten_json(spark, d):
    text = F.concat(F.lit("[["), F.col("n_nationkey").cast("string"), F.lit(', ["a\\"b", [1e5]]], true, ["'), F.col("n_name"), F.lit('", [[-2.5]]]]'))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(S.deep_flatten(text), "|").alias("scalars"))


@register("explode_nested", "SELECT n_nationkey, k, v FROM nation, (VALUES (0, 1), (0, 2), (1, 3)) t(k, w), LATERAL (SELECT n_nationkey * 10 + w AS v)")
def explode_nested(spark, d):
    at = lambda w: (F.col("n_nationkey") * 10 + w).cast("long")
    rows = table(spark, d, "nation").select("n_nationkey", F.posexplode(F.array(F.array(at(1), at(2)), F.array(at(3)))).alias("k", "inner"))
    return rows.select("n_nationkey", "k", F.explode("inner").alias("v"))


@register("map_build", "SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, true AS has_name, false AS has_age, 'name=' || n_name || ';region=' || n_regionkey AS pairs FROM nation")
def map_build(spark, d):
    keys, values = F.array(F.lit("name"), F.lit("region")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))
    zipped = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.concat_ws("=", z["k"], z["v"]))
    m = F.map_from_arrays(keys, values)
    rows = table(spark, d, "nation").select("n_nationkey", m.alias("m"), F.array_join(zipped, ";").alias("pairs"))
    return rows.select("n_nationkey", F.col("m")["name"].alias("name"), F.col("m")["region"].alias("region"), F.map_contains_key("m", F.lit("name")).alias("has_name"), F.map_contains_key("m", F.lit("age")).alias("has_age"), "pairs")


@register("map_items", "SELECT n_nationkey, k, CASE k WHEN 'name' THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation, (VALUES ('name'), ('region')) t(k)")
def map_items(spark, d):
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.inline(F.map_entries(m)).alias("k", "v"))


@register("nested_index", "SELECT n_nationkey, n_name AS second, CAST(NULL AS VARCHAR) AS beyond FROM nation")
def nested_index(spark, d):
    menu = F.create_map(F.lit("dishes"), F.array(F.lit("first"), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", F.get(menu["dishes"], F.lit(1)).alias("second"), F.get(menu["dishes"], F.lit(7)).alias("beyond"))


@register(
    "record_walk",
    """SELECT n_nationkey, path, CASE path WHEN 'name' THEN n_name WHEN 'level' THEN CAST(n_regionkey AS VARCHAR) WHEN 'items.sword' THEN 'iron' WHEN 'items.armour' THEN 'plate' WHEN 'skills.0' THEN 'cut' ELSE 'jump' END AS value
    FROM nation, (VALUES ('name'), ('level'), ('items.sword'), ('items.armour'), ('skills.0'), ('skills.1')) t(path)""",
)
def record_walk(spark, d):
    items = F.create_map(F.lit("sword"), F.lit("iron"), F.lit("armour"), F.lit("plate"))
    record = F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("level"), items.alias("items"), F.array(F.lit("cut"), F.lit("jump")).alias("skills"))
    pair = lambda path, value: F.struct(path.alias("path"), value.alias("value"))
    r = F.col("record")
    inner = F.transform(F.map_entries(r["items"]), lambda e: pair(F.concat(F.lit("items."), e["key"]), e["value"]))
    listed = F.transform(r["skills"], lambda s, k: pair(F.concat(F.lit("skills."), k.cast("string")), s))
    flat = F.concat(F.array(pair(F.lit("name"), r["name"]), pair(F.lit("level"), r["level"])), inner, listed)
    return table(spark, d, "nation").select("n_nationkey", record.alias("record")).select("n_nationkey", F.inline(flat))


@register("product_of_list", "SELECT l_orderkey, l_linenumber, l_linenumber * 3 * CAST(l_quantity AS BIGINT) AS product FROM lineitem")
def product_of_list(spark, d):
    items = F.array(F.col("l_linenumber").cast("long"), F.lit(3).cast("long"), F.col("l_quantity").cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.product(items).alias("product"))


@register("least_of_list", "SELECT l_orderkey, l_linenumber, least(l_quantity, 10, l_linenumber) AS low, greatest(l_quantity, 10, l_linenumber) AS high FROM lineitem")
def least_of_list(spark, d):
    items = F.array(F.col("l_quantity").cast("double"), F.lit(10.0), F.col("l_linenumber").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_min(items).alias("low"), F.array_max(items).alias("high"))


@register("strip_sides", "SELECT n_nationkey, n_name || chr(9) || ' ' AS right_kept, '  ' || n_name AS left_kept FROM nation")
def strip_sides(spark, d):
    padded = F.concat(F.lit("  "), F.col("n_name"), F.lit("\t "))
    return table(spark, d, "nation").select("n_nationkey", S.strip_left(padded).alias("right_kept"), S.strip_right(padded).alias("left_kept"))


@register(
    "format_whole_numbers",
    """WITH n AS (SELECT c_custkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS n FROM customer) SELECT c_custkey, lpad(CAST(n AS VARCHAR), 5, ' ') AS wide, lpad(CASE WHEN n < 0 THEN CAST(n AS VARCHAR) ELSE '+' || n END, 5, ' ') AS signed_wide,
    CASE WHEN n < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(n) AS VARCHAR), 4, '0') AS signed_zeros, CASE WHEN n < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(n) AS VARCHAR), 4, ' ') AS sign_left FROM n""",
)
def format_whole_numbers(spark, d):
    n = F.floor(F.col("c_acctbal") / 100).cast("long")
    shown = {"wide": F.format_string("%5d", n), "signed_wide": F.format_string("%+5d", n), "signed_zeros": F.format_string("%+05d", n), "sign_left": S.signed_padded(n, 5)}
    return table(spark, d, "customer").select("c_custkey", *(c.alias(k) for k, c in shown.items()))


@register(
    "format_decimals",
    """SELECT c_custkey, printf('%10.2f', c_acctbal) AS wide, printf('%010.2f', c_acctbal) AS zeros, printf('%+10.2f', c_acctbal) AS signed_wide, printf('%+010.2f', c_acctbal) AS signed_zeros,
    CASE WHEN printf('%.2f', c_acctbal) LIKE '-%' THEN '-' ELSE '+' END || lpad(replace(printf('%.2f', c_acctbal), '-', ''), 9, ' ') AS sign_left, printf('%.1f', CAST(c_custkey AS DOUBLE)) AS short FROM customer""",
)
def format_decimals(spark, d):
    x = F.col("c_acctbal").cast("double")
    shown = {"wide": S.fixed(x, 2, 10), "zeros": S.fixed(x, 2, 10, zeros=True), "signed_wide": S.fixed(x, 2, 10, plus=True), "signed_zeros": S.fixed(x, 2, 10, plus=True, zeros=True)}
    shown |= {"sign_left": S.signed_padded(S.fixed(x, 2), 10), "short": S.fixed(F.col("c_custkey").cast("double"), 1)}
    return table(spark, d, "customer").select("c_custkey", *(c.alias(k) for k, c in shown.items()))


@register("half_even_rounding", "SELECT p_partkey, round_even(p_size / 2.0, 0) AS half_even, round(p_size / 2.0) AS half_up FROM part")
def half_even_rounding(spark, d):
    half = F.col("p_size") / F.lit(2.0)
    return table(spark, d, "part").select("p_partkey", F.bround(half, 0).alias("half_even"), F.round(half, 0).alias("half_up"))


@register("circles", "SELECT p_partkey, round(CAST(2 * 3.14 * p_size AS DOUBLE), 6) AS circumference, round(CAST(3.14 * p_size * p_size AS DOUBLE), 6) AS area, printf('%.2f', CAST(4 * 3.14159 AS DOUBLE) * p_size * p_size) AS sphere_area FROM part")
def circles(spark, d):
    r = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", r6(F.lit(2 * 3.14) * r, "circumference"), r6(F.lit(3.14) * r * r, "area"), S.fixed(F.lit(4 * 3.14159) * r * r, 2).alias("sphere_area"))


@register("clock_parts", "SELECT event_id, CAST(hour(ts) AS INT) AS hh, CAST(minute(ts) AS INT) AS mi, CAST(floor(second(ts)) AS INT) AS ss, date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS days_left FROM events")
def clock_parts(spark, d):
    """``now`` is a parameter, here a fixed day, so that results repeat."""
    now, t = F.lit("2030-01-01").cast("date"), F.col("ts")
    return table(spark, d, "events").select("event_id", F.hour(t).alias("hh"), F.minute(t).alias("mi"), F.second(t).alias("ss"), F.datediff(now, t.cast("date")).cast("long").alias("days_left"))


@register("now_is_one_instant", "SELECT 1 AS n_instants, true AS recent")
def now_is_one_instant(spark, d):
    rows = table(spark, d, "nation").select(F.current_timestamp().alias("now"))
    return rows.agg(F.count_distinct("now").cast("int").alias("n_instants"), F.bool_and(F.col("now") > F.lit("2020-01-01").cast("timestamp")).alias("recent"))


@register(
    "order_with_nulls",
    "WITH n AS (SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name END AS name FROM nation) SELECT n_nationkey, row_number() OVER (ORDER BY name NULLS FIRST, n_nationkey) AS up, row_number() OVER (ORDER BY name DESC NULLS LAST, n_nationkey) AS down FROM n",
)
def order_with_nulls(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("name"))
    up = numbered(rows, F.asc("name"), F.asc("n_nationkey"), name="up")
    return numbered(up, F.desc("name"), F.asc("n_nationkey"), name="down").select("n_nationkey", "up", "down")


@register(
    "order_by_text_date",
    """WITH n AS (SELECT n_nationkey, '199' || (n_nationkey % 3) || '-' || (n_nationkey % 12 + 1) || '-13' AS born FROM nation)
    SELECT n_nationkey, row_number() OVER (ORDER BY born, n_nationkey) AS by_text, row_number() OVER (ORDER BY CAST(strptime(born, '%Y-%m-%d') AS DATE), n_nationkey) AS by_date FROM n""",
)
def order_by_text_date(spark, d):
    k = F.col("n_nationkey")
    born = F.concat(F.lit("199"), (k % 3).cast("string"), F.lit("-"), (k % 12 + 1).cast("string"), F.lit("-13"))
    rows = numbered(table(spark, d, "nation").withColumn("born", born), "born", "n_nationkey", name="by_text")
    return numbered(rows, F.to_date("born", "yyyy-M-d"), F.asc("n_nationkey"), name="by_date").select("n_nationkey", "by_text", "by_date")


@register(
    "type_dispatch",
    """SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'truth' WHEN 3 THEN 'list' WHEN 4 THEN 'record' ELSE 'null' END AS kind FROM nation""",
)
def type_dispatch(spark, d):
    samples = F.array(*(F.lit(x) for x in ("12.5", '"word"', "true", "[1, 2]", '{"a": 1}', "null")))
    value = F.get(samples, (F.col("n_nationkey") % 6).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", S.kind_of(value).alias("kind"))


@register("significance_bands", "SELECT p_partkey, CASE WHEN p_size / 1000.0 < 0.001 THEN 'p < .001' WHEN p_size / 1000.0 < 0.05 THEN 'p < .05' ELSE 'not significant' END AS significance, p_size / 1000.0 < 0.05 AS reject_h0 FROM part")
def significance_bands(spark, d):
    return stats.decide(table(spark, d, "part").select("p_partkey", (F.col("p_size") / F.lit(1000.0)).alias("p"))).drop("p")


@register("effect_labels", "SELECT 'a × b' AS label UNION ALL SELECT 'a'")
def effect_labels(spark, d):
    return spark.createDataFrame([("C(a):C(b)",), ("C(a)",)], "term string").select(stats.effect_label(F.col("term")).alias("label"))


@register("label_codes", "SELECT n_nationkey, CASE WHEN contains(n_name, '1') THEN 1 WHEN contains(n_name, 'A') THEN 2 ELSE 0 END AS code FROM nation")
def label_codes(spark, d):
    return table(spark, d, "nation").select("n_nationkey", S.code_of({"1": 1, "A": 2}, F.col("n_name"), 0).alias("code"))


@register("composed_stages", "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 1")
def composed_stages(spark, d):
    positive = lambda df: df.filter("c_acctbal > 0")
    means = lambda df, by: df.groupBy(by).agg(F.count("*").alias("n"), r6(F.avg("c_acctbal"), "mean"))
    return table(spark, d, "customer").transform(positive).transform(means, "c_mktsegment").transform(lambda df: df.filter("n > 1"))


@register("sub_pipeline_input", "SELECT conv_id, turn, 'Topic: ' || upper(role) || ' / ' || text AS prompt FROM conversations")
def sub_pipeline_input(spark, d):
    topic = lambda df: df.withColumn("topic", F.upper("role"))
    prompt = lambda df: df.select("conv_id", "turn", S.fill("Topic: {topic} / {body}", topic=F.col("topic"), body=F.col("text")).alias("prompt"))
    return table(spark, d, "conversations").transform(topic).transform(prompt)


@register("safe_expressions", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / (l_linenumber - 1) END AS ratio, TRY_CAST(l_returnflag AS INT) AS number FROM lineitem")
def safe_expressions(spark, d):
    ratio = F.try_divide(F.col("l_quantity").cast("double"), F.col("l_linenumber") - 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"), F.col("l_returnflag").try_cast("int").alias("number"))


@register("random_choices", "SELECT true AS in_range, true AS all_chosen, 3 AS n_sampled, true AS same_items")
def random_choices(spark, d):
    """Seeded draws; what they must hold is told, not the draws."""
    items = F.array(*(F.lit(k) for k in range(1, 7)))
    drawn = spark.range(600).select((F.lit(10) + 5 * F.rand(3)).alias("uniform"), F.get(items, F.floor(F.rand(4) * 6).cast("int")).alias("choice"), F.shuffle(items, 5).alias("shuffled"))
    return drawn.agg(
        F.bool_and(F.col("uniform").between(10, 15)).alias("in_range"), (F.count_distinct("choice") == 6).alias("all_chosen"),
        F.max(F.size(F.array_distinct(F.slice("shuffled", 1, 3)))).alias("n_sampled"), F.bool_and(F.array_sort("shuffled") == items).alias("same_items"),
    )


@register("ntile_and_range_window", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW), 2) AS near FROM orders")
def ntile_and_range_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.sum("o_totalprice").over(w.rangeBetween(-1000, 0)), 2).alias("near"))


@register("bag_operations", "SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'left', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def bag_operations(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersectAll(s).select(F.lit("both").alias("kind"), "k").union(c.exceptAll(s).select(F.lit("left").alias("kind"), "k"))


@register("approximations", "SELECT true AS distinct_near, true AS median_near")
def approximations(spark, d):
    """Sketches against the exact answers, within their error bounds."""
    rows, q = table(spark, d, "lineitem"), F.col("l_extendedprice").cast("double")
    sketches = rows.agg(F.approx_count_distinct("l_orderkey", 0.02).alias("ad"), F.percentile_approx(q, 0.5, 10000).alias("am"))
    # A distinct count beside sketches would keep the state of each sketch for every single key.
    distinct = rows.agg(F.count_distinct("l_orderkey").alias("d"))
    share = rows.join(F.broadcast(sketches.select("am"))).agg(F.avg((q <= F.col("am")).cast("double")).alias("share"))
    exact = sketches.select("ad").join(distinct).join(share)
    return exact.select((F.abs(F.col("ad") / F.col("d") - 1) < 0.1).alias("distinct_near"), (F.abs(F.col("share") - 0.5) < 0.001 + 0.01).alias("median_near"))


@register("sentences_udtf", "SELECT conv_id, turn, CAST(p - 1 AS INT) AS k, trim(s[p]) AS sentence FROM (SELECT conv_id, turn, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS s FROM conversations), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS p)")
def sentences_udtf(spark, d):
    """A table function over a lateral join."""

    @F.udtf(returnType="k int, sentence string", useArrow=True)
    class Sentences:
        def eval(self, text: str):
            for k, part in enumerate(p for p in (text or "").split(".") if p.strip(" ")):
                yield k, part.strip(" ")

    rows = table(spark, d, "conversations")
    return rows.lateralJoin(Sentences(F.col("text").outer())).select("conv_id", "turn", "k", "sentence")


_MEAN = """m AS (SELECT count(l_discount) AS n, avg(l_discount) AS m, stddev_samp(l_discount) AS sd FROM lineitem),
    s AS (SELECT (m - 0.05) / (sd / sqrt(n)) AS t, n - 1 AS dof, m AS estimate, sd / sqrt(n) AS se FROM m)"""


@register("mean_interval_discount_p", t_test_sql(_MEAN))
def mean_interval_discount_p(spark, d):
    """Test and confidence interval of a mean."""
    tested = stats.t_test(stats.one_sample_t(table(spark, d, "lineitem"), "l_discount", 0.05), "mean")
    return tested.withColumns({c: F.round(c, 6) for c in ("t", "p", "low", "high")})


@register("messages_to_text", "SELECT doc_id, 'system: ' || lang || chr(10) || 'user: ' || source AS chat FROM documents")
def messages_to_text(spark, d):
    chat = F.transform(X.messages(("system", F.col("lang")), ("user", F.col("source"))), lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return table(spark, d, "documents").select("doc_id", F.array_join(chat, "\n").alias("chat"))
