"""Benchmark decontamination by templates, with DataFrame operations only.

Both sides become sequences of lower-case words in which numbers, units after a number and names (capitalised words
inside a sentence, a run of them as one) are typed placeholders. Hashes of windows of five such words are joined. An
item is suspected in a document that holds at least 80 % of its distinct windows. Then the slots are read: wherever a
window matched, a placeholder of the item faces a value of the document, and one value of the item must always face the
same value. That keeps re-parameterised copies (other numbers, other names) and drops chance matches of templates.
Where a document as a whole faces a value with several, each place that can hold the item alone is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.shared import cut, documents, text_of

QUERY = "op5_decontamination"
WINDOW = 5
#: Windows of the benchmark may be placeholders in part, but hold at least so many words.
LEAST_WORDS = 3
#: The windows of the benchmark are broadcast up to this count (24 bytes each and their item lists), else shuffled.
BROADCAST_WINDOWS = 500_000
#: Words that a copy may have more or fewer than the item before its later windows count as another place.
SLACK = 2 * WINDOW
#: Groups repeat possessively here and below: Java's other repetitions of a group take a stack frame for each round.
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*+|\p{L}+|[.!?]"

#: Letters that lower() changes: upper and title case but for those without a lower form.
CAPITAL = r"[\p{Lu}\p{Lt}&&[^\x{03D2}-\x{03D4}\x{2102}-\x{2115}\x{2119}-\x{2124}\x{2128}\x{212C}-\x{2131}\x{2133}-\x{2145}\x{1D400}-\x{1D7CA}]]"

# Units of measure, of money and of time.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonnes pound pounds ounce ounces ml "
    "cl l liter liters litre litres gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days "
    "week weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp yen kb mb gb tb byte "
    "bytes bit bits hz khz mhz ghz w kw mw v a j kj cal kcal degrees degree mph kmh"
).split()


def _marks(w: Column) -> Column:
    return w.isin(".", "!", "?")


def _number(w: Column) -> Column:
    return F.substring(w, 1, 1).between("0", "9")


def _inner_capital(w: Column, before: Column) -> Column:
    first = F.substring(w, 1, 1)
    return (first != F.lower(first)) & F.coalesce(~_marks(before), F.lit(False))


def with_tokens(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``tokens``: an array of structs of the canonical word c and the source word w."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    none = F.lit(None).cast("string")
    # Neighbours come by zipping shifted arrays: a lambda that looked into the whole array could get it inlined.
    zipped = F.arrays_zip(raw.alias("w"), F.concat(F.array(none), raw).alias("one"), F.concat(F.array(none, none), raw).alias("two"))

    def token(t: Column) -> Column:
        w, one, two = t["w"], t["one"], t["two"]
        name = _inner_capital(w, one)
        c = (
            F.when(w.isNull() | _marks(w), None)
            .when(_number(w), "#number")
            .when(F.coalesce(_number(one), F.lit(False)) & F.lower(w).isin(*UNITS), "#unit")
            .when(name & F.coalesce(_inner_capital(one, two), F.lit(False)), None)
            .when(name, "#name")
            .otherwise(F.lower(w))
        )
        return F.struct(c.alias("c"), w.alias("w"))

    named = zipped.cast("array<struct<w:string,one:string,two:string>>")
    return rows.withColumn("tokens", F.filter(F.transform(named, token), lambda t: t["c"].isNotNull()))


def canonical(text: Column) -> Column:
    """The canonical words of ``with_tokens``, each followed by a blank, made by rewriting the whole text at once."""
    held = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), " "), F.lit(" "))
    numbers = F.regexp_replace(held, "[0-9][^ ]*", "#number")
    # A unit in capitals is followed by names like a name, so those are part of it.
    unit, names = f"(?iu:{'|'.join(UNITS)})(?= )", f"(?: {CAPITAL}\\p{{L}}*)*+"
    units = F.regexp_replace(numbers, f"#number (?:(?={CAPITAL}){unit}{names}|{unit})", "#number #unit")
    named = F.regexp_replace(units, f"(?<=[^ .!?] ){CAPITAL}\\p{{L}}*{names}", "#name")
    return F.regexp_replace(F.lower(named), "(?<= )[.!?] ", "")


def _windows(rows: DataFrame, *keep: str) -> DataFrame:
    """rows: ``keep`` and words (as of ``canonical``) -> ``keep``, pos, gram and h (its hash), a row for each window."""
    grams = F.regexp_extract_all("words", F.lit(f"(?=((?:[^ ]+ ){{{WINDOW}}}))[^ ]+ "), F.lit(1))
    # The outer form: else a filter on the size of the array makes all of it twice.
    return rows.select(*keep, F.posexplode_outer(grams).alias("pos", "gram")).filter("gram is not null").withColumn("h", F.xxhash64("gram"))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, pos and h of the windows that hold enough words."""
    words = items.filter("item_id is not null").select("item_id", canonical(text_of()).alias("words"))
    lexical = F.length("gram") - F.length(F.replace("gram", F.lit("#"))) <= WINDOW - LEAST_WORDS
    return _windows(words, "item_id").filter(lexical).select("item_id", F.col("pos").alias("item_pos"), "h").distinct()


def _spelled(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and said: the source words in lower case without marks, each between blanks."""
    held = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text_of()), F.lit(TOKEN), F.lit(0)), " "), F.lit(" "))
    return rows.select(key, F.regexp_replace(held, "(?<= )[.!?] ", "").alias("said"))


def _said_whole(docs: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``contaminated`` for items without a window of enough words: documents that hold all their words."""
    short = _spelled(items.filter("item_id is not null").join(wanted.select("item_id").distinct(), "item_id", "left_anti"), "item_id").filter("said <> ' '").distinct()
    words = F.filter(F.split("said", " "), lambda w: w != "")
    short = cut(short.select("item_id", "said", F.concat_ws(" ", F.slice(words, 1, WINDOW)).alias("head"), F.least(F.size(words), F.lit(WINDOW)).alias("n"), F.size(F.filter(words, lambda w: w.rlike("^[0-9]"))).alias("n_slots")), "short-items")
    if short.isEmpty():
        return None
    said = _spelled(docs, "doc_id")
    heads = None
    for n in range(1, WINDOW + 1):
        grams = F.regexp_extract_all("said", F.lit(f"(?=((?:[^ ]+ ){{{n - 1}}}[^ ]+) )[^ ]+ "), F.lit(1))
        own = said.select("doc_id", F.explode_outer(F.array_distinct(grams)).alias("head"), F.lit(n).alias("n")).join(short.filter(F.col("n") == n).select("item_id", "head"), "head").select("doc_id", "item_id")
        heads = own if heads is None else heads.union(own)
    held = heads.distinct().join(said, "doc_id").join(short.withColumnRenamed("said", "item"), "item_id").filter(F.contains("said", "item"))
    one = F.lit(1).cast("long")
    return held.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.col("n_slots").cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed")).distinct()


def _judged(values: DataFrame, *by: str) -> DataFrame:
    """``by``, most (values that one value of the item faces at most), n_slots and n_changed."""
    each = values.groupBy(*by, "kind", "item_value").agg(F.count_distinct("item_pos").alias("n"), F.count_distinct("doc_value").alias("n_values"), F.min("doc_value").alias("value"))
    return each.groupBy(*by).agg(F.max("n_values").alias("most"), F.sum("n").alias("n_slots"), F.sum(F.when(F.col("value") != F.col("item_value"), F.col("n")).otherwise(0)).alias("n_changed"))


def _placed(rows: DataFrame) -> DataFrame:
    """Each row of pos and item_pos for every place it can belong to: its own offset and each band of offsets around it."""
    offset = F.col("pos") - F.col("item_pos")
    bands = F.transform(F.sequence(offset - SLACK, offset), lambda o: F.struct(F.lit(SLACK).alias("slack"), o.alias("first")))
    return rows.select("*", F.inline(F.concat(F.array(F.struct(F.lit(0).alias("slack"), offset.alias("first"))), bands)))


def _consistent_places(hits: DataFrame, values: DataFrame, pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """For each of ``pairs`` with a place that holds enough of the item under consistent values the best such place."""
    place = ["doc_id", "item_id", "slack", "first"]
    held = _placed(hits.join(pairs, ["doc_id", "item_id"])).groupBy(*place).agg(F.count_distinct("h").alias("n_matched"))
    held = held.join(sizes, "item_id").filter(100 * F.col("n_matched") >= percent * F.col("n_windows"))
    slots = _judged(_placed(values.join(pairs, ["doc_id", "item_id"])), *place)
    whole = held.join(slots, place, "left").filter("coalesce(most, 1) = 1").fillna(0, ["n_slots", "n_changed"])
    best = F.max(F.struct("n_matched", (-F.col("n_changed")).alias("same"), "n_slots", "n_windows")).alias("best")
    return whole.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.n_slots", (-F.col("best.same")).alias("n_changed"))


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_slots and n_changed for every item found in a document.

    n_windows counts the distinct windows of the item and n_matched those found; n_slots counts the placeholders of the
    item that faced a value and n_changed those whose value differs. If the values of the whole document contradict each
    other but those of one place (windows at one offset, or at offsets up to SLACK apart) don't, the last three are those
    of the best such place. Items of fewer than five words or without a window of enough words are found where all their
    words follow each other unchanged, as one window; items without any word never. Null texts are empty; rows with a
    null id take no part. Repeated rows count once. Other columns are not read. With no items or no documents the result
    is empty.
    """
    wanted = cut(benchmark_windows(items), "benchmark-windows")
    sizes = wanted.groupBy("item_id").agg(F.count_distinct("h").alias("n_windows"))
    by_hash = wanted.groupBy("h").agg(F.collect_set(F.struct("item_id", "item_pos")).alias("places"))
    side = F.broadcast(by_hash) if wanted.count() <= BROADCAST_WINDOWS else by_hash
    own = docs.filter("doc_id is not null").select("doc_id", text_of().alias("text"))
    found = _windows(own.select("doc_id", canonical(F.col("text")).alias("words")), "doc_id").join(side, "h").select("doc_id", "pos", "h", F.explode("places").alias("place"))
    hits = cut(found.select("doc_id", "pos", "h", "place.*"), "template-hits")
    suspects = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("n_matched")).join(sizes, "item_id").filter(100 * F.col("n_matched") >= percent * F.col("n_windows"))
    # Slots: every token position of a matched window, in the item and in the document.
    step = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1)))
    faced = hits.join(suspects.select("doc_id", "item_id"), ["doc_id", "item_id"]).select("doc_id", "item_id", "pos", "item_pos", step.alias("k"))
    faced = faced.select("doc_id", "item_id", (F.col("pos") + F.col("k")).alias("pos"), (F.col("item_pos") + F.col("k")).alias("item_pos")).distinct()
    item_tokens = with_tokens(items.filter("item_id is not null").select("item_id", text_of().alias("text")), F.col("text"))
    # The outer form: else a filter on the size of ``tokens`` moves below the join and makes tokens of every document.
    item_slots = item_tokens.select("item_id", F.posexplode_outer("tokens").alias("item_pos", "t")).filter(F.col("t.c").startswith("#")).select("item_id", "item_pos", F.col("t.c").alias("kind"), F.lower("t.w").alias("item_value")).distinct()
    faced = faced.join(item_slots, ["item_id", "item_pos"])
    holders = faced.select("doc_id").distinct()
    doc_tokens = with_tokens(own.join(holders, "doc_id"), F.col("text")).select("doc_id", F.posexplode_outer("tokens").alias("pos", "t")).select("doc_id", "pos", F.lower("t.w").alias("doc_value")).distinct()
    values = cut(faced.join(doc_tokens, ["doc_id", "pos"]), "slot-values")
    judged = suspects.join(_judged(values, "doc_id", "item_id"), ["doc_id", "item_id"], "left")
    names = ["doc_id", "item_id", "n_windows", "n_matched", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_slots", "n_changed"))]
    by_place = _consistent_places(hits, values, judged.filter("most > 1").select("doc_id", "item_id"), sizes, percent)
    found = judged.filter("coalesce(most, 1) = 1").select(*names).unionByName(by_place.select(*names))
    whole = _said_whole(own, items, wanted)
    return found if whole is None else found.unionByName(whole)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UNITS_SQL = ", ".join(f"'{u}'" for u in UNITS)
ORACLE_SQL = rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
raw AS (SELECT side, id, regexp_extract_all(text, '[0-9]+(?:[.,:/][0-9]+)*|\p{{L}}+|[.!?]') AS t FROM src),
pos AS (SELECT side, id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM raw),
ctx AS (SELECT *, lag(w) OVER o AS p1, lag(w, 2) OVER o AS p2 FROM pos WINDOW o AS (PARTITION BY side, id ORDER BY i)),
nam AS (SELECT *, left(w, 1) <> lower(left(w, 1)) AND coalesce(p1 NOT IN ('.', '!', '?'), false) AS is_name,
          coalesce(left(p1, 1) <> lower(left(p1, 1)) AND coalesce(p2 NOT IN ('.', '!', '?'), false), false) AS was_name FROM ctx),
can AS (SELECT side, id, i, w, CASE WHEN w IN ('.', '!', '?') THEN NULL
          WHEN left(w, 1) BETWEEN '0' AND '9' THEN '#number'
          WHEN coalesce(left(p1, 1) BETWEEN '0' AND '9', false) AND lower(w) IN ({_UNITS_SQL}) THEN '#unit'
          WHEN is_name AND was_name THEN NULL WHEN is_name THEN '#name' ELSE lower(w) END AS c FROM nam),
tok AS (SELECT side, id, c, lower(w) AS w, row_number() OVER (PARTITION BY side, id ORDER BY i) - 1 AS k FROM can WHERE c IS NOT NULL),
win AS (SELECT side, id, k, concat_ws(' ', c, lead(c, 1) OVER o, lead(c, 2) OVER o, lead(c, 3) OVER o, lead(c, 4) OVER o) AS h,
          lead(c, 4) OVER o IS NOT NULL AS whole,
          5 - (length(concat_ws(' ', c, lead(c, 1) OVER o, lead(c, 2) OVER o, lead(c, 3) OVER o, lead(c, 4) OVER o))
             - length(replace(concat_ws(' ', c, lead(c, 1) OVER o, lead(c, 2) OVER o, lead(c, 3) OVER o, lead(c, 4) OVER o), '#', ''))) AS words
        FROM tok WINDOW o AS (PARTITION BY side, id ORDER BY k)),
b AS (SELECT id AS item_id, k AS item_pos, h FROM win WHERE side = 'b' AND whole AND words >= 3),
n AS (SELECT item_id, count(DISTINCT h) AS n_windows FROM b GROUP BY item_id),
hits AS (SELECT d.id AS doc_id, d.k AS pos, d.h, b.item_id, b.item_pos FROM win d JOIN b ON d.h = b.h WHERE d.side = 'd' AND d.whole),
sus AS (SELECT doc_id, item_id, count(DISTINCT h) AS n_matched, any_value(n_windows) AS n_windows FROM hits JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING 100 * count(DISTINCT h) >= 80 * any_value(n_windows)),
faced AS (SELECT DISTINCT doc_id, item_id, pos + s AS pos, item_pos + s AS item_pos FROM hits JOIN sus USING (doc_id, item_id), range(5) r(s)),
val AS (SELECT f.doc_id, f.item_id, f.item_pos, i.c AS kind, i.w AS item_value, d.w AS doc_value FROM faced f
        JOIN tok i ON i.side = 'b' AND i.id = f.item_id AND i.k = f.item_pos AND i.c LIKE '#%'
        JOIN tok d ON d.side = 'd' AND d.id = f.doc_id AND d.k = f.pos),
g AS (SELECT doc_id, item_id, item_value, count(DISTINCT item_pos) AS n, count(DISTINCT doc_value) AS n_values, min(doc_value) AS value
      FROM val GROUP BY doc_id, item_id, kind, item_value),
s AS (SELECT doc_id, item_id, max(n_values) AS most, sum(n) AS n_slots, sum(CASE WHEN value <> item_value THEN n ELSE 0 END) AS n_changed
      FROM g GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_windows, n_matched, CAST(coalesce(n_slots, 0) AS BIGINT) AS n_slots, CAST(coalesce(n_changed, 0) AS BIGINT) AS n_changed
FROM sus LEFT JOIN s USING (doc_id, item_id) WHERE coalesce(most, 1) = 1
"""
