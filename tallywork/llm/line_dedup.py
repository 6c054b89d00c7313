"""Line dedup over a corpus with DataFrame operations only.

A line's key is the line without surrounding ASCII white space, with A-Z in lower case. A key of at least
``min_chars`` code points stays only in the smallest document id that holds it.

1. Every line becomes (hash, piece, document, position), written once; ``piece`` deals one key over ``pieces`` parts, so
   that a line that a third of all documents hold does not meet in one task.
2. The rows are range-partitioned by (hash, piece) and sorted by document and position; running windows stream the first
   occurrence of each piece and of each further document in it.
3. The heads of the pieces (at most ``pieces`` rows a key) give the first document of every key that several hold.
4. Positions of the lines of such keys in other documents make a keep bitmap for each document, compressed as lengths of
   runs: lines kept, lines dropped, lines kept and so on. No text is shuffled up to here, and then only those of documents
   that a bitmap marks: all that lose lines and, the fuller it is, some others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.llm.shared import BITMAP_BITS, cut, documents, drop, text_of

QUERY = "op10_line_dedup"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def first_occurrences(lines: DataFrame, pieces: int) -> DataFrame:
    """(h1, h2, piece, first_doc) for each piece of each key of several documents; ``lines`` has h1, h2, piece, doc, pos."""
    order = Window.partitionBy("h1", "h2", "piece").orderBy("doc", "pos")
    seen = (
        lines.repartitionByRange("h1", "h2", "piece")
        .withColumns({"at": F.row_number().over(order), "before": F.lag("doc").over(order)})
        .filter("at = 1 or doc <> before")
        .groupBy("h1", "h2", "piece")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    )
    firsts = seen.groupBy("h1", "h2").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc"), F.array_sort(F.collect_list("piece")).alias("held"))
    return firsts.filter("first_doc < last_doc").select("h1", "h2", F.explode("held").alias("piece"), "first_doc")


def drop_runs(docs: DataFrame, min_chars: int = 10, pieces: int = 128) -> DataFrame:
    """Per document that loses lines: doc, text_hash, n_dropped, runs (array of start and length, in order of lines).

    ``docs`` needs doc_id and text. Rows without doc_id take no part. Rows that share doc_id and text are one document.
    """
    lines = (
        docs.filter("doc_id is not null")
        .select(F.col("doc_id").alias("doc"), F.xxhash64(text_of()).alias("text_hash"), F.posexplode(split_lines(text_of())).alias("pos", "line"))
        .select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(97), "key").alias("h2"), F.pmod(F.xxhash64("doc"), F.lit(pieces)).cast("int").alias("piece"))
    )
    lines = cut(lines, "lines")
    firsts = first_occurrences(lines.select("h1", "h2", "piece", "doc", "pos"), pieces)
    dropped = lines.join(firsts, ["h1", "h2", "piece"]).filter("doc <> first_doc").select("doc", "text_hash", "pos").distinct()
    in_order = Window.partitionBy("doc", "text_hash").orderBy("pos")
    runs = (
        dropped.withColumn("island", F.col("pos") - F.row_number().over(in_order))
        .groupBy("doc", "text_hash", "island")
        .agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
        .groupBy("doc", "text_hash")
        .agg(F.sum("length").cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("runs"))
    )
    runs = cut(runs, "line-runs")
    drop(lines)
    return runs


def _slot() -> Column:
    return F.xxhash64("id").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def marked_ids(rows: DataFrame) -> DataFrame:
    """A bitmap of fixed size (2 ** BITMAP_BITS bits, in words of 64) that marks the ids of ``rows``."""
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    return rows.select(_slot().alias("slot")).select(F.shiftright("slot", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_be_in(rows: DataFrame, marks: DataFrame, wanted: bool) -> DataFrame:
    """Rows whose id the bitmap marks, which all are that were entered and few others; or all but those."""
    looked = rows.withColumn("slot", _slot()).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(marks), "word", "left")
    marked = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(F.expr("shiftleft(1L, cast(slot & 63 as int))")) != 0
    return looked.filter(marked == wanted).select(*rows.columns)


def keep_bitmap(runs: Column, n: Column) -> Column:
    """Lengths of the runs of kept and dropped lines in turn, beginning with kept lines (perhaps none), of ``n`` lines."""
    end = lambda i: F.when(i > 0, F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"]).otherwise(0)
    told = F.flatten(F.transform(runs, lambda r, i: F.array(r["start"] - end(i), r["length"])))
    rest = n - end(F.size(runs))
    return F.when(runs.isNull(), F.array(n)).otherwise(F.concat(told, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))))


def dedup_lines(docs: DataFrame, min_chars: int = 10, pieces: int = 128) -> DataFrame:
    """``docs`` with kept_text, n_lines, n_dropped and keep_bitmap (lengths of kept and dropped runs in turn) added.

    Null and empty texts are one empty line. Rows without doc_id keep all their lines. Repeated rows give repeated
    results. Other columns pass through unless they bear the name of one that is added; such a column is replaced.
    """
    own = [c for c in docs.columns if c not in ("text", "kept_text", "n_lines", "n_dropped", "keep_bitmap")]
    held = docs.select(F.struct(*own).alias("own"), F.col("doc_id").alias("id"), text_of().alias("whole"), F.xxhash64(text_of()).alias("hash"))
    runs = drop_runs(docs.select("doc_id", "text"), min_chars, pieces)
    marks = marked_ids(runs.select(F.col("doc").alias("id")))
    # Texts that lose nothing are counted, not cut into lines, and but for a few they stay where they are.
    joined = may_be_in(held, marks, True).join(runs, (F.col("id") == F.col("doc")) & (F.col("hash") == F.col("text_hash")), "left")
    joined = joined.unionByName(may_be_in(held, marks, False), allowMissingColumns=True)
    n = F.length("whole") - F.length(F.replace(F.col("whole"), F.lit("\n"))) + 1
    lost = F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), n - 1), lost)
    # The lines are bound to a name: inlined, they would be cut anew for every line that is kept.
    kept = F.get(F.transform(F.array(F.struct(split_lines(F.col("whole")).alias("lines"), left.alias("left"))), lambda s: F.transform(s["left"], lambda i: F.get(s["lines"], i))), F.lit(0))
    made = joined.select(
        "own",
        F.col("whole").alias("text"),
        F.when(F.col("runs").isNull(), F.col("whole")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        keep_bitmap(F.col("runs"), n).alias("keep_bitmap"),
    )
    # The struct keeps other columns apart from the names used here.
    return made.select(*(F.col("own").getField(c).alias(c) for c in own), "text", "kept_text", "n_lines", "n_dropped", "keep_bitmap")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.array_join(F.col("keep_bitmap").cast("array<string>"), ",").alias("keep_bitmap"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
f AS (SELECT line_key, min(doc_id) AS first_doc FROM k WHERE length(line_key) >= 10 GROUP BY line_key),
j AS (SELECT k.*, coalesce(k.doc_id <> f.first_doc, false) AS lost FROM k LEFT JOIN f ON k.line_key = f.line_key),
c AS (SELECT *, CASE WHEN lost = lag(lost, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM j),
g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
r AS (SELECT doc_id, run, count(*) AS n FROM g GROUP BY doc_id, run),
b AS (SELECT doc_id, CASE WHEN min(run) > 0 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY run) AS keep_bitmap FROM r GROUP BY doc_id)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256, any_value(b.keep_bitmap) AS keep_bitmap
FROM j JOIN b USING (doc_id) GROUP BY doc_id
"""
