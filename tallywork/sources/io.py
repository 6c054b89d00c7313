"""Readers with explicit schemas, generators and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, names: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header. ``names`` replaces the header's names, which may repeat or hold dots; a BOM is skipped."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*names) if names else df


def read_lines(spark: SparkSession, path: str, names: Sequence[str], separator: str = ", ", types: Sequence[str] | None = None) -> DataFrame:
    """Lines of delimited fields; rows with an empty or a missing field are skipped, unreadable values are null."""
    parts = F.split(F.trim("value"), separator)
    fields = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]
    df = spark.read.text(path).select(*fields)
    for n in names:
        df = df.filter(F.length(n) > 0)
    return df.select(*(F.col(n).try_cast(t).alias(n) for n, t in zip(names, types or ["string"] * len(names), strict=True)))


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file in a folder and those below it: path and content."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs between blank lines, with the file they come from."""
    return spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("paragraph")).filter("paragraph <> ''")


def titled(paragraphs: DataFrame, column: str = "paragraph") -> DataFrame:
    """Paragraphs whose first line is a title: title and body."""
    line = F.split(F.col(column), "\n", 2)
    return paragraphs.select(F.get(line, F.lit(0)).alias("title"), F.coalesce(F.get(line, F.lit(1)), F.lit("")).alias("body"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file in a folder and those below it; contents aren't read."""
    return spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path", "length", "modificationTime")


def integers(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> DataFrame:
    """Like a half-open range of integers, also downwards."""
    first, end = (0, start) if stop is None else (start, stop)
    return spark.range(first, end, step).withColumnRenamed("id", "n")


def random_people(spark: SparkSession, n: int = 50, seed: int = 1, syllables: str = "가나다라마바사아자차") -> DataFrame:
    """name of two syllables, weight 40 to 100 and height 140 to 200, both ends included."""
    pick = lambda s: F.substring(F.lit(syllables), (F.floor(F.rand(s) * len(syllables)) + 1).cast("int"), F.lit(1))
    within = lambda low, high, s: (F.floor(F.rand(s) * (high - low + 1)) + low).cast("int")
    return spark.range(n).select(F.concat(pick(seed), pick(seed + 1)).alias("name"), within(40, 100, seed + 2).alias("weight"), within(140, 200, seed + 3).alias("height"))


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, runs of white space become one blank."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def preview(df: DataFrame, *order: str, n: int = 5) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def tab_rows(*columns: str) -> Column:
    return F.concat_ws("\t", *columns)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string")).write.mode("append").text(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the driver and all executors share, spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a master on this machine; any other master gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if not held.isEmpty() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallywork-")
    return f"{root}/tallywork-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
