"""What the operators of this subpackage share: scratch storage and names of columns."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a pruning bitmap: 2 MB.
BITMAP_BITS = 24


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallywork-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{checkpoint_root(spark)}/tallywork-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once all that was derived from them is written itself."""
    for table in tables:
        drop_path(table.sparkSession, table.scratch)


def key_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (2 ** BITMAP_BITS bits) that marks the keys, each by its low bits and by those above them.

    It only spares rows the way to a join that would drop them: where many keys fill it, it spares fewer. Two marks for
    each key let the share of rows that pass for nothing grow with the square of how full it is; small whole numbers all
    have the same second mark.
    """
    low = F.lit((1 << BITMAP_BITS) - 1)
    slots = F.array(F.col(column).bitwiseAND(low), F.shiftright(column, BITMAP_BITS).bitwiseAND(low))
    marks = keys.select(F.explode(slots).alias("slot"))
    words = marks.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys the bitmap marks."""
    found = _marks(bits, keys & ((1 << BITMAP_BITS) - 1))
    near = np.flatnonzero(found)
    found[near] = _marks(bits, (keys[near] >> BITMAP_BITS) & ((1 << BITMAP_BITS) - 1))
    return found


def _marks(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1


def prune(rows: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """Rows whose (not null, long) key the bitmap marks."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(bits, batch.column(column).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove scratch files by the file system that holds them."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Return to the system what this worker's allocators keep idle: workers are used again by other stages, whose own
    memory comes on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task's batches, with ``give_back`` at the end of the task."""

    @functools.wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
