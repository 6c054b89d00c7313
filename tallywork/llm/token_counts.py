"""Token counts through a cache keyed by content and tokenizer digests.

A count depends on the text and on the tokenizer file alone, so the cache holds (content digest, tokenizer digest,
count). Documents are reduced to digests; digests that the cache lacks are encoded once each, however many documents
share the text, and appended. The content is normalised as the tokenizer library sees it: null is the empty text and
nothing else may change, since the counts must be those of the raw text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.shared import documents, scratch_path, text_of

QUERY = "op7_token_counts"
ORACLE_SQL = None
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
#: Characters that are encoded in one call; bounds the memory of a worker whatever the lengths of texts.
CHARS_A_CALL = 4_000_000
_loaded: dict[tuple[str, str], object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str, digest: str):
    """texts -> counts by the library that the file's ending names; loaded once for each worker process."""
    if (path, digest) not in _loaded:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_padding()
            tokenizer.no_truncation()
            _loaded[path, digest] = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            _loaded[path, digest] = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    return _loaded[path, digest]


def encode_misses(misses: DataFrame, path: str, digest: str) -> DataFrame:
    """(content_digest, text) -> cache rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, digest)
        for batch in batches:
            keys, texts, counts, held, size = batch.column(0), batch.column(1), [], [], 0
            for text in texts:
                held.append(text.as_py())
                size += len(held[-1])
                if size >= CHARS_A_CALL:
                    counts += count(held)
                    held, size = [], 0
            counts += count(held) if held else []
            yield pa.RecordBatch.from_arrays([keys, pa.array([digest] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    return misses.mapInArrow(run, CACHE_SCHEMA)


def read_cache(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """Rows of one tokenizer, each content once; empty if nothing was ever cached at ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer_digest") == digest)
    return rows.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"), F.lit(digest).alias("tokenizer_digest"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``; ``cache_path`` gains the texts that it lacked.

    Null and empty texts have 0 tokens and 0 bytes. Null ids and repeated rows pass through. Other columns are not
    read. Appends of two runs at once may cache a text twice; reads take each content once.
    """
    spark = docs.sparkSession
    digest = tokenizer_digest(tokenizer_path)
    content = F.unhex(F.sha2(text_of(), 256))
    keyed = docs.select("doc_id", F.octet_length(text_of()).cast("long").alias("n_bytes"), content.alias("content_digest"))
    held = read_cache(spark, cache_path, digest).select("content_digest")
    texts = docs.select(content.alias("content_digest"), text_of().alias("text")).filter("length(text) > 0")
    misses = texts.join(held, "content_digest", "left_anti").groupBy("content_digest").agg(F.any_value("text").alias("text"))
    encode_misses(misses, tokenizer_path, digest).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path, digest).select("content_digest", "n_tokens")
    found = F.coalesce("n_tokens", F.lit(0)).cast("long")
    return keyed.join(counts, "content_digest", "left").select("doc_id", "n_bytes", found.alias("n_tokens"), (found > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents, with a cache that is empty at first, so that all distinct texts are encoded."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
