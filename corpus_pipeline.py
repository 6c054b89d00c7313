"""A training-corpus pipeline over ``documents``: five stages, each one operator of ``tallywork.llm``.

Every stage takes all that its predecessor kept and returns the columns of ``documents``; the last returns what the
encoder gives for each document. Rows with a null id pass every stage; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.decontaminate import contaminated
from tallywork.llm.line_dedup import dedup_lines
from tallywork.llm.ngram_join import jaccard_components
from tallywork.llm.piece_lattice import encode
from tallywork.llm.shared import cut, documents
from tallywork.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Ids (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for those of ``ids``; a null id is none of them."""
    ids = cut(ids.select("doc_id").distinct(), "stage-ids")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, score_toxicity(docs, labels).filter("predicted = 1"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; a document that loses all has an empty text."""
    own = dedup_lines(docs.select(*COLUMNS))
    return own.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles the one with the smallest id."""
    return _without(docs, jaccard_components(docs, words=5, percent=80).filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best segmentation of every document and the scores of the four best."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: The first and the last stage are no SQL; tests hold which documents stay against cases planted in a small table, and
#: line dedup and decontamination against their SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table, each result written to the shared folder before the next reads it."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
