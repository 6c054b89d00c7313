"""Approximate nearest neighbours by counting collisions of single projections.

Every block of vectors is indexed by sorted arrays, one for each random projection. A query opens a window around its
own projection in each array and counts how often a vector lies in one; virtual rehashing widens all windows together
by rising radii. Vectors whose count reaches the threshold are verified by the exact cosine. The search of a block ends
when k verified vectors lie within the radius, or when the radius holds the whole block.

The threshold leaves a vector at exactly the radius undetected with a probability below 3 % (a normal bound with
``margin`` standard deviations); vectors nearer than the radius are missed less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.llm.shared import cut

QUERY = "op4_collision_ann"
ORACLE_SQL = None
RADII = tuple(0.12 * 1.35**k for k in range(6)) + tuple(0.8 * 1.12**k for k in range(9))
SCHEMA = "query_id long, vec_id long, score double"


class CollisionIndex:
    """Sorted projections of one block of vectors; answers queries about it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = 128, half_width: float = 0.7, margin: float = 1.9):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.axes = np.random.default_rng(20240229).standard_normal((projections, vectors.shape[1]))
        hashed = (vectors / self.norms[:, None]) @ self.axes.T
        order = np.argsort(hashed, axis=0, kind="stable")
        # One array after the other, each shifted beyond the reach of the one before (no projection of a unit vector
        # exceeds the norm of its axis): all windows open by one search.
        self.shift = 2 * (float(np.sqrt((self.axes * self.axes).sum(axis=1)).max()) + half_width * RADII[-1] + 1) * np.arange(projections)
        self.sorted = (np.take_along_axis(hashed, order, axis=0) + self.shift).T.ravel()
        self.order = np.ascontiguousarray(order.T).ravel()
        p = math.erf(half_width / math.sqrt(2))
        self.half_width = half_width
        self.threshold = max(1, math.floor(projections * p - margin * math.sqrt(projections * p * (1 - p))))

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """Up to k (score, id), best first, without the query's own id."""
        n, norm = len(self.ids), math.sqrt(float((query * query).sum()))
        at = self.axes @ (query / norm) + self.shift
        low = high = np.searchsorted(self.sorted, at)
        counts = np.zeros(n, np.int64)
        verified = self.ids == query_id
        found: list[tuple[float, int]] = []
        for radius in (*RADII, math.inf):
            if math.isinf(radius):
                fresh = np.flatnonzero(~verified)
            else:
                reach = radius * self.half_width
                ends = np.searchsorted(self.sorted, np.concatenate([at - reach, at + reach]))
                a, b = ends[: len(at)], ends[len(at) :]
                parts = [self.order[x:y] for x, y in zip(np.concatenate([a, high]).tolist(), np.concatenate([low, b]).tolist(), strict=True) if x < y]
                low, high = a, b
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=n)
                fresh = np.flatnonzero((counts >= self.threshold) & ~verified)
            if len(fresh):
                verified[fresh] = True
                score = (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)
                top = np.lexsort((self.ids[fresh], -score))[:k]
                found = sorted([*found, *zip(-score[top], self.ids[fresh][top], strict=True)])[:k]
            # For unit vectors the squared distance is 2 - 2 cos.
            if len(found) == k and 2 + 2 * found[-1][0] <= radius * radius:
                break
        return [(float(-s), int(i)) for s, i in found]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and width of rows with an id and a finite vector that isn't zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return rows.withColumn("width", F.size("embedding"))


def _pack(table: pa.Table) -> pa.Table:
    flat = table.column("embedding").combine_chunks()
    data = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ids = table.column("vec_id").to_numpy().astype(np.int64)
    return pa.table({"width": pa.array([table.column("width")[0].as_py()], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())})


def blocks(rows: DataFrame, size: int, n_rows: int) -> tuple[DataFrame, int]:
    """Rows of each width dealt by a hash of the id over blocks of at most about ``size`` vectors, each packed into one row."""
    count = max(1, -(-n_rows // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
    return dealt.groupBy("width", "block").applyInArrow(_pack, "width int, block int, ids binary, data binary"), count


def search(vectors: DataFrame, is_query, k: int = 5, block_rows: int = 16_384, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to every row for which ``is_query`` holds, by cosine.

    Null, zero and non-finite vectors and rows without id take no part. A cosine is defined between vectors of one width,
    so each width is searched by itself. Ties go to the smaller id. Of equal vectors only the k + 1 smallest ids can be in an answer, so only those are indexed; all
    of them are queries where they ask. Other columns are not read; an empty table gives an empty result.
    """
    rows = cut(usable(vectors), "ann-rows")
    first = Window.partitionBy("embedding").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(first)).filter(F.col("copy") <= k + 1).select("vec_id", "embedding", "width")
    indexed = cut(indexed, "ann-indexed")
    asking = rows.filter(is_query)
    packed, _ = blocks(indexed, block_rows, indexed.count())
    queries, chunks = blocks(asking, query_rows, asking.count())
    queries = queries.select("width", F.col("block").alias("chunk"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"))
    # Each block meets each chunk of the stated queries once; a block's index is built once for chunks that follow.
    pairs = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(queries, ["width", "chunk"])
    pairs = pairs.repartition("width", "block", "chunk").sortWithinPartitions("width", "block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if at != (r["width"], r["block"]):
                    ids = np.frombuffer(r["ids"], np.int64)
                    at, index = (r["width"], r["block"]), CollisionIndex(ids, np.frombuffer(r["data"], np.float64).reshape(len(ids), -1))
                asked = np.frombuffer(r["query_ids"], np.int64)
                data = np.frombuffer(r["query_data"], np.float64).reshape(len(asked), -1)
                found = [(int(q), i, s) for q, v in zip(asked, data, strict=True) for s, i in index.nearest(int(q), v, k)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(run, SCHEMA)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
