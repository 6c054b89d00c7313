"""Connected components by joins: minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.shared import cut, drop, tidy

#: Nodes that one task joins up at a time.
FOREST_NODES = 400_000


def _forests(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes: within each partition every node is tied to the smallest it can reach there."""

    def flush(root: dict[int, int]) -> pa.RecordBatch:
        ends: list[tuple[int, int]] = []
        for node in sorted(root):  # a root precedes what it is tied to
            root[node] = root[root[node]]
            if root[node] != node:
                ends.append((root[node], node))
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(node: int) -> int:
            while (up := root.setdefault(node, node)) != node:
                root[node] = up = root[up]
                node = up
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
            if len(root) > FOREST_NODES:
                yield flush(root)
                root.clear()
        if root:
            yield flush(root)

    return edges.mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b: long): root is the smallest node that can be reached.

    Rounds go on until no label changes; each round lowers at least one. A hub's edges are never gathered in one task:
    minima are partly aggregated, and the joins have no operator above them that needs a key's rows together, so skewed
    ones may be split. Tables of a round are removed when the next ones are written.
    """
    pairs = _forests(edges.filter("a <> b").select("a", "b")).distinct()
    pairs = cut(pairs, "pairs")
    both = cut(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    drop(pairs)
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root", F.lit(True).alias("changed")), "labels")
    while not labels.filter("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("before"))
        low = cut(low, "labels")
        up = low.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = F.least("root", "above")
        now = cut(low.join(up, "root").select("node", jumped.alias("root"), (jumped < F.col("before")).alias("changed")), "labels")
        drop(labels, low)
        labels = now
    drop(both)
    return labels.select("node", "root")
