"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of word shingles.

1. Documents with equal sets are one class; its smallest id stands for it, and only that document takes part below.
2. Sets that link differ in few shingles, at most ``tau`` for their sizes. Dealt by hash over more than ``tau`` parts,
   they agree in several whole parts. Each class posts digests of its parts, for its own class of sizes and the next.
   Pairs that meet alone must meet as often as linked sets must at least. Those of longer lists are compared by counts
   of their shingles over buckets: the sum of differences is no more than the number of shingles in which they differ.
   A passage that many documents share thus connects none of them.
3. Within each component of such candidates, or each pair of blocks of a large one, sets are rewritten as differences
   to the shingles that most of them hold. Two sets link if they have enough differences in common: pairs that need
   none are counted by their order alone; for the others the shortest inverted lists of a set's differences are merged
   by a heap, and those with enough occurrences are probed by binary search in the L longest.
4. Every link between different classes counts; links that connect something new give the components.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.components import connected_components
from tallywork.llm.shared import cut, documents, drop, key_bitmap, marked, prune, text_of, tidy
from tallywork.llm.shingles import mix, shingle_sets

QUERY = "op8_ngram_jaccard"
ORACLE_SQL = None
#: Shingles that a block of a component holds on average.
BLOCK_SHINGLES = 1_000_000
#: Texts of a batch that are turned into sets at once.
SLICE = 512
#: Lists up to this length are compared pair by pair as far as needed; all of a longer one count as candidates.
LIST_ROWS = 20_000
#: Bits of a posting's key that say nothing but its need: a shuffle packs their zeros. Keys that fall together by chance
#: make a list longer and lose no candidate.
SHORT = 16
#: DivideSkip's weight of a probe against a step of the heap.
PROBE = 0.0085


def _sets(batch: pa.RecordBatch, words: int, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set of shingles) of the column ``text``, a slice of texts at a time; not of ids that ``skip`` marks."""
    if skip is not None:
        batch = batch.filter(pa.array(~marked(skip, batch.column("doc_id").to_numpy(zero_copy_only=False))))
    for first in range(0, batch.num_rows, SLICE):
        texts = [t or "" for t in batch.column("text").slice(first, SLICE).to_pylist()]
        yield from enumerate(shingle_sets(texts, words), first)


class SizeClasses:
    """Classes of set sizes such that linked sets lie in one class or in neighbouring ones, and their numbers of parts.

    Sets of class c meet sets of class c - 1 in the parts of class c. Linked sets there differ in at most ``tau``
    shingles, so of tau + need + spare parts at least need + spare agree. Of those at most ``spare`` are empty unless
    both sets have more empty parts; only such sets post their empty parts too. So linked sets meet ``need`` times.
    """

    #: What ``need`` can be; the two lowest bits of a posting say which.
    NEEDS = (1, 2, 4, 8)

    def __init__(self, percent: int):
        self.percent, self.bounds, self.layouts = percent, [0, 1], []

    def of(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(self.bounds[-1] * 100 // self.percent + 1)
        return bisect_right(self.bounds, n) - 1

    def layout(self, c: int) -> tuple[int, int, int, int]:
        """(parts, spare, place of need among NEEDS, buckets of counts) of class c."""
        while len(self.layouts) <= c:
            k = len(self.layouts)
            while len(self.bounds) <= k + 1:
                self.of(self.bounds[-1])
            top, least, spare = self.bounds[k + 1] - 1, max(1, self.bounds[max(k - 1, 0)]), 1
            tau = (100 - self.percent) * 2 * top // (100 + self.percent)
            level = sum(1 + tau // 16 >= x for x in self.NEEDS) - 1
            for _ in range(4):
                m = tau + self.NEEDS[level] + spare
                spare = math.ceil(1.6 * m * math.exp(-least / m)) + 1 if tau else 0
            self.layouts.append((tau + self.NEEDS[level] + spare, spare, level, max(16, top // 8)))
        return self.layouts[c]

    def postings(self, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, keys) of a sorted set for its own class and the next."""
        c = self.of(len(own))
        for k in (c, c + 1):
            m, spare, level, _ = self.layout(k)
            salt = np.uint64((k * 0x632BE59BD9B4E019) & (2**64 - 1))
            part = (mix(own + salt) % np.uint64(m)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            held = part[order]
            first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            digest = np.add.reduceat(mix(own ^ np.uint64(0x5851F42D4C957F2D))[order], first)
            keys = mix(digest + mix(held[first].astype(np.uint64) + salt))
            if m - len(first) > spare:
                empty = np.setdiff1d(np.arange(m), held[first])
                keys = np.concatenate([keys, mix(mix(empty.astype(np.uint64) + salt) ^ np.uint64(0x14057B7EF767814F))])
            yield k, ((keys & np.uint64(2**64 - 2**SHORT)) | np.uint64(level)).view(np.int64)

    def counts(self, own: np.ndarray, k: int) -> bytes:
        """How many shingles lie in each bucket of class k (255 stands for more, too)."""
        buckets = self.layout(k)[3]
        return np.minimum(np.bincount((mix(own ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(buckets)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _digests(own: np.ndarray) -> np.ndarray:
    """Two digests of a set that don't depend on its order."""
    return np.array([own.sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).view(np.int64)


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and two digests of the set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(own), *_digests(own).tolist()) for _, own in _sets(batch, words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _marked_sets(docs: DataFrame, words: int, only: np.ndarray) -> DataFrame:
    """doc_id and the shingles of every document that ``only`` marks, a slice of texts at a time."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(only, batch.column("doc_id").to_numpy(zero_copy_only=False))))
            for first in range(0, batch.num_rows, SLICE):
                some = batch.slice(first, SLICE)
                sets = pa.array([own.tobytes() for _, own in _sets(some, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), sets], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _postings(docs: DataFrame, words: int, percent: int, skip: np.ndarray | None = None) -> DataFrame:
    """term and node (the first digest of a set) for every posting of documents that ``skip`` doesn't mark."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in batches:
            terms, nodes, size = [], [], 0
            for _, own in _sets(batch, words, skip):
                if len(own):
                    node = _digests(own)[:1]
                    for _, keys in classes.postings(own):
                        terms.append(keys)
                        nodes.append(np.repeat(node, len(keys)))
                        size += len(keys)
                if size > 250_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms)), pa.array(np.concatenate(nodes))], ["term", "node"])
                    terms, nodes, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(terms)), pa.array(np.concatenate(nodes))], ["term", "node"])

    return docs.mapInArrow(run, "term long, node long")


def _lists(posted: DataFrame) -> DataFrame:
    """term, least node a, greatest node b and number n of postings of every term of several nodes.

    Nearly all terms have one posting, so nothing is gained by aggregating before the shuffle but wider rows.
    """
    dealt = posted.repartition("term")
    return dealt.groupBy("term").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).filter("a <> b")


def _listed(docs: DataFrame, words: int, percent: int, only: np.ndarray, skip: np.ndarray | None = None) -> DataFrame:
    """term, node, size of the set and counts over buckets for every such posting whose term ``only`` marks."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in batches:
            rows, held = [], 0
            for _, own in _sets(batch, words, skip):
                if len(own):
                    node = _digests(own)[0]
                    for k, keys in classes.postings(own):
                        keys = keys[marked(only, keys >> SHORT)]
                        if len(keys):
                            counts = classes.counts(own, k)
                            rows += [(t, node, len(own), counts) for t in keys.tolist()]
                            held += len(keys) * (32 + len(counts))
                if held > 8_000_000:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["term", "node", "size", "counts"])

    return docs.mapInArrow(run, "term long, node long, size long, counts binary")


def list_candidates(nodes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that connect all of one list (a row of ``counts`` for each) whose counts allow them to link."""
    counts, rest, edges = counts.astype(np.int16), np.arange(len(nodes)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            k = queue.pop()
            differ = np.abs(counts[rest] - counts[k]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * differ <= (100 - percent) * (sizes[rest] + sizes[k])
            edges += [(int(nodes[k]), int(nodes[j])) for j in rest[near]]
            queue += rest[near].tolist()
            rest = rest[~near]
    return edges


def _list_edges(listed: DataFrame, percent: int) -> DataFrame:
    """listed: term, node, size, counts, all rows of a term side by side in one partition -> candidate edges a, b."""

    def flush(rows: list[tuple]) -> list[tuple[int, int]]:
        edges = []
        for width in sorted({len(r[3]) for r in rows}):  # keys of several classes of sizes can fall together by chance
            some = [r for r in rows if len(r[3]) == width]
            nodes, sizes = np.array([r[1] for r in some]), np.array([r[2] for r in some])
            counts = np.frombuffer(b"".join(r[3] for r in some), np.uint8).reshape(len(some), width)
            edges += list_candidates(nodes, sizes, counts, percent)
        return edges

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            edges = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("term", "node", "size", "counts")), strict=True):
                if rows and rows[-1][0] != row[0]:
                    edges += flush(rows)
                    rows = []
                rows.append(row)
            yield _pairs(edges)
        if rows:
            yield _pairs(flush(rows))

    def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return listed.repartition("term").sortWithinPartitions("term").mapInArrow(run, "a long, b long")


def divide_skip(ids: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, percent: int, left: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each of ``sets`` (of distinct elements) the weights of the others that it links with, and links (id, id) that
    connect all that any links connect.

    ``left`` marks the members of one of two blocks; pairs within a block are then left to that block's own task.
    """
    n, plus, minus = len(sets), 100 + percent, 100 - percent
    sizes = np.array([len(s) for s in sets])
    terms, which, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    # The reference set: what more than half of all hold. Each set becomes its differences to that.
    usual = 2 * held_by > n
    of_usual = np.cumsum(usual) - 1
    lacks = np.ones((n, int(usual.sum())), bool)
    lacks[owner[usual[which]], of_usual[which[usual[which]]]] = False
    lack_owner, lack_term = np.nonzero(lacks)
    owner = np.concatenate([owner[~usual[which]], lack_owner])
    term = np.concatenate([which[~usual[which]], np.flatnonzero(usual)[lack_term]])
    # A and B link if plus * (|dA| + |dB| - 2 * common) <= minus * (|A| + |B|), that is lag A + lag B <= 2 * plus * common.
    lag = plus * np.bincount(owner, minlength=n) - minus * sizes
    order = np.lexsort((ids, lag))
    rank_of = np.empty(n, np.int64)
    rank_of[order] = np.arange(n)
    ids, lag, weights = ids[order], lag[order], weights[order]
    side = np.zeros(n, np.int64) if left is None else left[order].astype(np.int64)
    before = np.zeros((2, n + 1), np.int64)
    for s in (0, 1):
        before[s, 1:] = np.cumsum(np.where(side == s, weights, 0))
    ready = np.searchsorted(lag, -lag, side="right")  # ranks below it link without any difference in common
    against = side if left is None else 1 - side
    links = before[against, ready]
    root, found = list(range(n)), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def tie(a: int, b: int) -> None:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((int(ids[a]), int(ids[b])))

    if left is None:
        links -= np.where(np.arange(n) < ready, weights, 0)
        for k in range(1, ready[0] if n else 0):
            tie(0, k)
    else:
        for s in (0, 1):  # the first of each side reaches all that any of its side reaches
            if len(own := np.flatnonzero(side == s)):
                for k in np.flatnonzero(side[: ready[own[0]]] != s):
                    tie(int(own[0]), int(k))

    rank = rank_of[owner]
    by_term = np.lexsort((rank, term))
    listed = rank[by_term].tolist()  # the inverted lists of differences, each sorted by rank
    ends = np.cumsum(np.bincount(term, minlength=len(terms)))[term[by_term]]
    of_rank = np.argsort(rank[by_term], kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=n))])
    ends, side, lag, ready = ends.tolist(), side.tolist(), lag.tolist(), ready.tolist()
    for k in range(n):
        low = max(k + 1, ready[k])
        if low >= n:
            continue
        least = -(-(lag[k] + lag[low]) // (2 * plus))
        own = of_rank[starts[k] : starts[k + 1]].tolist()
        if len(own) < least:
            continue
        lists = [(bisect_left(listed, low, at + 1, ends[at]), ends[at]) for at in own]
        lists = sorted((e - a, a, e) for a, e in lists if a < e)
        if len(lists) < least:
            continue
        skipped = min(least - 1, int(least / (PROBE * math.log(lists[-1][0] + 1) + 1)))
        short, long = lists[: len(lists) - skipped], lists[len(lists) - skipped :]
        for other, run in groupby(merge(*(listed[a:e] for _, a, e in short))):
            common = sum(1 for _ in run)
            if common + skipped < least or left is not None and side[other] == side[k]:
                continue
            for _, a, e in long:
                at = bisect_left(listed, other, a, e)
                common += at < e and listed[at] == other
            if lag[k] + lag[other] <= 2 * plus * common:
                links[k] += weights[other]
                links[other] += weights[k]
                tie(k, other)
    out = np.empty(n, np.int64)
    out[order] = links
    return out, found


def _links(members: DataFrame, percent: int) -> DataFrame:
    """members: component, part_a, part_b, part, class_id, n_docs, shingles -> a, b (null in a row of counts), n_links."""

    def run(table: pa.Table) -> pa.Table:
        ids, weights = table.column("class_id").to_numpy(), table.column("n_docs").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        a, b = table.column("part_a")[0].as_py(), table.column("part_b")[0].as_py()
        left = None if a == b else table.column("part").to_numpy() == a
        links, found = divide_skip(ids, sets, weights, percent, left)
        rows = [(x, y, 0) for x, y in found] + [(x, None, n) for x, n in zip(ids.tolist(), links.tolist(), strict=True) if n]
        return pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("a", "b", "n_links"))})

    return members.groupBy("component", "part_a", "part_b").applyInArrow(run, "a long, b long, n_links long")


def _copies(texts: DataFrame, rows: DataFrame, classes: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """A bitmap that marks all documents but one of each class, and doc_id and text of those that it marks wrongly.

    Only what it marks is shuffled.
    """
    copies = rows.join(classes.select("class_id"), rows["doc_id"] == F.col("class_id"), "left_anti")
    bits = key_bitmap(copies, "doc_id")
    seen = prune(texts, "doc_id", bits).join(classes.select("class_id"), F.col("doc_id") == F.col("class_id"), "left_semi")
    return bits, seen.dropDuplicates(["doc_id"])


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and n_links of every row of ``docs``.

    n_links counts the other documents that a document links with, copies included. Null and empty texts and texts
    without words have no shingles; they link with nothing, class_id and component_id are their own ids. Rows with a
    null id take no part; both ids are null, n_links is 0. Repeated rows are copies of one document; of different texts
    under one id each counts as that document. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = cut(_signatures(texts, words), "signatures")
    live = rows.filter("n_shingles > 0 and doc_id is not null")
    key = ["d1", "d2", "n_shingles"]
    classes = cut(live.groupBy(*key, "doc_id").count().groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs")), "classes")
    texts = texts.filter("doc_id is not null")
    copies, more = _copies(texts, live, classes)
    more = cut(more, "representatives")
    posted = _postings(texts, words, percent, copies).union(_postings(more, words, percent))
    lists = cut(_lists(posted), "lists")
    need = F.get(F.array(*map(F.lit, SizeClasses.NEEDS)), F.col("level").cast("int"))
    pairs = lists.filter("n = 2").groupBy("a", "b", F.col("term").bitwiseAND(F.lit(3)).alias("level")).agg(F.count("*").alias("met")).filter(F.col("met") >= need)
    longer = lists.filter("n > 2").select("term", "a", "n")
    bits = key_bitmap(longer.select(F.shiftright("term", SHORT).alias("key")), "key")
    listed = _listed(texts, words, percent, bits, copies).union(_listed(more, words, percent, bits)).join(longer, "term")
    listed = cut(listed, "listed")
    compared = _list_edges(listed.filter(F.col("n") <= LIST_ROWS).select("term", "node", "size", "counts"), percent)
    wide = listed.filter((F.col("n") > LIST_ROWS) & (F.col("a") != F.col("node"))).select("a", F.col("node").alias("b"))
    edges = cut(pairs.select("a", "b").union(compared).union(wide), "candidates")
    drop(lists, listed, more)
    near = connected_components(edges)
    drop(edges)
    sized = near.join(classes.select(F.col("d1").alias("node"), "n_shingles", "class_id", "n_docs"), "node")
    parts = sized.groupBy("root").agg(F.sum("n_shingles").alias("total")).withColumn("parts", F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)).cast("int"))
    part = F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int")
    placed = cut(sized.join(parts, "root").select("class_id", "n_docs", F.col("root").alias("component"), "parts", part.alias("part")), "placed")
    sets = _marked_sets(texts, words, key_bitmap(placed, "class_id"))
    members = placed.join(sets, F.col("class_id") == F.col("doc_id")).drop("doc_id")
    members = cut(members.dropDuplicates(["class_id"]), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = members.withColumn("other", other).withColumns({"part_a": F.least("part", "other"), "part_b": F.greatest("part", "other")}).drop("other", "parts")
    links = cut(_links(spread, percent), "links")
    drop(placed, members)
    roots = connected_components(links.filter("b is not null"))
    counted = links.filter("b is null").groupBy("a").agg(F.sum("n_links").alias("n_links"))
    known = (
        classes.join(roots, F.col("class_id") == F.col("node"), "left")
        .join(counted, F.col("class_id") == F.col("a"), "left")
        .select(*key, "class_id", F.coalesce("root", "class_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    )
    out = rows.join(known, key, "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).alias("n_links"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), words=3, percent=90).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
