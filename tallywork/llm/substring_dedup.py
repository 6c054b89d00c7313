"""Suffix-array dedup of long repeated substrings over whole documents, as bytes.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller document id, or the same document
and an earlier start) is removed. Strings are judged on the input.

1. Equal texts are one text; the others than its first document lose all they have (if it holds ``length`` bytes).
2. Each text selects anchors: the least of the hashes of all ``grain``-byte strings within each window of ``length``
   bytes. Equal windows select the same anchor, so only anchors that occur twice can lie in repeated strings.
3. For those, the windows that select the anchor (they lie side by side) are cut out as one region. Equal regions of an
   anchor are kept once, with their first and last place: what is repeated in the last is so in all but the first.
4. Regions of an anchor meet in one task and become one text, of which ``suffix_array`` sorts type B suffixes directly
   and induces the others; neighbours with a common prefix of ``length`` are equal strings, and all but the earliest
   start of a run are covered. An anchor with very many different regions (a passage in many contexts) is settled by a
   join on hashes of its windows instead, so no task gathers it.
5. Covered intervals go to their documents, are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.byte_words import chunks, column_bytes
from tallywork.llm.shared import cut, documents, key_bitmap, marked, prune, text_of
from tallywork.llm.shingles import _power, mix
from tallywork.llm.suffix_array import new_prefixes, suffix_array, words_at

QUERY = "op1_suffix_array_dedup"
ORACLE_SQL = None
GRAIN = 24
#: Bytes of regions that are sorted at once, and the different regions of one anchor up to which that is done.
SORT_BYTES, MOST_REGIONS = 3_000_000, 50_000
#: A byte that UTF-8 never uses; it ends each region.
END = 0xFF
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(104729).integers(1, 2**63, 256, dtype=np.uint64)


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=total[1:])
    n = max(0, len(data) - width + 1)
    return mix((total[width : width + n] - total[:n]) * _power(_INVERSE, len(data))[:n])


def anchors(text: bytes, length: int, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors of one text, where the windows that select each begin, and how many do."""
    if len(text) < length:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = _rolling(np.frombuffer(text, np.uint8), grain)
    low = np.uint64((1 << len(text).bit_length()) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties: leftmost
    width, have = length - grain + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    at = (least & low).astype(np.int64)  # never falls from one window to the next
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, counts = at[begins], np.diff(np.append(begins, len(at)))
    return hashes[at], at, begins, counts


def _mark(docs: DataFrame) -> DataFrame:
    digest = F.sha2(F.col("text"), 256)
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("sha256"))


def _anchor_rows(texts: DataFrame, length: int, only: np.ndarray | None = None) -> DataFrame:
    """doc_id, anchor, begin, count and a digest of text and position, for every anchor (that ``only`` marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = text.encode("utf-8", "surrogatepass")
                    h, at, begins, counts = anchors(data, length)
                    h = h.view(np.int64)
                    digest = np.uint64(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little"))
                    own = [np.full(len(h), doc, np.int64), h, begins, counts, mix(at.astype(np.uint64) + digest).view(np.int64)]
                    kept = slice(None) if only is None else marked(only, h)
                    for column, values in zip(columns, own, strict=True):
                        column.append(values[kept])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["doc_id", "anchor", "begin", "count", "place"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long, begin long, count long, place long")


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all stretches one after another, and their bounds."""
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], ends - starts)], bounds


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _regions(held: DataFrame, length: int) -> DataFrame:
    """held: doc_id, text, places (anchor, begin, count) -> a row for each place with its region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places = batch.column("doc_id").to_numpy(), batch.column("places")
            for first, end, data, bounds in chunks(batch.column("text")):
                own = places.slice(first, end - first)
                text = np.repeat(np.arange(end - first), own.value_lengths().to_numpy())
                anchor, begin, count = (c.to_numpy() for c in own.flatten().flatten())
                starts = np.minimum(bounds[text] + begin, bounds[text + 1])
                regions = _binary(*_gathered(data, starts, np.minimum(starts + count - 1 + length, bounds[text + 1])))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(docs[first:end][text]), pa.array(begin), regions], ["anchor", "doc_id", "begin", "region"])

    return held.select("doc_id", "text", "places").mapInArrow(run, "anchor long, doc_id long, begin long, region binary")


def covered(data: np.ndarray, bounds: np.ndarray, docs: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of a region, start and end within it of what is covered by strings that start earlier in another place.

    Regions lie one after another in ``data``, each followed by END; docs and begins tell their places."""
    sizes, starts, text = np.diff(bounds), bounds[:-1], data
    words = words_at(text)
    of = np.repeat(np.arange(len(sizes)), sizes)
    whole = (starts + sizes - 1)[of] - np.arange(len(text)) >= length  # where a string of ``length`` begins
    array = suffix_array(text, words, length, whole)
    array = array[whole[array]]
    if not len(array):
        return (np.zeros(0, np.int64),) * 3
    new = new_prefixes(array, words, length)
    place = begins[of[array]] + array - starts[of[array]]
    place += np.unique(docs, return_inverse=True)[1][of[array]] * (place.max() + 1)
    earliest = np.minimum.reduceat(place, np.flatnonzero(new))
    hit = np.sort(array[place != earliest[np.cumsum(new) - 1]])
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    apart = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
    first, last = hit[apart], hit[np.append(np.flatnonzero(apart)[1:] - 1, len(hit) - 1)]
    return of[first], first - starts[of[first]], last - starts[of[last]] + length


def _sorted_cover(distinct: DataFrame, length: int) -> DataFrame:
    """distinct: anchor, r1, r2, region, first and last (doc_id, begin) -> r1, r2, anchor, is_first, start, end."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        (first_doc, first_begin), (last_doc, last_begin) = ([c.to_numpy() for c in rows.column(k).flatten()] for k in ("first", "last"))
        data, bounds = column_bytes(rows.column("region"))
        of = np.repeat(np.arange(rows.num_rows), 1 + ((first_doc != last_doc) | (first_begin != last_begin)))
        is_first = np.concatenate([[True], of[1:] != of[:-1]])
        # With a byte more for each, which becomes its end.
        text, own = _gathered(np.append(data, np.uint8(END)), bounds[of], bounds[of + 1] + 1)
        text[own[1:] - 1] = END
        found, start, end = covered(text, own, np.where(is_first, first_doc[of], last_doc[of]), np.where(is_first, first_begin[of], last_begin[of]), length)
        keys = [rows.column(k).take(pa.array(of[found])) for k in ("anchor", "r1", "r2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array(is_first[found]), pa.array(start), pa.array(end)], ["anchor", "r1", "r2", "is_first", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, bounds = batch.column("anchor").to_numpy(), column_bytes(batch.column("region"))[1]
            new, at = np.flatnonzero(np.concatenate([[anchor[0] != last], anchor[1:] != anchor[:-1]])), 0
            while len(new := new[size + 2 * (bounds[new] - bounds[at]) > SORT_BYTES]):
                yield flush([*held, batch.slice(at, new[0] - at)])
                held, size, at = [], 0, int(new[0])
            held.append(batch.slice(at))
            size += int(2 * (bounds[-1] - bounds[at]))
            last = anchor[-1]
        if held:
            yield flush(held)

    schema = "anchor long, r1 long, r2 long, is_first boolean, start long, end long"
    return distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)


def _hashed_cover(distinct: DataFrame, length: int) -> DataFrame:
    """The same by joins on the digests of windows, for anchors with more regions than a task should gather."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(at, 512).to_pylist():
                    for s in range(len(r["region"]) - length + 1):
                        d = hashlib.blake2b(r["region"][s : s + length], digest_size=16).digest()
                        for first in (True, False):
                            place = r["first"] if first else r["last"]
                            rows.append((r["anchor"], r["r1"], r["r2"], first, s, d, place["doc_id"], place["begin"] + s))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["anchor", "r1", "r2", "is_first", "start", "window", "doc_id", "at"])

    windows = distinct.mapInArrow(run, "anchor long, r1 long, r2 long, is_first boolean, start long, window binary, doc_id long, at long")
    heads = windows.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count("*").alias("n")).filter("n > 1").select("window", "head")
    later = windows.join(heads, "window").filter("doc_id <> head.doc_id or at <> head.at")
    return later.select("anchor", "r1", "r2", "is_first", "start", (F.col("start") + length).alias("end"))


SPANS = "array<struct<start:long,end:long>>"


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that some span covers."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)], strict=True))


def _cut_out(held: DataFrame) -> DataFrame:
    """held: doc_id, text, spans (start, end) -> what the operator returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data, spans = text.encode("utf-8", "surrogatepass"), _merged(spans)
                kept = hashlib.sha256(_without(data, spans)).hexdigest()
                rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), kept, [{"start": a, "end": b} for a, b in spans]))
            kinds = (*[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return held.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}")


def kept_bytes(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """doc_id and kept (the remaining bytes of the text) for every row of ``docs`` with an id, from what
    ``remove_repeats`` found. A span may begin or end inside a character, so what is kept need not be UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept = [_without(t.encode("utf-8", "surrogatepass"), [(s["start"], s["end"]) for s in own or []]) for t, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    cut_texts = repeats.filter("n_spans > 0 and doc_id is not null").select(F.col("doc_id").alias("own_id"), "spans").dropDuplicates(["own_id"])
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.join(cut_texts, F.col("doc_id") == F.col("own_id"), "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed runs of bytes, in order) of every row of ``docs``.

    Null texts are empty and lose nothing, as do texts shorter than ``length`` bytes. Rows with a null id take no part
    and keep all. Repeated rows are one document, its result repeated; ids should otherwise be unique (of different
    texts under one id, each counts as that document). Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marks = cut(_mark(texts), "marks")
    usable = marks.filter(f"n_bytes >= {length} and doc_id is not null")
    firsts = usable.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id <> last_id")
    copies = cut(usable.join(firsts, "sha256").filter("doc_id <> first_id").select("doc_id", "sha256").distinct(), "copies")
    whole = texts.filter("doc_id is not null")
    # The same place of equal texts counts once.
    met = _anchor_rows(whole, length).groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    twice = cut(met.filter("low <> high").select("anchor"), "anchors")
    again = _anchor_rows(whole, length, key_bitmap(twice, "anchor")).select("anchor", "doc_id", "begin", "count").join(twice, "anchor")
    places = again.join(copies.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "begin", "count")).alias("places"))
    places = cut(places, "places").withColumnRenamed("doc_id", "own_id")
    near = prune(whole, "doc_id", key_bitmap(places, "own_id"))
    regions = _regions(near.join(places, F.col("doc_id") == F.col("own_id")), length)
    regions = cut(regions.withColumns({"r1": F.xxhash64("region"), "r2": F.xxhash64(F.lit(97), "region")}), "regions")
    place = F.struct("doc_id", "begin")
    distinct = regions.groupBy("anchor", "r1", "r2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.any_value("region").alias("region"))
    distinct = cut(distinct.filter(F.length("region") >= length), "distinct")
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("n_regions")).filter(F.col("n_regions") > MOST_REGIONS).select("anchor")
    crowded = cut(crowded, "crowded")
    cover = _sorted_cover(distinct.join(crowded, "anchor", "left_anti").select("anchor", "r1", "r2", "region", "first", "last"), length)
    cover = cut(cover.union(_hashed_cover(distinct.join(crowded, "anchor", "left_semi"), length)), "cover")
    cover = cut(cover.join(distinct.select("anchor", "r1", "r2", "first"), ["anchor", "r1", "r2"]), "cover-places")
    spans = (
        regions.select("anchor", "r1", "r2", "doc_id", "begin")
        .join(cover, ["anchor", "r1", "r2"])
        .filter((F.struct("doc_id", "begin") == F.col("first")) == F.col("is_first"))
        .select(F.col("doc_id").alias("own_id"), (F.col("begin") + F.col("start")).alias("start"), (F.col("begin") + F.col("end")).alias("end"))
    )
    spans = cut(spans.groupBy("own_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    changed = _cut_out(prune(whole, "doc_id", key_bitmap(spans, "own_id")).join(spans, F.col("doc_id") == F.col("own_id")))
    empty = hashlib.sha256(b"").hexdigest()
    emptied = copies.join(marks, ["doc_id", "sha256"]).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"))
    done = spans.select("own_id").union(copies.select("doc_id"))
    rest = marks.join(done, marks["doc_id"] == done["own_id"], "left_anti").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.array().cast(SPANS).alias("spans"))
    return changed.union(emptied).union(rest)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.to_json("spans").alias("spans"))
