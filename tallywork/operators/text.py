"""Chunks, similarity search and prompts over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stride_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of ``size`` characters that begin every size - overlap characters; none of an empty text."""
    # One walk through the text: each match moves on by a stride and looks ahead for its piece.
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"), F.lit(1))


def split_recursively(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the coarsest separator that helps; neighbouring pieces are merged up to ``size`` with an overlap."""
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    parts = [p for p in (text.split(separator) if separator else text) if p]
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        joined = separator.join(held).strip()
        if joined:
            out.append(joined)

    length = lambda items: sum(map(len, items)) + len(separator) * max(0, len(items) - 1)
    for part in parts:
        if len(part) > size and finer:
            close()
            held.clear()
            out += split_recursively(part, size, overlap, finer)
            continue
        if held and length([*held, part]) > size:
            close()
            while held and (length(held) > overlap or length([*held, part]) > size):
                held.pop(0)
        held.append(part)
    close()
    return out


# The white space that Python's str.strip takes.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = "array<struct<text:string,done:boolean>>"


def _literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + "".join(f"\\u{ord(c):04x}" if not c.isalnum() else c for c in text) + "'"


def _stripped(sql: str) -> str:
    return f"trim(BOTH {_literal(BLANKS)} FROM {sql})"


def _one_level(separator: str, size: int, overlap: int) -> str:
    """SQL from ``item.text`` to its pieces: merged parts are done, parts longer than ``size`` are left for finer levels.

    A fold over the parts (and one place after them, which closes) keeps where the held parts begin and how long they
    are; where the next part doesn't fit, a fold backwards over the held ones finds those that stay as overlap.
    """
    mark, w = _literal(separator), len(separator)
    part = "get(parts, j)"
    long = f"length({part})"
    chunk = _stripped(f"array_join(slice(parts, s.start + 1, j - s.start), {mark})")
    too_long, full = f"{long} > {size}", f"s.held > 0 AND s.held + {w} + {long} > {size}"
    close = f"s.held > 0 AND ({part} IS NULL OR {too_long} OR {full})"
    longer = f"(k.held + if(k.held > 0, {w}, 0) + length(get(parts, i)))"
    fits = f"k.open AND {longer} <= {overlap} AND {longer} + {w} + {long} <= {size}"
    kept = f"""aggregate(sequence(j - 1, s.start, -1), named_struct('start', j, 'held', 0, 'open', true),
        (k, i) -> if({fits}, named_struct('start', i, 'held', {longer}, 'open', true), named_struct('start', k.start, 'held', k.held, 'open', false)))"""
    out = f"""if({close} OR coalesce({too_long}, false), concat(s.out,
        if({close} AND {chunk} <> '', array(named_struct('text', {chunk}, 'done', true)), cast(array() as {_PIECES})),
        if({too_long}, array(named_struct('text', {part}, 'done', false)), cast(array() as {_PIECES}))), s.out)"""
    moved = f"""if({too_long} OR {part} IS NULL, named_struct('start', j + 1, 'held', 0),
        if({full}, element_at(transform(array({kept}), k -> named_struct('start', k.start, 'held', if(k.held > 0, k.held + {w}, 0) + {long})), 1),
        named_struct('start', if(s.held > 0, s.start, j), 'held', if(s.held > 0, s.held + {w}, 0) + {long})))"""
    step = f"element_at(transform(array({moved}), m -> named_struct('out', {out}, 'start', m.start, 'held', m.held)), 1)"
    fold = f"aggregate(sequence(0, size(parts)), named_struct('out', cast(array() as {_PIECES}), 'start', 0, 'held', 0), (s, j) -> {step}, s -> s.out)"
    split = f"filter(split(item.text, {_literal(separator)}, -1), p -> p <> '')"
    return f"element_at(transform(array({split}), parts -> {fold}), 1)"


def split_column(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = ("\n\n", "\n", " ")) -> Column:
    """The chunks of ``split_recursively`` as array functions over a column, finer levels taken one after the other.

    The last level cuts between characters. Null and empty texts have no chunks. Separators are plain text without
    signs of regular expressions.
    """
    items = f"if(length({text}) > 0, array(named_struct('text', {text}, 'done', false)), cast(array() as {_PIECES}))"
    for separator in separators:
        items = f"flatten(transform({items}, item -> if(item.done OR NOT contains(item.text, {_literal(separator)}), array(item), {_one_level(separator, size, overlap)})))"
    stride = size - overlap
    last = f"sequence(0, cast(ceil(greatest(length(item.text) - {size}, 0) / {stride}) as int))"
    cut = f"transform({last}, i -> {_stripped(f'substring(item.text, i * {stride} + 1, {size})')})"
    texts = f"flatten(transform({items}, item -> if(item.done, array(item.text), {cut})))"
    return F.expr(f"filter({texts}, c -> c <> '')")


def recursive_chunks(df: DataFrame, key: str, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk_id and content for each chunk."""
    return df.select(key, F.posexplode(split_column(text, size, overlap)).alias("chunk_id", "content"))


def dot(a: Column, b: Column) -> Column:
    """In double precision; null where a component is."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def most_similar(vectors: DataFrame, query: Sequence[float], k: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector by cosine; the query is a literal, so the search is one scan and a top k."""
    point = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(vector), point).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Rows that are joined at once on the way to the text of a group.
PIECE_ROWS = 1000


def pieces(df: DataFrame, by: str, order: str, text: str, separator: str) -> DataFrame:
    """_by, at, rows, piece: each group cut into runs of at most PIECE_ROWS neighbouring rows, the texts of a run joined.

    Rows are range-partitioned and sorted by group, order and text, so a long group lies in several partitions, and a
    run is a stretch of places in one of them: it is joined where its rows are. A run without a text has a null piece.
    """
    keys = ["_by", "_order", "_text"]
    rows = df.select(F.col(by).alias("_by"), F.col(order).alias("_order"), F.col(text).cast("string").alias("_text"))
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    run = F.floor(F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) / PIECE_ROWS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda s: s["_text"]), separator)
    out = placed.groupBy("_by", F.shiftright("_at", 33).alias("part"), run.alias("run"))
    return out.agg(F.min("_at").alias("at"), F.count("*").alias("rows"), F.when(F.count("_text") > 0, joined).alias("piece")).select("_by", "at", "rows", "piece")


def combine(df: DataFrame, by: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a group in order as one; null texts are skipped, rows of equal order follow each other by text.

    No list of a group's rows is made: its pieces are joined. A group of null texts has an empty text; a null order
    comes first.
    """
    items = F.array_sort(F.collect_list(F.struct("at", "piece")))
    joined = F.array_join(F.transform(items, lambda s: s["piece"]), separator)
    return pieces(df, by, order, text, separator).groupBy("_by").agg(joined.alias("combined")).withColumnRenamed("_by", by)


def messages(*pairs: tuple[str, Column]) -> Column:
    """Role-tagged messages as an array of structs."""
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in pairs))


def term_slot(word: Column, width: int) -> Column:
    """The place of a word in a hashed vector: the first 32 bits of its MD5 digest, modulo the width."""
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


def term_vectors(df: DataFrame, key: str, text: str = "text", width: int = 64) -> DataFrame:
    """Hashed term frequencies of unit length: a stand-in for an embedding model that needs no network."""
    words = df.select(key, F.explode(F.split(F.lower(F.col(text)), r"\W+")).alias("w")).filter("w <> ''")
    counts = words.groupBy(key, term_slot(F.col("w"), width).alias("slot")).agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    rows = counts.withColumn("x", F.col("n") / norm).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vector"))


def route(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first rule whose phrase the text contains."""
    out = F.lit(None).cast("string")
    for phrase, name in rules:
        out = F.coalesce(out, F.when(text.contains(phrase), F.lit(name)))
    return F.coalesce(out, F.lit(default))
