"""Chunks, pages, conversations, prompts and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywork.functions import scalar as S
from tallywork.operators import text as X
from tallywork.operators.index import TextIndex
from tallywork.plans.catalogue import register, table
from tallywork.sources.io import page_text, shared_path


@register("chunk_stride", "SELECT doc_id, unnest(list_transform(range(1, length(text) + 1, 800), lambda i: substr(text, i, 1000))) AS chunk, unnest(range(0, len(range(1, length(text) + 1, 800)))) AS chunk_id FROM documents")
def chunk_stride(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(X.stride_chunks(F.col("text"))).alias("chunk_id", "chunk"))
    return out.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "chunk")


def _chunk_sql(size: int = 1000, overlap: int = 200) -> str:
    """SQL of the recursive splitter: one set of CTEs a level, then the merged chunks of all runs of parts by recursion.

    o{k} holds texts that level k splits, p{k} their parts with the number of too long parts before each, r{k} the runs of
    short parts. ``sums`` are the lengths of a run's first parts, a separator after each.
    """
    blanks = " || ".join(f"chr({ord(c)})" for c in X.BLANKS)
    ctes, seps = ["o1 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text AS t FROM documents WHERE length(text) > 0)"], ["chr(10) || chr(10)", "chr(10)", "' '"]
    for k, sep in enumerate(seps, 1):
        width = 2 if k == 1 else 1
        ctes += [
            f"s{k} AS (SELECT doc_id, path, unnest(string_split(t, {sep})) AS p, generate_subscripts(string_split(t, {sep}), 1) AS i FROM o{k} WHERE contains(t, {sep}))",
            f"p{k} AS (SELECT doc_id, path, i, p, count(*) FILTER (length(p) > {size}) OVER (PARTITION BY doc_id, path ORDER BY i) AS before FROM s{k} WHERE p <> '')",
            f"o{k + 1} AS (SELECT doc_id, path, t FROM o{k} WHERE NOT contains(t, {sep}) UNION ALL SELECT doc_id, list_append(path, i), p FROM p{k} WHERE length(p) > {size})",
            f"q{k} AS (SELECT *, sum(length(p) + {width}) OVER (PARTITION BY doc_id, path, before ORDER BY i) AS upto FROM p{k} WHERE length(p) <= {size})",
            f"r{k} AS (SELECT doc_id, list_append(path, min(i)) AS path, list(p ORDER BY i) AS ps, list(upto ORDER BY i) AS sums, {sep} AS sep, {width} AS w FROM q{k} GROUP BY doc_id, path, before)",
        ]
    runs = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(1, len(seps) + 1))
    last = f"len(list_filter(sums, lambda v: v <= {size} + w + base))"
    first = f"least({last} + 1, len(list_filter(sums, lambda v: v < greatest(sums[{last}] - w - {overlap}, sums[{last} + 1] - w - {size}))) + 2)"
    ctes += [
        f"r AS ({runs})",
        f"""c AS (SELECT doc_id, path, ps, sums, sep, w, 1::BIGINT AS a, {last.replace("base", "0")} AS b FROM r UNION ALL
        SELECT doc_id, path, ps, sums, sep, w, a, len(list_filter(sums, lambda v: v <= {size} + w + coalesce(sums[a - 1], 0))) FROM
          (SELECT doc_id, path, ps, sums, sep, w, {first.replace(last, "b")} AS a FROM c WHERE b < len(ps)))""",
        f"chunks AS (SELECT doc_id, list_append(path, a) AS path, CASE {' '.join(f'WHEN sep = {sep} THEN array_to_string(ps[a:b], {sep})' for sep in seps)} END AS t FROM c)",
        f"letters AS (SELECT doc_id, path, t, unnest(range(0, CAST(ceil(greatest(length(t) - {size}, 0) / {size - overlap}.0) AS BIGINT) + 1)) AS i FROM o{len(seps) + 1})",
        f"every AS (SELECT * FROM chunks UNION ALL SELECT doc_id, list_append(path, i), substr(t, i * {size - overlap} + 1, {size}) FROM letters)",
        f"bare AS (SELECT doc_id, path, trim(t, {blanks}) AS content FROM every)",
    ]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INT) AS chunk_id, content FROM bare WHERE content <> ''"


@register("chunk_recursive", _chunk_sql())
def chunk_recursive(spark, d):
    return X.recursive_chunks(table(spark, d, "documents"), "doc_id")


@register("text_lengths", "SELECT count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(length(text)) AS longest FROM documents")
def text_lengths(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).cast("long").alias("n_chars"), F.max(n).cast("long").alias("longest"))


@register(
    "html_to_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script)\b.*?</script\s*>|<(style)\b.*?</style\s*>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS text FROM pages""",
)
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@register("chat_transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS combined FROM conversations GROUP BY conv_id")
def chat_transcript(spark, d):
    lines = table(spark, d, "conversations").withColumn("line", F.concat_ws(": ", "role", "text"))
    return X.combine(lines, "conv_id", "turn", "line", "\n")


@register("prompt_fill", "SELECT doc_id, 'Answer in ' || lang || ' from this source: ' || source || chr(10) || text AS prompt FROM documents")
def prompt_fill(spark, d):
    head = F.replace(F.lit("Answer in {language} from this source: "), F.lit("{language}"), F.col("lang"))
    prompt = F.concat(head, S.fill("{source}\n", source=F.col("source")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))


@register("role_messages", "SELECT doc_id, '[{\"role\":\"system\",\"content\":\"' || lang || '\"},{\"role\":\"user\",\"content\":\"' || source || '\"}]' AS messages FROM documents")
def role_messages(spark, d):
    return table(spark, d, "documents").select("doc_id", F.to_json(X.messages(("system", F.col("lang")), ("user", F.col("source")))).alias("messages"))


_POINT = [((7 * k) % 11 - 5) / 10 for k in range(64)]


@register(
    "topk_similarity",
    f"""WITH q AS (SELECT {_POINT}::DOUBLE[] AS v) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS score
    FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) DESC, vec_id LIMIT 4""",
)
def topk_similarity(spark, d):
    return X.most_similar(table(spark, d, "embeddings"), _POINT).select("vec_id", F.round("score", 6).alias("score"))


@register(
    "term_vectors",
    r"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\W+')) AS w FROM documents),
    n AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INT) AS slot, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL)
    SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM n""",
)
def term_vectors(spark, d):
    vectors = X.term_vectors(table(spark, d, "documents"), "doc_id")
    return vectors.select("doc_id", F.posexplode("vector").alias("slot", "x")).filter("x > 0").select("doc_id", "slot", F.round("x", 6).alias("x"))


@register(
    "index_search",
    r"""WITH w AS (SELECT doc_id AS k, unnest(string_split_regex(lower(text), '\W+')) AS term FROM documents),
    c AS (SELECT k, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL), z AS (SELECT k, sum(tf) AS size FROM c GROUP BY k), m AS (SELECT count(*) AS n, avg(size) AS mean FROM z),
    d AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    i AS (SELECT term, k, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS impact FROM c JOIN z USING (k) JOIN d USING (term), m),
    v AS (SELECT item_id, unnest(string_split_regex(lower(text), '\W+')) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) AS weight FROM v WHERE term <> '' GROUP BY ALL),
    s AS (SELECT item_id, k, sum(weight * impact) AS score FROM q JOIN i USING (term) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, k) AS rank FROM s)
    SELECT item_id, CAST(rank AS INT) AS rank, k AS doc_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def index_search(spark, d):
    """The five documents nearest to every benchmark item, by an index that is built, stored and opened again."""
    path = shared_path(spark, "text-index")
    TextIndex.build(table(spark, d, "documents"), "doc_id", "text", path)
    found, _ = TextIndex.open(spark, path, "doc_id").search(table(spark, d, "benchmark"), "item_id", "text", k=5)
    return found.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@register("intent_route", "SELECT conv_id, turn, CASE WHEN contains(text, 'the') THEN 'english' WHEN contains(text, 'que') THEN 'romance' ELSE 'other' END AS route FROM conversations")
def intent_route(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.route(F.col("text"), [("the", "english"), ("que", "romance")], "other").alias("route"))
