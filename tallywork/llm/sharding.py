"""Sharding of documents by balanced label propagation.

Documents with equal texts are linked. Every document starts in the shard that a hash of its id names. In each round a
join tells linked documents which shard most of their neighbours are in; they move there as far as the quota of that
shard allows, which exceeds its size by half while documents still move. At last shards give up what they hold too much,
whole groups before parts of them, and are filled up to their exact size with those and with documents that have no
links; the counts of any two shards then differ by at most one (the law ``rows``). A group larger than a shard is moved
in parts.

No step meets all rows of a shard or of a group in one task: groups are counted by partial aggregation, quotas are
dealt over buckets of groups, and ranks come from counts of hash buckets plus a rank within one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywork.llm.shared import cut, documents, text_of

QUERY = "op2_sharding"
ORACLE_SQL = None
#: Buckets over which the quota of a shard is dealt in a round.
QUOTA_BUCKETS = 2048
#: Rows that a bucket of the ranking holds on average.
RANK_ROWS = 20_000


def gapless_rank(rows: DataFrame, by: list[str], spread: list[str], order: list[str], n_rows: int, name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... within each value of ``by``, without gathering such a value in one task.

    Rows are dealt over buckets by a hash of ``spread``, so rows that agree in it get ranks near each other.
    """
    buckets = max(64, n_rows // RANK_ROWS)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(name), *spread), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_at", F.row_number().over(within) - 1).join(starts, [*by, "_bucket"])
    return ranked.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_bucket", "_start", "_at")


def _round(state: DataFrame, capacity: list[int], shards: int, seed: int) -> DataFrame:
    """One round of moves; ``state`` has linked rows only."""
    load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    free = [max(0, capacity[s] - load.get(s, 0)) for s in range(shards)]
    room = F.array(*(F.lit(x).cast("long") for x in free))
    votes = state.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    # The shard where most neighbours are; for a group that a shard can't hold, the fullest that still has room.
    wide = F.sum("n").over(Window.partitionBy("g1", "g2"))
    open_shard = F.get(room, F.col("shard")) > 0
    rank = F.struct((open_shard | (F.col("total") <= min(capacity, default=0))).cast("int"), F.col("n"), F.pmod(F.xxhash64(F.lit(seed), "g1", "shard"), F.lit(1009)))
    aims = votes.withColumn("total", wide).groupBy("g1", "g2").agg(F.max_by("shard", rank).alias("aim"))
    wanting = state.join(aims, ["g1", "g2"], "left").withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "unit"), F.lit(QUOTA_BUCKETS)).cast("int"))
    moves = (F.col("aim") != F.col("shard")) & ~((F.col("n_group") > min(capacity, default=0)) & (F.get(room, F.col("shard")) <= 0))
    asked = wanting.filter(moves).groupBy("aim", "_b").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("aim").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    granted = asked.withColumn("upto", upto).filter(F.col("upto") <= F.get(room, F.col("aim"))).select("aim", "_b", F.lit(True).alias("granted"))
    # granted has at most shards * QUOTA_BUCKETS rows.
    moved = wanting.join(F.broadcast(granted), ["aim", "_b"], "left")
    return moved.select("row", "doc_id", "size", "text_crc32", "g1", "g2", "n_group", "unit", F.when(F.col("granted") & moves, F.col("aim")).otherwise(F.col("shard")).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    Size is the bytes of the text plus 1, so null and empty texts (which are equal) have size 1. Null ids and repeated
    rows are rows like others. Other columns are not read. An empty table gives an empty result.
    """
    g1, g2 = F.xxhash64(text_of()), F.xxhash64(F.lit(97), text_of())
    base = cut(
        docs.select("doc_id", (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), g1.alias("g1"), g2.alias("g2")),
        "shard-base",
    )
    n = base.count()
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("n_group")).filter("n_group > 1")
    start = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(shards)).cast("int")
    # Parts of large groups move on their own.
    part = F.when(F.col("n_group") > max(1, n // shards // 16), F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(256))).otherwise(F.lit(0))
    told = cut(
        base.join(groups, ["g1", "g2"], "left")
        .withColumn("n_group", F.coalesce("n_group", F.lit(1)))
        .select(F.xxhash64("doc_id", "g1").alias("row"), "doc_id", "size", "text_crc32", "g1", "g2", "n_group", F.xxhash64("g1", "g2", part).alias("unit"), start.alias("shard")),
        "shard-told",
    )
    linked = told.filter("n_group > 1")
    quota_of_rounds = [c + c // 2 + 8 for c in capacity]
    for k in range(rounds):
        linked = cut(_round(linked, quota_of_rounds, shards, 11 + k), "shard-round")
    held = gapless_rank(linked, ["shard"], ["unit"], ["unit", "doc_id", "row"], n, "place")
    quota = F.array(*(F.lit(c).cast("long") for c in capacity))
    placed = cut(held.withColumn("fits", F.col("place") < F.get(quota, F.col("shard"))), "shard-placed")
    taken = {r["shard"]: r["n"] for r in placed.filter("fits").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    columns = ["row", "doc_id", "size", "text_crc32", "unit"]
    pool = placed.filter("not fits").select(*columns).union(told.filter("n_group = 1").select(*columns))
    pool = gapless_rank(pool.withColumn("all", F.lit(0)), ["all"], ["unit"], ["unit", "doc_id", "row"], n, "place")
    into, edge = F.lit(None).cast("int"), 0
    for s in range(shards):  # intervals of ranks, one for each shard
        edge += capacity[s] - taken.get(s, 0)
        into = F.coalesce(into, F.when(F.col("place") < edge, F.lit(s)))
    done = placed.filter("fits").select(*columns, "shard").union(pool.select(*columns, into.alias("shard")))
    out = gapless_rank(cut(done, "shard-done"), ["shard"], ["row"], ["doc_id", "row"], n, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
