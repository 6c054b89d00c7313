"""Sessions and sliding windows as streams whose rows come late, out of order and between sessions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallywork.streaming import windows as W

SCHEMA = "user_id string, ts timestamp_ntz, value double"
DAY = datetime(2024, 1, 1)


def arrive(spark, folder, rows):
    spark.createDataFrame([(u, DAY + timedelta(minutes=m), 1.0) for u, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def feed(spark, tmp_path, batches, counts):
    """One run for each arrival, each going on with the state of the last."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        arrive(spark, source, rows)
        got = W.stream_to_files(counts(W.event_stream(spark, source)), out)
    return got


def in_time(batches, late, ends):
    """(row, end) of the rows' windows that are still open when a row comes, by the watermark of the batches before."""
    kept, mark = [], -1
    for rows in batches:
        kept += [(r, end) for r in rows for end in ends(r[1]) if end > mark]
        mark = max([mark] + [m - late for _, m in rows])
    return kept


def test_sessions_merge_across_batches_and_are_given_out_once(spark, tmp_path):
    # 0 and 50 are two sessions until 25 joins them; 300 closes them; 10 and 200 come behind the watermark.
    batches = [[("a", 0), ("a", 50), ("b", 5)], [("a", 25), ("b", 70)], [("c", 300)], [("a", 10), ("b", 200), ("c", 310)], [("d", 900)], [("d", 901)]]
    got = feed(spark, tmp_path, batches, lambda e: W.session_counts(e, late="60 minutes"))
    seen = sorted((r["user_id"], (r["session_start"] - DAY).seconds // 60, (r["session_end"] - DAY).seconds // 60, r["n"]) for r in got.collect())
    assert seen == [("a", 0, 80, 3), ("b", 5, 35, 1), ("b", 70, 100, 1), ("c", 300, 340, 2)]


def test_streams_equal_batches_of_the_rows_in_time(spark, tmp_path):
    pick = random.Random(12)
    now, batches = 0, []
    mark = -100
    for _ in range(5):
        now += 120
        rows = [(pick.choice("abc"), max(0, now + pick.randint(-260, 40))) for _ in range(25)]
        # A row just behind the watermark may touch a session that was given out already: there a batch joins the two.
        batches.append([r for r in rows if not mark - 30 < r[1] <= mark])
        mark = max([mark] + [m - 60 for _, m in batches[-1]])
    batches.append([("z", 5000)])
    batches.append([("z", 5001)])
    rows = [r for r, _ in in_time(batches, 60, lambda m: [m + 30])]
    assert 60 < len(rows) < sum(map(len, batches))
    batch = W.with_event_time(spark.createDataFrame([(u, DAY + timedelta(minutes=m), 1.0) for u, m in rows], SCHEMA))
    sessions = feed(spark, tmp_path / "s", batches, lambda e: W.session_counts(e, late="60 minutes"))
    want = W.closed(W.session_counts(batch), batch, F.col("session_end"), "60 minutes")
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, want.collect())) and want.count() > 5
    sliding = feed(spark, tmp_path / "w", batches, lambda e: W.windowed_counts(e, "2 hours", "1 hour", "60 minutes", "user_id"))
    counts: dict = {}
    for (user, _), end in in_time(batches, 60, lambda m: [m // 60 * 60 + 60, m // 60 * 60 + 120]):
        counts[end - 120, user] = counts.get((end - 120, user), 0) + 1
    want = sorted((start, user, n) for (start, user), n in counts.items() if start + 120 <= 5001 - 60)
    assert sorted((int((r["window_start"] - DAY).total_seconds()) // 60, r["user_id"], r["n"]) for r in sliding.collect()) == want and len(want) > 10
