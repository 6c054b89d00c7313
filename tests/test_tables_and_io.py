"""Snapshot tables, readers, text operators, scalar corner cases and a stream."""

import pytest
from pyspark.sql import functions as F

from tallywork.functions import scalar as S
from tallywork.operators import clean, text as X
from tallywork.operators.table import ConstraintError, Constraints, SchemaError, Table
from tallywork.sources import io
from tallywork.streaming import windows as W

PEOPLE = [("Ann", "1994-06-09", None, 50.0), ("Bo", "1986-05-21", 167.0, None), ("Cy", "1992-11-06", 170.3, 54.0), ("Di", None, 164.0, 46.0)]


@pytest.fixture
def person(spark, tmp_path):
    rule = Constraints(not_null=("Name",), primary_key="ID", autoincrement=True)
    t = Table.create(spark, "Person", "ID bigint, Name string, Birthday string, Height double, Weight double", rule, str(tmp_path / "person"))
    return t.insert(PEOPLE, ["Name", "Birthday", "Height", "Weight"]).commit()


def test_insert_numbers_rows_in_order_and_never_again(person):
    assert [(r["ID"], r["Name"]) for r in person.rows.orderBy("ID").collect()] == [(1, "Ann"), (2, "Bo"), (3, "Cy"), (4, "Di")]
    person.delete(F.col("ID") == 4).commit()
    person.insert([("Ed",)], ["Name"]).commit()
    assert {r["ID"] for r in person.rows.collect()} == {1, 2, 3, 5}


def test_nulls_stay_on_delete_and_update(person):
    person.delete(F.col("Height") > 165).commit()
    assert {r["Name"] for r in person.rows.collect()} == {"Ann", "Di"}
    person.update({"Weight": F.col("Weight") + 1, "Height": F.col("Weight")}, F.col("Birthday").isNull()).commit()
    assert {(r["Name"], r["Height"], r["Weight"]) for r in person.rows.collect()} == {("Ann", None, 50.0), ("Di", 46.0, 47.0)}


def test_constraints_and_revert(person):
    with pytest.raises(ConstraintError):
        person.update({"Name": F.lit(None)}).commit()
    person.revert()
    with pytest.raises(ConstraintError):
        person.insert([(1, "Zoe", None, None, None)]).commit()
    assert person.revert().rows.count() == 4
    with pytest.raises(SchemaError):
        person.drop_column("none")
    person.add_column("New", "int").rename_column("New", "Size").commit()
    assert person.rows.columns[-1] == "Size" and person.rows.filter("Size is not null").isEmpty()


def test_bmi(person):
    got = {r["Name"]: r["b"] for r in person.rows.select("Name", F.round(S.bmi(F.col("Weight"), F.col("Height")), 1).alias("b")).collect()}
    assert got == {"Ann": None, "Bo": None, "Cy": 18.6, "Di": 17.1}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿나이,x,나이\n3,y,4\n", encoding="utf-8")
    assert io.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string, c int", ["age", "x", "age2"]).collect() == [(3, "y", 4)]
    (tmp_path / "info.txt").write_text("가나, 60, 170\n, 50, 160\n다라, x, 150\n", encoding="utf-8")
    rows = io.read_lines(spark, str(tmp_path / "info.txt"), ["name", "weight", "height"], types=["string", "int", "int"]).collect()
    assert rows == [("가나", 60, 170), ("다라", None, 150)]
    (tmp_path / "p.txt").write_text("One\nbody one\n\nTwo\nbody two\n", encoding="utf-8")
    assert {tuple(r) for r in io.titled(io.read_paragraphs(spark, str(tmp_path / "p.txt"))).collect()} == {("One", "body one"), ("Two", "body two")}
    assert io.read_whole(spark, str(tmp_path / "p.txt")).count() == 1
    assert [r["n"] for r in io.integers(spark, 10, 4, -2).collect()] == [10, 8, 6]
    people = io.random_people(spark)
    assert people.count() == 50 and people.filter("weight not between 40 and 100 or height not between 140 and 200 or length(name) <> 2").isEmpty()


def test_recodes(spark):
    df = spark.createDataFrame([(1, "a"), (99, "b"), (None, "c")], "g int, k string")
    out = df.select(clean.recode(F.col("g"), {1: "one"}).alias("r"), clean.rename_categories(F.col("k"), {"a": "A"}).alias("n"), clean.missing_to_null(F.col("g"), [99]).alias("m")).collect()
    assert out == [("one", "A", 1), (None, "b", None), (None, "c", None)]
    assert clean.keep_valid(df, refused={"g": [99]}).count() == 2
    assert [r["n"] for r in spark.createDataFrame([("만 20세",), ("none",)], "t string").select(clean.leading_number(F.col("t")).alias("n")).collect()] == [20, None]


def test_splitter():
    text = "one two three\n\n" + "four " * 60 + "\n\nfive"
    parts = X.split_recursively(text, 100, 20)
    assert max(map(len, parts)) <= 100 and parts[0] == "one two three" and parts[-1].endswith("five")
    assert X.split_recursively("", 10, 2) == []
    assert X.split_recursively("abcdefghij", 4, 1, ("",)) == ["abcd", "defg", "ghij"]


def test_scalar_corner_cases(spark):
    one = spark.range(1)
    got = one.select(
        S.floor_mod(F.lit(-7), F.lit(3)).alias("m"), S.floor_div(F.lit(-7), F.lit(2)).alias("q"), S.sign_then_pad(F.lit(-52), 5).alias("p"), S.remove_first(F.array(*map(F.lit, (1, 2, 1))), F.lit(1)).alias("r"), S.fibonacci(F.lit(35)).alias("f"),
        S.scale_class(F.lit("34567812")).alias("up"), S.scale_class(F.lit("87654321")).alias("down"), S.scale_class(F.lit("345678")).alias("short"), S.deep_flatten(F.lit("[1,[2,[3,[4]]]]")).alias("flat"), S.room_number(F.lit(6), F.lit(12)).alias("room"),
    ).first()
    assert tuple(got) == (2, -4, "-  52", [2, 1], 9227465, "ascending", "descending", "mixed", ["1", "2", "3", "4"], "602")
    assert S.partitions_of(100) == 437420


def test_stream_counts_like_the_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = W.windowed_counts(W.event_stream(spark, str(tmp_path / "in")), "1 hour", None, "400 days")
    W.run_available(stream, "hours", str(tmp_path / "check"), "complete")
    batch = W.windowed_counts(W.with_event_time(events), "1 hour")
    assert {(r["window_start"], r["n"]) for r in spark.table("hours").collect()} == {(r["window_start"], r["n"]) for r in batch.collect()}


def test_late_rows_are_dropped_and_closed_windows_are_emitted_once(spark, tmp_path):
    batches = [["2024-01-01 00:05:00", "2024-01-01 00:50:00"], ["2024-01-01 03:00:00"], ["2024-01-01 00:10:00", "2024-01-01 02:55:00"], ["2024-01-01 09:00:00"], ["2024-01-01 09:30:00"]]
    source, sink, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    for times in batches:  # one run for each arrival, so the order of files is that of arrival
        spark.createDataFrame([(t, 1.0) for t in times], "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        counts = W.windowed_counts(W.event_stream(spark, source), "1 hour")
        counts.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    seen = [(r["window_start"].hour, r["n"]) for r in spark.read.parquet(sink).collect()]
    # The row of 00:10 comes behind the watermark of 02:50 and is lost, that of 02:55 is in time.
    assert sorted(seen) == [(0, 2), (2, 1), (3, 1)]


def test_term_vectors_against_plain_counts(spark):
    from tallywork.operators.text import term_slot, term_vectors

    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "k long, text string")
    got = {r["k"]: r["vector"] for r in term_vectors(df, "k").collect()}
    slot = {r["w"]: r["s"] for r in spark.createDataFrame([("a",), ("b",)], "w string").select("w", term_slot(F.col("w"), 64).alias("s")).collect()}
    want = {1: [0.0] * 64, 2: [0.0] * 64}
    for k, w, n in ((1, "a", 2), (1, "b", 1), (2, "b", 1)):
        want[k][slot[w]] += n
    for k, v in want.items():
        norm = sum(x * x for x in v) ** 0.5
        assert got[k] == pytest.approx([x / norm for x in v])


def test_a_table_needs_its_pointer(spark, tmp_path):
    key = Constraints(primary_key="k", autoincrement=True)
    t = Table.create(spark, "t", "k long, v string", key, str(tmp_path / "t")).insert([("a",)], ["v"]).commit()
    t.insert([("b",)], ["v"]).commit()
    t.delete()
    again = Table.open(spark, "t", str(tmp_path / "t"), key)
    assert sorted((r["k"], r["v"]) for r in again.rows.collect()) == [(1, "a"), (2, "b")] and again.version == 2
    assert {r["k"] for r in again.insert([("c",)], ["v"]).commit().rows.collect()} == {1, 2, 3}


def test_a_statement_on_one_key_leaves_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.concat(F.lit("n"), "id").alias("name"))
    key = Constraints(primary_key="k")
    t = Table.of("t", rows.repartition(1), key, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t.commit()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = {f.name: f for f in t.committed.files}
    assert len(before) == 4 and sum(f.rows for f in before.values()) == 4000
    assert sorted((f.low["k"], f.high["k"]) for f in before.values())[0][0] == 0
    t.update({"name": F.lit("changed")}, within={"k": (17, 17)}).commit()
    after = {f.name for f in t.committed.files}
    assert len(before.keys() & after) == 3 and len(after) == 4
    # A condition without bounds finds the touched file by a scan.
    t.delete(F.col("name") == "n3999").commit()
    assert len({f.name for f in t.committed.files} & after) == 3
    again = Table.open(spark, "t", path, key)
    assert again.version == 3 and again.rows.count() == 3999 and again.rows.filter("name = 'changed'").first()["k"] == 17
    assert Table.open(spark, "t", path, key, version=1).rows.filter("name = 'changed'").count() == 0
    # No row matches: nothing is written.
    t.update({"v": F.lit(1)}, within={"k": (9000, 9999)}).commit()
    assert {f.name for f in t.committed.files} == {f.name for f in again.committed.files}


def test_columns_of_stored_tables_change_without_new_files(spark, tmp_path):
    path = str(tmp_path / "t")
    t = Table.of("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path=path).commit()
    files = t.committed.files
    t.rename_column("v", "w").add_column("v", "string").drop_column("k").add_column("k", "double").commit()
    assert t.committed.files == files
    again = Table.open(spark, "t", path)
    assert sorted((r["w"], r["v"], r["k"]) for r in again.rows.collect()) == [("a", None, None), ("b", None, None)]
    again.insert([("c", "x", 1.5)], ["w", "v", "k"]).commit()
    assert sorted((r["w"], r["v"], r["k"]) for r in Table.open(spark, "t", path).rows.collect()) == [("a", None, None), ("b", None, None), ("c", "x", 1.5)]


def test_two_racing_writers_lose_nothing(spark, tmp_path):
    from threading import Barrier, Thread

    path = str(tmp_path / "t")
    key = Constraints(primary_key="k", autoincrement=True)
    Table.create(spark, "t", "k long, v string", key, path).insert([("first",)], ["v"]).commit()
    start, failed = Barrier(4), []

    def write(who: int) -> None:
        try:
            t = Table.open(spark, "t", path, key)
            start.wait()
            for n in range(2):
                t.insert([(f"{who}-{n}",)], ["v"]).update({"v": F.concat("v", F.lit("!"))}, F.col("v") == f"{who}-{n}").commit(retries=20)
        except BaseException as error:  # noqa: BLE001
            failed.append(error)

    writers = [Thread(target=write, args=(k,)) for k in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert failed == []
    last = Table.open(spark, "t", path, key)
    got = last.rows.collect()
    assert sorted(r["v"] for r in got) == sorted(["first"] + [f"{k}-{n}!" for k in range(4) for n in range(2)])
    assert sorted(r["k"] for r in got) == list(range(1, 10)) and last.version == 9


def test_a_second_writer_is_told_and_may_repeat(spark, tmp_path):
    from tallywork.operators import table_log
    from tallywork.operators.table import ConflictError

    path = str(tmp_path / "t")
    key = Constraints(primary_key="k")
    Table.create(spark, "t", "k long, v string", key, path).insert([(1, "a")]).commit()
    one, two, three = (Table.open(spark, "t", path, key) for _ in range(3))
    one.insert([(2, "b")]).commit()
    with pytest.raises(ConflictError):
        two.insert([(3, "c")]).commit(retries=0)
    with pytest.raises(ConstraintError):  # the repeat sees the first one's key
        three.insert([(2, "again")]).commit()
    assert two.revert().version == 1 and Table.open(spark, "t", path, key).rows.count() == 2
    Table.open(spark, "t", path, key).delete(F.col("k") == 1).commit()
    assert table_log.vacuum(spark, path) == 2 and table_log.versions(spark, path) == [3]
    assert [tuple(r) for r in Table.open(spark, "t", path, key).rows.collect()] == [(2, "b")]
    assert not table_log.create_once(spark, table_log.note_path(path, 3), "x")
    with pytest.raises(FileNotFoundError):
        Table.open(spark, "none", str(tmp_path / "none"))


def test_places_over_several_ranges(spark):
    from tallywork.operators.order import numbered

    rows = [(k, k * 7919 % 1000 // 3, None if k % 50 == 0 else f"n{k % 13}") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, a long, b string").repartition(5)
    got = [r["id"] for r in numbered(df, F.desc("a"), F.asc_nulls_last("b"), F.asc("id"), name="at", first=0).orderBy("at").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[0]))]
    assert sorted(r["place"] for r in numbered(df, "a").collect()) == list(range(1, 1001)) and numbered(df.limit(0), "a").count() == 0
