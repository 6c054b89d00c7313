"""The pipeline against plain versions of its stages, and stages on odd tables."""

import duckdb
import pytest

import corpus_pipeline as P
from tallywork.llm import decontaminate, line_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").lower().split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    filler = lambda k, n=30: " ".join(f"w{(k * 37 + j * j * 11) % 997}x" for j in range(n))
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew potions in the dark tower"
    docs = [(k, filler(k), "en", "s", 0) for k in range(40)]
    docs += [(50, filler(50) + " idiot worthless scum moron loser", "en", "s", 0), (51, filler(51) + " " + item, "en", "s", 0), (52, filler(3).upper(), "en", "s", 0), (53, filler(4, 30) + " tail", "en", "s", 0)]
    docs += [(60 + k, filler(60 + k) + " you idiot scum", "en", "s", 0) for k in range(12)]
    docs += [(54, filler(54) + "\n" + "a shared line of text", "en", "s", 0), (55, filler(55) + "\n" + "A shared line of text ", "en", "s", 0), (56, None, None, None, None), (57, "", "", "", 0), (None, filler(3), "en", "s", 0)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k >= 60)) for k in (*range(40), *range(60, 72))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run(spark, tables):
    got = P.run(spark, tables).collect()
    ids = sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    # 52 repeats the only line of 3 and is left without text; 53 is a near copy of 4.
    assert ids == [k for k in range(40)] + [52, 54, 55, 56, 57] and sum(r["doc_id"] is None for r in got) == 1
    assert all(r["round_trip"] for r in got)


def test_stages_return_the_columns_of_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == P.COLUMNS
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert P.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0


def test_line_stage_and_decontamination_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for module in (line_dedup, decontaminate):
        want = con.execute(module.ORACLE_SQL)
        names = [c[0] for c in want.description]
        got = module.query(spark, sf_dir).select(*names).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_decontamination_of_long_runs_of_names(spark, tables):
    rows = [(1, "see " + "Bob " * 40_000, "en", "s", 0), (2, "see " + "Bob " * 40_000 + ". " + spark.read.parquet(f"{tables}/benchmark.parquet").first()["text"], "en", "s", 0)]
    assert [r["doc_id"] for r in P.drop_contaminated(spark, spark.createDataFrame(rows, COLUMNS), tables).collect()] == [1]
