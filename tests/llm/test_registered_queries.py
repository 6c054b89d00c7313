"""Every registered query of the subpackage over whole tables: columns, a row for each document, and SQL where there is any."""

import os

import duckdb
import pytest

from tallywork.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
CONTRACT = {
    1: "doc_id n_bytes n_removed n_spans kept_sha256", 2: "doc_id size text_crc32 law shard slot grown_shard", 3: "doc_id", 4: "query_id rank vec_id score", 5: "doc_id",
    6: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 7: "doc_id n_bytes n_tokens over_limit", 8: "doc_id n_shingles component_id", 9: "doc_id held_out score predicted",
    10: "doc_id n_lines n_dropped kept_sha256", 11: "doc_id held_out score predicted", 12: "doc_id n_features weight score rank",
    13: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def number(name):
    return int(name[2:].split("_")[0])


def test_there_is_a_query_for_each_operator():
    assert sorted(map(number, QUERIES)) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES, key=number))
def test_query(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    wanted = CONTRACT[number(name)].split()
    assert got.columns[: len(wanted)] == wanted
    rows = got.collect()
    if number(name) not in (4, 5):
        ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
        assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    if name in SQL:
        con = duckdb.connect()
        for table in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{table}'")
        found = con.execute(SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())
