"""Sources and sinks: what is written to the shared folder and read back; generators; statements on stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywork.operators.table import Constraints, ConstraintError, Table
from tallywork.plans.catalogue import register, table
from tallywork.sources import io


@register("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = io.shared_path(spark, "csv")
    io.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return io.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@register("csv_repeated_header", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS name_2 FROM nation")
def csv_repeated_header(spark, d):
    """A byte order mark and a header that names two columns alike; names come from the caller."""
    path = io.shared_path(spark, "csv")
    # A dimension table of few rows makes one file.
    lines = table(spark, d, "nation").agg(F.array_join(F.collect_list(F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")), "\n").alias("lines"))
    lines.select(F.concat(F.lit("\ufeffid,name,name\n"), "lines")).write.text(path)
    return io.read_csv(spark, path, "id long, name string, name2 long", names=["id", "name", "name_2"])


@register("line_fields", "SELECT n_name AS name, n_nationkey AS weight, CAST(NULL AS INT) AS height FROM nation WHERE n_regionkey <> 0")
def line_fields(spark, d):
    """Lines of fields, appended in two writes; lines with an empty field are skipped, unreadable numbers are null."""
    path = io.shared_path(spark, "lines")
    rows = table(spark, d, "nation").withColumn("line", F.concat_ws(", ", "n_name", F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("n_nationkey").cast("string")), F.lit("tall")))
    io.append_lines(rows.filter("n_nationkey % 2 = 0"), "line", path)
    io.append_lines(rows.filter("n_nationkey % 2 = 1"), "line", path)
    return io.read_lines(spark, path, ["name", "weight", "height"], types=["string", "int", "int"])


@register("whole_files", "SELECT r_regionkey, length(r_name) + 3 AS n_chars, true AS listed FROM region")
def whole_files(spark, d):
    path = io.shared_path(spark, "files")
    table(spark, d, "region").select("r_regionkey", F.concat(F.col("r_name"), F.lit("\nx")).alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    key = lambda c: F.regexp_extract(c, r"r_regionkey=(\d+)", 1).cast("long")
    contents = io.read_whole(spark, path).select(key("path").alias("r_regionkey"), F.length("content").cast("long").alias("n_chars"))
    listed = io.list_files(spark, path).select(key("path").alias("r_regionkey"), (F.col("length") > 0).alias("listed"))
    return contents.join(listed, "r_regionkey")


@register("titled_paragraphs", "SELECT c_name AS title, 'segment: ' || c_mktsegment || chr(10) || 'key: ' || c_custkey AS body FROM customer")
def titled_paragraphs(spark, d):
    """Records as paragraphs between blank lines, written to files and read back as titles and bodies."""
    path = io.shared_path(spark, "paragraphs")
    record = F.format_string("%s\nsegment: %s\nkey: %d", "c_name", "c_mktsegment", "c_custkey")
    table(spark, d, "customer").select(record.alias("value")).write.option("lineSep", "\n\n").text(path)
    return io.titled(io.read_paragraphs(spark, path))


@register("integer_ranges", "SELECT 'down' AS kind, range AS n FROM range(10, 0, -3) UNION ALL SELECT 'step', range FROM range(2, 9, 3) UNION ALL SELECT 'plain', range FROM range(4)")
def integer_ranges(spark, d):
    kinds = {"down": io.integers(spark, 10, 0, -3), "step": io.integers(spark, 2, 9, 3), "plain": io.integers(spark, 4)}
    parts = [rows.select(F.lit(kind).alias("kind"), "n") for kind, rows in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@register("random_people_bounds", "SELECT 50 AS n, true AS names, true AS weights, true AS heights")
def random_people_bounds(spark, d):
    p = io.random_people(spark)
    return p.agg(F.count("*").cast("int").alias("n"), F.bool_and(F.length("name") == 2).alias("names"), F.bool_and(F.col("weight").between(40, 100)).alias("weights"), F.bool_and(F.col("height").between(140, 200)).alias("heights"))


@register("preview_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def preview_head(spark, d):
    return io.preview(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")


@register("tab_report", "SELECT c_custkey || chr(9) || c_name || chr(9) || c_mktsegment AS line FROM customer")
def tab_report(spark, d):
    return table(spark, d, "customer").select(io.tab_rows("c_custkey", "c_name", "c_mktsegment").alias("line"))


@register("record_lines", "SELECT c_custkey, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'key: ' || c_custkey AS record FROM customer")
def record_lines(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.format_string("name: %s\nsegment: %s\nkey: %d", "c_name", "c_mktsegment", "c_custkey").alias("record"))


@register("table_create_insert", "SELECT * FROM (VALUES (1, 'Ada', 170.3), (2, 'Ben', NULL)) t(id, name, height)")
def table_create_insert(spark, d):
    t = Table.create(spark, "person", "id int, name string, height double", Constraints(not_null=("name",), primary_key="id"))
    return t.insert([(1, "Ada", 170.3), (2, "Ben", None)]).commit().rows


@register("table_reopen", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 3 UNION ALL SELECT max(n_nationkey) + 1, 'new' FROM nation")
def table_reopen(spark, d):
    """A second writer opens what the first has committed, keeps counting keys and sees nothing that was only staged."""
    path = io.shared_path(spark, "table")
    key = Constraints(primary_key="n_nationkey", autoincrement=True)
    first = Table.of("nation", table(spark, d, "nation").select("n_nationkey", "n_name"), key, path)
    first.delete(F.col("n_nationkey") <= 3).commit()
    first.delete()
    return Table.open(spark, "nation", path, key).insert([("new",)], ["n_name"]).commit().rows


@register("truncate_then_insert", "SELECT 7 AS r_regionkey, 'only' AS r_name")
def truncate_then_insert(spark, d):
    t = Table.of("region", table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name"))
    return t.truncate().insert([(7, "only")]).commit().rows


@register("delete_all_keeps_schema", "SELECT 0 AS n_rows, 2 AS n_columns")
def delete_all_keeps_schema(spark, d):
    t = Table.of("region", table(spark, d, "region").select("r_regionkey", "r_name")).delete().commit()
    return t.rows.agg(F.count("*").cast("int").alias("n_rows"), F.lit(len(t.rows.columns)).alias("n_columns"))


@register("update_all", "SELECT n_nationkey, 'same' AS n_name FROM nation")
def update_all(spark, d):
    return Table.of("nation", table(spark, d, "nation").select("n_nationkey", "n_name")).update({"n_name": F.lit("same")}).commit().rows


@register("constraint_errors", "SELECT * FROM (VALUES ('null', true), ('repeated', true), ('good', false)) t(statement, refused)")
def constraint_errors(spark, d):
    """Versions that break a constraint are refused and leave the table as it was."""
    refused = []
    for name, values in (("null", (9, None)), ("repeated", (1, "again")), ("good", (9, "fine"))):
        t = Table.of("region", table(spark, d, "region").select("r_regionkey", "r_name"), Constraints(not_null=("r_name",), primary_key="r_regionkey")).insert([values])
        try:
            t.commit()
            refused.append((name, False))
        except ConstraintError:
            refused.append((name, True))
    return spark.createDataFrame(refused, "statement string, refused boolean")


@register("schemas_tables_views", "SELECT * FROM (VALUES ('schema', true, false), ('table', true, false), ('view', true, false)) t(kind, made, left_over)")
def schemas_tables_views(spark, d):
    """A schema, a stored table and a view over it, each made, looked up and dropped."""
    mark = uuid.uuid4().hex
    schema, view = f"tallywork_{mark}", f"tallywork_names_{mark}"
    known = {"schema": lambda: spark.catalog.databaseExists(schema), "table": lambda: spark.catalog.tableExists(f"{schema}.nations"), "view": lambda: spark.catalog.tableExists(view)}
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{io.shared_path(spark, 'schema')}'")
    try:
        table(spark, d, "nation").select("n_nationkey", "n_name").write.saveAsTable(f"{schema}.nations")
        spark.sql(f"CREATE TEMPORARY VIEW {view} AS SELECT n_name FROM {schema}.nations")
        made = {kind: look() for kind, look in known.items()}
    finally:
        spark.catalog.dropTempView(view)
        spark.sql(f"DROP SCHEMA {schema} CASCADE")
    return spark.createDataFrame([(kind, made[kind], look()) for kind, look in known.items()], "kind string, made boolean, left_over boolean")
