"""Queries beside their SQL where tables are larger than the given ones, and steps whose tasks must not grow with them."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def same_as_sql(spark, folder, name):
    """The rows of a query, after they were found to be those of its SQL."""
    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = entry.queries()[name](spark, str(folder))
    connection.register("found", found.toArrow())
    columns = ", ".join(found.columns)
    connection.execute(f"CREATE TABLE expected AS SELECT {columns} FROM ({entry.oracle_sql()[name]})")
    for one, two in (("expected", "found"), ("found", "expected")):
        assert connection.execute(f"SELECT {columns} FROM {one} EXCEPT ALL SELECT {columns} FROM {two} LIMIT 3").fetchall() == []
    return connection.execute("SELECT * FROM found").fetchall()


@pytest.fixture(scope="module")
def many_books(spark, tmp_path_factory):
    """2,500 books of five signatures: three shelves of seals."""
    folder = tmp_path_factory.mktemp("books")
    orders = spark.range(12_500).select((F.col("id") * 200).alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.expr("TIMESTAMP_NTZ'1995-01-01' + make_dt_interval(CAST(id % 900 AS INT))").alias("o_orderdate"))
    orders.write.parquet(f"{folder}/orders.parquet")
    return folder


def test_verification_of_more_books_than_a_shelf_holds(spark, many_books):
    assert same_as_sql(spark, many_books, "log_02")


def test_last_seal_of_more_books_than_a_shelf_holds(spark, many_books):
    assert [r[0] for r in same_as_sql(spark, many_books, "rm_10")] == [2500]


def test_numbers_of_a_district_beyond_five_digits(spark, tmp_path):
    from terravow.operators.relational import sequenced

    orders = spark.range(100_020).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.expr("TIMESTAMP_NTZ'1995-01-01'").alias("o_orderdate"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 7)], "c_custkey long, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    assert len(same_as_sql(spark, tmp_path, "win_08")) == 100_020
    assert sequenced(spark, str(tmp_path)).agg(F.count_distinct("nth"), F.max("nth")).first() == (100_020, 100_020)


def test_many_claims_of_one_place(spark):
    from terravow.operators.producer_queries import neighbours_within

    rows = spark.range(200_000).select(F.col("id").alias("claim_id"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))  # all pairs would be 4 * 10^10
    assert neighbours_within(rows, 500.0).groupBy("members").count().collect() == [(200_000, 200_000)]


def test_evidence_is_made_once_for_all_families(spark, small, capsys):
    from terravow.sources import adapter

    adapter.evidence(spark, small).explain()
    assert capsys.readouterr().out.count("lineitem.parquet") == 1


def test_images_of_one_hash_meet_as_one(spark, monkeypatch):
    from terravow.operators import relational

    keyed, keys = [], relational.hash_keys
    monkeypatch.setattr(relational, "hash_keys", lambda rows: keyed.append(rows.count()) or keys(rows))
    rows = spark.range(60).select(F.col("id").alias("image_id"), F.lit("d").alias("district_lgd"), F.when(F.col("id") < 50, 0).otherwise(1 << 40).cast("long").alias("phash"))
    found = {(r["a"], r["b"]): r["bits_apart"] for r in relational.similar_images(rows).collect()}
    assert found == {(a, b): int(a < 50 <= b) for a in range(60) for b in range(a + 1, 60)} and keyed == [2]


def test_files_of_a_stream_grow_in_number(spark):
    from terravow.functions import storage
    from terravow.streaming.queries import as_stream, run_batches

    size, batches = "spark.sql.adaptive.advisoryPartitionSizeInBytes", []
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(size, "1MB")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        stream = as_stream(spark.range(400_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text")))
        assert len(spark.read.parquet(storage._made[-1]).inputFiles()) > 8
        run_batches(stream, lambda df, n: batches.append(df.count()))
    finally:
        spark.conf.unset(size)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert sum(batches) == 400_000 and 2 <= len(batches) <= 4


@pytest.mark.parametrize("name", ["eng_01", "eng_08", "eng_13", "eng_15", "log_05", "log_07", "rm_02"])
def test_code_of_the_engine_is_compiled(spark, small, name):
    """The JVM never compiles a method of more than 8,000 bytes of code; it then takes several times as long for a row."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = entry.queries()[name](spark, small)._jdf.queryExecution().debug().codegenToSeq()
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bundles_are_dealt_by_claim_alone(spark, small, capsys):
    from terravow.sources import adapter

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        adapter.verdict_inputs(spark, small).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert plan.index("SortMergeJoin [claim_id") < plan.index("SortMergeJoin [intervention_id")


def test_recomputed_verdicts_read_the_lines_once(spark, small, capsys):
    entry.queries()["log_07"](spark, small).explain()
    assert capsys.readouterr().out.count("lineitem.parquet") == 1


def test_replays_of_ids_of_any_sign(spark, tmp_path):
    rows = [(u, i) for u in (1, 2, 3) for i in range(-300 * u, 300, u)] + [(1, None), (1, None), (None, 5), (4, None)]
    spark.createDataFrame(rows, "user_id long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    assert len(same_as_sql(spark, tmp_path, "stm_06")) == 5
