"""A cross-section of the registered queries against their SQL on the smallest tables."""

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = (
    "flt_02 flt_08 prj_01 joi_05 joi_10 joi_19 agg_01 agg_02 agg_04 agg_18 agg_22 agg_25 win_03 win_07 srt_01 srt_09 set_05 "
    "str_03 str_07 str_08 dte_04 dte_05 mth_04 mth_16 bit_03 hsh_02 arr_06 jsn_03 eng_02 eng_06 eng_10 eng_12 prd_01 prd_02 prd_05 prd_08 prd_11 prd_14 prd_17 prd_19 "
    "log_01 log_02 log_11 log_12 aut_02 ing_01 ing_05 val_01 rm_02 rm_10 rpt_01 src_11 snk_03 snk_04 stm_03 stm_06"
).split()


@pytest.fixture(scope="module")
def other(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, small, other, name):
    found = entry.queries()[name](spark, small)
    other.register("found", found.toArrow())
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    other.execute(f"CREATE OR REPLACE TABLE expected AS SELECT {columns} FROM ({entry.oracle_sql()[name]})")
    other.execute(f"CREATE OR REPLACE TABLE actual AS SELECT {columns} FROM found")
    for one, two in (("expected", "actual"), ("actual", "expected")):
        assert other.execute(f"SELECT * FROM {one} EXCEPT ALL SELECT * FROM {two} LIMIT 3").fetchall() == []


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "claim_id"
