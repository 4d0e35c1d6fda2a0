"""The driver contract, and a sample of queries against their SQL (all of them: tools/check_queries.py)."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from stepledger_queries import ORACLE, QUERIES
from tools.check_queries import rows_of

SAMPLE = [
    "a4_slice_aggregate",
    "a8_profile",
    "f6_closeness",
    "f13_statements",
    "j4_many_to_many",
    "j6_update",
    "j11_literals_in_steps",
    "l8_reads_writes",
    "l9_edges",
    "o4_mismatch_sample",
    "pl1_flow_running_interest",
    "r5_cell_diff",
    "s3_csv_scan",
    "u5_multiset_difference",
    "w3_by_flags",
    "w4_retain",
]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def test_every_query_has_its_check():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["region", "n_accounts", "total_balance", "total_interest"] and df.count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, db, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    cur = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())
