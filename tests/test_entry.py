import duckdb
import pytest

import __spark_entry__ as entry
import datasonde_queries
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = set(datasonde_queries.QUERIES) - set(datasonde_queries.ORACLES)
    assert rows_only == {"approx_n_unique", "approx_quantiles"}


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", ["filter_tree", "plan_group", "col_outlier_count", "top_pearson", "dq_all", "inv_group_compare"])
def test_queries_match_sql_on_the_smallest_tables(spark, key):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[key](spark, SF)
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(names, cur.fetchall())
