"""The driver contract on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_entry_and_a_few_queries(spark):
    out = entry.entry(spark)
    assert {"l_suppkey", "partition_id", "method", "rmse"} <= set(out.columns)
    assert out.where("rmse IS NULL").count() == 0 and out.count() == 27 * 6
    duckdb = pytest.importorskip("duckdb")
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(entry.__file__), "tools"))
    from check_queries import compare, open_tables

    connection = open_tables(SMALL)
    assert isinstance(connection, duckdb.DuckDBPyConnection)
    for name in ("partitions_full", "impute_median", "rank_difference", "ridge_grid", "option_chains"):
        assert compare(entry.queries()[name](spark, SMALL), connection, entry.oracle_sql()[name]) == "", name
