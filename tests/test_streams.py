"""Streams write to the shared folder, and nothing of them meets on the driver."""

import __spark_entry__
import pytest

from tests.test_queries import SF


@pytest.mark.parametrize("name, table, keys", [("stream_first_seen", "lineitem", ["l_suppkey", "l_partkey"])])
def test_results_are_files(spark, name, table, keys):
    before = {t.name for t in spark.catalog.listTables()}
    got = __spark_entry__.queries()[name](spark, SF)
    assert got.inputFiles()
    assert {t.name for t in spark.catalog.listTables()} == before
    assert got.count() == spark.read.parquet(f"{SF}/{table}.parquet").selectExpr(*keys).distinct().count()
