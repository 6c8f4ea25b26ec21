"""A few registered queries against their SQL twins, and the contract of the entry module."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def normal(rows, order):
    return sorted(tuple(round(float(r[i]), 3) if isinstance(r[i], float) else str(r[i]).removesuffix(" 00:00:00") for i in order) for r in rows)


@pytest.mark.parametrize("name", ["new_registrations", "row_outcomes_snapshot", "stock_exact_month", "asof_by_key", "policy_table", "panel", "bass_project_covariate_last", "holdout_metrics", "stream_first_seen", "read_registrations", "read_income_bins", "read_price_series", "sink_table", "sink_run_summary", "bass_fit_covariate", "bass_fit_two_rounds"])
def test_equals_sql(spark, con, name):
    got = __spark_entry__.queries()[name](spark, SF)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    rows = found.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert normal(got.select(*columns).collect(), range(len(columns))) == normal(rows, range(len(columns)))


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns == ["region", "snapshot_id", "new_all", "new_ev", "ev_share_pct"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
