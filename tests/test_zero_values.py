"""Queries whose quotients meet zeros, against their SQL twins: events of which every sixth has the value 0."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from oracle_check import compare

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    if not Path(SOURCE).exists():
        pytest.skip("no test data")
    folder = tmp_path_factory.mktemp("zeros")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE value END AS value) FROM '{SOURCE}')
                    TO '{folder}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["covariate_ratios", "event_covariates", "theme_regression", "significance_summary", "significance_totals"])
def test_division_by_zero(spark, zeros, name):
    con, folder = zeros
    good, note = compare(spark, con, folder, name)
    assert good, note
