"""As test_means_on_limits.py, for the other queries that show a mean or what follows from it."""

from __future__ import annotations

import duckdb
import pytest

from pulsegrid.plans import oracles, queries
from tests.test_means_on_limits import exact, tables  # noqa: F401
from tests.test_queries import rows


@pytest.mark.parametrize("name", ["alert_episodes", "alert_list", "report_rows", "ward_patients", "window_alerts"])
def test_query(spark, tables, name) -> None:  # noqa: ANN001, F811
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = con.sql(exact(oracles.ORACLE_SQL[name])).df()
    got = queries.QUERIES[name](spark, tables).toPandas()
    assert len(got) and rows(got) == rows(want)
