"""Every registered monitoring query against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from pulsegrid.plans import oracles, queries

TABLES = ("events", "orders", "lineitem")


def text(x) -> str:  # noqa: ANN001
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    return f"{x:.6f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def test_every_query_has_sql() -> None:
    assert set(queries.QUERIES) == set(oracles.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name) -> None:  # noqa: ANN001
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(oracles.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_entry(spark) -> None:  # noqa: ANN001
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
