"""Queries on readings whose means lie on a limit, against the SQL with its sums of doubles replaced by exact ones.

The SQL itself adds doubles up in the order in which DuckDB's threads meet the rows, and calls some of these means lower.
"""

from __future__ import annotations

import random

import duckdb
import pytest

from pulsegrid.plans import oracles, queries
from tests.test_queries import rows

AFFECTED = (
    "alerts_by_arrival", "alerts_by_batches", "labs_effect", "latest_report", "patient_detail", "report_consolidated", "report_markdown", "report_order", "risk_counts",
)


def exact(sql: str) -> str:
    """Tenths added up as whole numbers and divided once."""
    for c in ("spo2", "temperature"):
        mean = f"avg({c}) as avg_{c}"
        assert mean in sql
        sql = sql.replace(mean, f"cast(sum(cast(round({c} * 10) as bigint)) as double) / (count({c}) * 10) as avg_{c}")
    return sql


def readings_of(rng: random.Random, limit: int) -> list[tuple[str, int]]:
    """Events of one person, as types and numbers k: oxygen of 80 + k / 10 for errors, else of 95 + k / 10, with the limit as mean.

    At 95 few enough are errors that the mean alone decides on the day's risk.
    """
    while True:
        if limit == 90:
            found = [("error", rng.randrange(50)) if rng.random() < 0.4 else ("click", rng.randrange(51)) for _ in range(rng.randint(3, 8))]
        else:
            found = [("error", rng.randrange(50)), *(("click", rng.randrange(30)) for _ in range(rng.randint(7, 12)))]
        rest = limit * 10 * (len(found) + 1) - sum((800 if kind == "error" else 950) + k for kind, k in found)
        if limit == 90 and 800 <= rest < 850:
            return [*found, ("error", rest - 800)]
        if 950 <= rest <= 1000:
            return [*found, ("click", rest - 950)]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, sf_dir) -> str:  # noqa: ANN001
    folder, rng = tmp_path_factory.mktemp("limits"), random.Random(7)
    people = [readings_of(rng, limit) for limit in (90, 95) for _ in range(60)]
    events = [(rng.random(), user, kind, k) for user, found in enumerate(people) for kind, k in found]
    con = duckdb.connect()
    con.sql("create table e (moment double, user_id bigint, event_type varchar, k integer)")
    con.executemany("insert into e values (?, ?, ?, ?)", events)
    # each person's readings in some eight hours of the month, so that they share their windows and their day
    con.sql(f"""copy (select row_number() over (order by moment) - 1 as event_id, make_timestamp({oracles.EPOCH} * 1000000 + user_id % 90 * 28800000000 + cast(moment * 28000000000 as bigint)) as ts, user_id, event_type,
                     1.0::double as value, '{{"k": ' || k || '}}' as props from e order by moment) to '{folder}/events.parquet'""")
    con.sql(f"copy (select * from '{sf_dir}/orders.parquet') to '{folder}/orders.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", AFFECTED)
def test_query(spark, tables, name) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"create view {t} as select * from '{tables}/{t}.parquet'")
    want = con.sql(exact(oracles.ORACLE_SQL[name])).df()
    got = queries.QUERIES[name](spark, tables).toPandas()
    assert len(got) and rows(got) == rows(want)
