"""Means that lie on a limit, in every order of their rows, through the registered queries."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from itertools import permutations
from operator import add
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import queries

AT = datetime(2024, 1, 5, 12)


def oxygen(kind: str, k: int) -> float:
    return 80 + k % 101 / 10 if kind == "error" else 95 + k % 51 / 10


def on_limit(total: float) -> tuple[tuple[str, int], ...]:
    """Readings whose oxygen adds up to so much, but to less in some orders as floating-point numbers."""
    tenths = {round(10 * oxygen("error", k)): ("error", k) for k in range(0, 50)}
    normal = {round(10 * oxygen("view", k)): ("view", k) for k in range(8, 50)}
    few = 2 if total == 360.0 else 1
    for low in tenths:
        for other in tenths if few == 2 else (0,):
            for a in normal:
                for b in normal:
                    rest = round(10 * total) - low - other - a - b
                    three = few == 1 and rest in normal
                    if not (three or (few == 2 and rest == 0)) or len({low, other, a, b, rest}) < 4:
                        continue
                    found = (tenths[low], *((tenths[other],) if few == 2 else ()), normal[a], normal[b], *((normal[rest],) if three else ()))
                    if min(reduce(add, (oxygen(*x) for x in p)) for p in permutations(found)) < total:
                        return found
    raise AssertionError(total)


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory) -> str:  # noqa: ANN001
    """Patients P100 to P123 have the mean 90, P124 to P147 the mean 95, each in another order."""
    folder = tmp_path_factory.mktemp("limits")
    orders = [p for total in (360.0, 380.0) for p in permutations(on_limit(total))]
    rows = [(4 * n + i, AT + timedelta(seconds=i), n, kind, 0.0, f'{{"k": {k}}}') for n, p in enumerate(orders) for i, (kind, k) in enumerate(p)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).sortWithinPartitions("event_id").write.parquet(f"{folder}/events.parquet")
    for name in ("orders", "lineitem"):
        Path(f"{folder}/{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["alert_list", "alerts_by_batches", "alerts_by_arrival", "patient_detail"])
def test_a_window_whose_mean_is_the_limit_is_no_critical_one(spark, tables, name) -> None:  # noqa: ANN001
    rows = queries.QUERIES[name](spark, tables).filter("severity is not null")
    assert {(r["patient_id"], r["severity"]) for r in rows.select("patient_id", "severity").collect()} == {(f"P{100 + n}", "warning") for n in range(48)}
    assert not rows.filter(F.col("reasons").contains("spo2_low")).count()


@pytest.mark.parametrize("name", ["risk_reasons", "report_rows", "report_consolidated"])
def test_a_day_whose_mean_is_the_limit_has_no_low_oxygen(spark, tables, name) -> None:  # noqa: ANN001
    text = "risk_text" if name == "risk_reasons" else "risk_reasons"
    said = queries.QUERIES[name](spark, tables).filter(F.col(text).contains("SpO2")).select("patient_id").distinct().collect()
    assert {r[0] for r in said} == {f"P{100 + n}" for n in range(24)}
