"""Rules, judgement of readings, and lab cleaning on hand-made rows."""

from __future__ import annotations

from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import permutations
from operator import add

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.operators import ingest, labs, risk, windows
from pulsegrid.settings import RISK_ORDER, STATUS_ORDER

READING = "patient_id string, heart_rate int, spo2 double, systolic_bp int, diastolic_bp int, temperature double, event_time timestamp"
AT = datetime(2024, 1, 1, tzinfo=UTC)


def reading(**changes):  # noqa: ANN003, ANN201
    fields = {"patient_id": "P101", "heart_rate": 80, "spo2": 98.0, "systolic_bp": 120, "diastolic_bp": 80, "temperature": 37.0, "event_time": AT} | changes
    return tuple(fields.values())


@pytest.mark.parametrize(
    ("changes", "reasons", "abnormal"),
    [
        ({}, [], False),
        ({"heart_rate": 60, "spo2": 95.0, "temperature": 37.5}, [], False),  # boundaries are normal
        ({"heart_rate": 100}, [], False),
        ({"heart_rate": 59}, [], True),
        ({"heart_rate": 101}, [], True),
        ({"spo2": 94.9}, [], True),
        ({"temperature": 37.6}, [], True),
        ({"heart_rate": 20, "temperature": 45.0}, [], True),  # plausible bounds are inclusive
        ({"heart_rate": 999}, ["heart_rate"], True),
        ({"heart_rate": None}, ["heart_rate"], False),
        ({"patient_id": "X1"}, ["patient_id"], False),
        ({"patient_id": None, "event_time": None}, ["patient_id", "event_time"], False),
        ({"systolic_bp": 60, "diastolic_bp": 80}, ["pressure_order"], False),
        ({"spo2": 49.9, "temperature": 29.9}, ["spo2", "temperature"], True),
    ],
)
def test_judge(spark, changes, reasons, abnormal) -> None:  # noqa: ANN001
    row = ingest.judge(spark.createDataFrame([reading(**changes)], READING)).first()
    assert (row["reject_reasons"], row["is_valid"], row["is_abnormal"]) == (reasons, not reasons, abnormal)


def test_parse_records(spark) -> None:  # noqa: ANN001
    """Normal; unreadable time (broker's time); corrupt payload (an invalid row, no failure); untidy id."""
    values = [
        '{"patient_id": " p101 ", "heart_rate": 80, "spo2": 98.1, "systolic_bp": 120, "diastolic_bp": 80, "temperature": 36.5, "timestamp": "2024-01-01T00:00:05+00:00"}',
        '{"patient_id": "P102", "heart_rate": 80, "spo2": 98.1, "systolic_bp": 120, "diastolic_bp": 80, "temperature": 36.5, "timestamp": "yesterday"}',
        "\x00\x01 no json",
        None,
    ]
    records = spark.createDataFrame([(0, i, AT, v.encode() if v is not None else None) for i, v in enumerate(values)], "partition int, offset long, timestamp timestamp, value binary")
    rows = ingest.judge(ingest.parse(ingest.decode_json(records))).orderBy("kafka_offset").collect()
    assert [r["is_valid"] for r in rows] == [True, True, False, False]
    assert rows[0]["patient_id"] == "P101" and abs(rows[0]["spo2"] - 98.1) < 1e-5
    seconds = [r["s"] for r in ingest.parse(ingest.decode_json(records)).orderBy("kafka_offset").select(F.unix_seconds("event_time").alias("s")).collect()]
    assert seconds == [int(AT.timestamp()) + 5] + [int(AT.timestamp())] * 3


@pytest.mark.parametrize(
    ("spo2", "rate", "temperature", "count", "severity", "codes"),
    [
        (98.0, 80.0, 37.0, 0, None, []),
        (98.0, 80.0, 37.0, 2, "warning", ["abnormal_readings"]),
        (89.9, 80.0, 37.0, 0, "critical", ["spo2_low"]),
        (90.0, 50.0, 38.9, 1, "warning", ["abnormal_readings"]),
        (89.0, 49.0, 39.0, 3, "critical", ["spo2_low", "heart_rate_low", "temperature_high"]),
        (98.0, 130.1, 37.0, 1, "critical", ["heart_rate_high"]),
    ],
)
def test_window_alerts(spark, spo2, rate, temperature, count, severity, codes) -> None:  # noqa: ANN001
    frame = spark.createDataFrame([(spo2, rate, temperature, count)], "avg_spo2 double, avg_heart_rate double, avg_temperature double, abnormal_count long")
    found = windows.alerts(frame).collect()
    assert [(r["severity"], [x["code"] for x in r["reasons"]]) for r in found] == ([(severity, codes)] if severity else [])


def test_risk_matrix_and_ranks(spark) -> None:  # noqa: ANN001
    frame = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "v boolean, l boolean")
    flags = [r[0] for r in frame.select(rules.risk_flag(F.col("v"), F.col("l"))).collect()]
    assert flags == list(RISK_ORDER)
    ranks = spark.createDataFrame([(s,) for s in (*STATUS_ORDER, "else", None)], "s string").select(rules.rank_in(STATUS_ORDER, F.col("s"))).collect()
    assert [r[0] for r in ranks] == [1, 2, 3, 4, 5, 5]


def test_lab_cleaning(spark) -> None:  # noqa: ANN001
    rows = [
        ("P101", "CRP", "12.5", "0-10 mg/L", "2024-01-01T10:00:00+00:00"),
        (" p102 ", "CRP", "5", "0-10 mg/L", "2024-01-01T10:00:00+00:00"),
        ("P101", "CRP", "8.5", "0-10 mg/L", "2024-01-01T11:00:00+00:00"),  # later: wins
        ("P101", "CRP", "99", "0-10 mg/L", None),  # unknown times lose
        ("P103", "CRP", "n/a", "0-10 mg/L", None),
        ("BAD", "CRP", "5", "0-10 mg/L", None),
        ("P104", "CRP", "5", "unknown", None),
        ("P105", "", "5", "0-10 mg/L", None),
        ("P106", "BE", "-3.5", "-2-2 mmol/L", None),
        ("P107", "CRP", "1", "0-10", None),
        ("P107", "CRP", "2", "0-10", None),  # a tie of times: the larger value
        (None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "patient_id string, test_type string, result_value string, reference_range string, collected_at string")
    got = {(r["patient_id"], r["test_type"]): (r["result_value"], r["ref_low"], r["ref_high"], r["lab_abnormal"]) for r in labs.clean(frame).collect()}
    assert got == {
        ("P101", "CRP"): (8.5, 0, 10, False), ("P102", "CRP"): (5, 0, 10, False), ("P106", "BE"): (-3.5, -2, 2, True), ("P107", "CRP"): (2, 0, 10, False),
    }


def test_windows_overlap(spark) -> None:  # noqa: ANN001
    """A reading falls into three windows of 30 s that begin on multiples of 10 s."""
    frame = ingest.judge(spark.createDataFrame([reading(event_time=datetime(2024, 1, 1, 0, 0, 25, tzinfo=UTC))], READING))
    found = windows.sliding_summary(frame).select(F.unix_seconds("window_start").alias("s"), F.unix_seconds("window_end").alias("e")).orderBy("s").collect()
    base = int(AT.timestamp())
    assert [(r["s"] - base, r["e"] - base) for r in found] == [(0, 30), (10, 40), (20, 50)]


def test_means_on_a_limit_do_not_depend_on_the_order_of_rows(spark) -> None:  # noqa: ANN001
    # four values whose mean is the limit itself; their floating-point sum is below it in some orders
    low, high = (86.1, 86.4, 93.7, 93.8), (92.1, 92.4, 97.7, 97.8)
    assert min(reduce(add, p) for p in permutations(low)) < 360.0 and min(reduce(add, p) for p in permutations(high)) < 380.0
    rows = [(f"P{limit}{k}", 80, x, 37.5, True, AT) for limit, values in ((90, low), (95, high)) for k, p in enumerate(permutations(values)) for x in p]
    readings = spark.createDataFrame(rows, "patient_id string, heart_rate int, spo2 double, temperature double, is_abnormal boolean, event_time timestamp").coalesce(1)
    summary = windows.sliding_summary(readings, "30 seconds", "10 seconds")
    assert {r[0] for r in summary.select("avg_spo2").collect()} == {90.0, 95.0}
    assert {r[0] for r in windows.alerts(summary).select("severity").collect()} == {"warning"}
    days = risk.day_summary(readings, F.lit(AT))
    assert {r[0] for r in days.select("avg_spo2").collect()} == {90.0, 95.0}
    # values of more decimals, very large ones and unknown ones
    one = spark.createDataFrame([(x,) for x in (1 / 3, 2 / 3, 1e9, None, 0.5)], "x double").agg(rules.mean("x"), F.avg("x"), rules.mean("x") - F.avg("x")).first()
    assert abs(one[2]) < 1e-6
    assert spark.createDataFrame([(None,)], "x double").agg(rules.mean("x")).first()[0] is None
    assert spark.createDataFrame([(float("nan"),), (1.0,)], "x double").agg(F.isnan(rules.mean("x"))).first()[0]


def test_a_mean_is_rounded_once(spark) -> None:  # noqa: ANN001
    """192 readings that add up to so many tenths: their means end in a half at the seventh decimal."""
    tenths = (69129, 69159, 69189, 69219)
    rows = [(f"P{t}", 80, (t // 192 + (i < t % 192)) / 10, (t // 192 + (i < t % 192)) / 10, False, AT) for t in tenths for i in range(192)]
    readings = spark.createDataFrame(rows, "patient_id string, heart_rate int, spo2 double, temperature double, is_abnormal boolean, event_time timestamp")
    expected = {(f"P{t}", t / 1920, float((Decimal(t) / 1920).quantize(Decimal("1e-6"), ROUND_HALF_UP))) for t in tenths}
    for found in (risk.day_summary(readings, F.lit(AT)), windows.sliding_summary(readings)):
        for name in ("avg_spo2", "avg_temperature"):
            assert {tuple(r) for r in found.select("patient_id", name, F.round(name, 6)).distinct().collect()} == expected


def test_noise_of_the_last_bits_does_not_tip_a_mean(spark) -> None:  # noqa: ANN001
    """36.1 + 0.2 lies beside 36.3; half of the readings have it, and the mean is the limit, which is normal."""
    noisy = 36.1 + 0.2
    assert noisy != 36.3
    rows = [("P101", 80, 98.0, x, False, AT) for x in (noisy, 38.7) * 13]
    readings = spark.createDataFrame(rows, "patient_id string, heart_rate int, spo2 double, temperature double, is_abnormal boolean, event_time timestamp").coalesce(1)
    day = risk.day_summary(readings, F.lit(AT)).withColumn("concerning", rules.concerning()).first()
    assert (day["avg_temperature"], day["concerning"]) == (37.5, False)
    assert {r[0] for r in windows.sliding_summary(readings).select("avg_temperature").collect()} == {37.5}
