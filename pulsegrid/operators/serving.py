"""Views that merge live and daily results. Each takes the time ``as_of``; none asks for the present time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.settings import STATUS_ORDER


def latest(rows: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The last row of each key by the given columns. An aggregation: each task sends one row for a key, however hot it is."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def since(column: Column | str, as_of: Column, seconds: int) -> Column:
    """Later than so many seconds before as_of."""
    at = F.col(column) if isinstance(column, str) else column
    return at > as_of - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def age_seconds(at: Column, as_of: Column) -> Column:
    """Whole and part seconds since, never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(at)) / 1_000_000.0)


def latest_alert(episodes: DataFrame, as_of: Column, active_seconds: int) -> DataFrame:
    """The active alert of each patient: critical before warning, then the last updated."""
    active = episodes.filter(since("last_window_end", as_of, active_seconds))
    return latest(active, "patient_id", F.col("severity") == "critical", "last_window_end", "first_window_start")


def ward_patients(readings: DataFrame, windows: DataFrame, episodes: DataFrame, report: DataFrame, as_of: Column, monitored_seconds: int, active_seconds: int, silent_seconds: int, day_seconds: int = 86_400) -> DataFrame:
    """One row for each patient with a reading of the last day: that reading, the day's last window, active alert, last risk, and status.

    report: rows of the report table.
    """
    fresh = readings.filter(since("event_time", as_of, day_seconds))
    shown = ["heart_rate", "spo2", "systolic_bp", "diastolic_bp", "temperature", "is_abnormal"]
    last = latest(fresh.select("patient_id", "event_time", *shown, "kafka_offset"), "patient_id", "event_time", "kafka_offset").drop("kafka_offset")
    means = ["avg_heart_rate", "avg_spo2", "avg_temperature"]
    window = windows.filter(since("window_end", as_of, day_seconds)).select("patient_id", "window_start", "window_end", *means, F.col("abnormal_count").alias("window_abnormal_count"), F.col("total_readings").alias("window_readings"))
    alert = latest_alert(episodes.select("patient_id", "severity", "reasons", "last_window_end", "first_window_start"), as_of, active_seconds)
    alert = alert.select("patient_id", alert_id().alias("alert_id"), F.col("severity").alias("alert_severity"), F.col("reasons").alias("alert_reasons"))
    risk = latest(report.select("patient_id", F.col("risk_flag").alias("latest_daily_risk"), F.col("report_day").alias("latest_report_day"), "source_file", "generated_at"), "patient_id", "generated_at", "source_file")
    rows = last.withColumnsRenamed({"event_time": "last_reading_at", "is_abnormal": "last_reading_abnormal"})
    for other in (latest(window, "patient_id", "window_end"), alert, risk.drop("source_file", "generated_at")):
        rows = rows.join(other, "patient_id", "left")
    age = age_seconds(F.col("last_reading_at"), as_of)
    silent = F.col("seconds_since_last_reading")
    status = F.coalesce("alert_severity", F.when(silent > silent_seconds, "no_signal"), F.lit("normal"))
    return rows.withColumn("seconds_since_last_reading", age).withColumns({"status": status, "monitored": silent <= monitored_seconds})


def alert_id() -> Column:
    """An alert's name: its patient and the second of its first window."""
    return F.concat("patient_id", F.lit("-"), F.unix_seconds("first_window_start").cast("string"))


def ward_order() -> list[Column]:
    return [rules.rank_in(STATUS_ORDER, F.col("status")), F.col("patient_id")]


def ward_snapshot(readings: DataFrame, patients: DataFrame, as_of: Column, monitored_seconds: int, recent_seconds: int) -> DataFrame:
    """One row: monitored patients, readings, abnormal share and means of the recent past, and patients by status."""
    recent = since("ingested_at", as_of, recent_seconds)
    monitored = since("ingested_at", as_of, monitored_seconds)
    wide = F.greatest(F.lit(recent_seconds), F.lit(monitored_seconds))
    facts = readings.filter(since("ingested_at", as_of, max(recent_seconds, monitored_seconds))).agg(
        F.count_distinct(F.when(monitored, F.col("patient_id"))).alias("active_patients"),
        F.count_if(recent).alias("recent_readings"),
        F.avg(F.when(recent, F.col("is_abnormal").cast("int"))).alias("abnormal_ratio"),
        F.avg(F.when(recent, F.col("heart_rate"))).alias("avg_heart_rate"),
        F.avg(F.when(recent, F.col("spo2"))).alias("avg_spo2"),
        F.avg(F.when(recent, F.col("temperature"))).alias("avg_temperature"),
        F.max(wide).alias("_wide"),
    )
    states = patients.agg(
        F.count_if("monitored").alias("monitored"), F.count_if(F.col("status") == "critical").alias("critical"), F.count_if(F.col("status") == "warning").alias("warning")
    )
    return facts.drop("_wide").join(F.broadcast(states))  # one row each


def placed(rows: DataFrame, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with place, from 1, in an order within each ``by`` (files, states): what a reader of the ordered view sees."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def newest(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in the given order."""
    return placed(rows, *order, by=(key,)).filter(F.col("place") <= n)


def latest_report(report: DataFrame) -> DataFrame:
    """The report rows of each patient's latest file, in one pass over the report."""
    at = F.struct("generated_at", "source_file")
    last = F.max(at).over(Window.partitionBy("patient_id"))
    return report.withColumn("_last", last).filter(at == F.col("_last")).drop("_last")


def patient_detail(readings: DataFrame, windows: DataFrame, episodes: DataFrame, report: DataFrame, as_of: Column, minutes: int, most_readings: int = 200, most_windows: int = 60, most_alerts: int = 20) -> DataFrame:
    """For all patients at once: newest readings, windows, alerts and the latest report, as rows (patient_id, kind, place, at, ...).

    Columns that a kind hasn't are null; heart_rate, spo2 and temperature of a window are its means. report: rows of the
    report table.
    """
    vitals = ("heart_rate", "spo2", "temperature")
    as_double = lambda *names: [F.col(n).cast("double").alias(n) for n in names]
    recent = readings.filter(since("event_time", as_of, minutes * 60))
    recent = recent.select("patient_id", F.col("event_time").alias("at"), *as_double(*vitals), "systolic_bp", "diastolic_bp", "is_abnormal", "kafka_offset")
    views = windows.select("patient_id", F.col("window_end").alias("at"), "window_start", *(F.col(f"avg_{n}").alias(n) for n in vitals), "abnormal_count", "total_readings")
    alerts = episodes.select("patient_id", F.col("last_window_end").alias("at"), F.col("first_window_start").alias("window_start"), "severity", "reasons", "breaching_windows")
    tests = latest_report(report).withColumn("place", F.row_number().over(Window.partitionBy("patient_id").orderBy(F.coalesce("lab_test_type", F.lit("")))))
    parts = [
        newest(recent, "patient_id", most_readings, F.desc("at"), F.desc("kafka_offset")).drop("kafka_offset").withColumn("kind", F.lit("reading")),
        newest(views, "patient_id", most_windows, F.desc("at")).withColumn("kind", F.lit("window")),
        newest(alerts, "patient_id", most_alerts, F.desc("at")).withColumn("kind", F.lit("alert")),
        tests.select("patient_id", F.lit("report").alias("kind"), "place", F.col("generated_at").alias("at"), "risk_flag", "risk_reasons", "lab_test_type", "lab_result_value", "lab_reference_range", "lab_abnormal"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def alert_list(episodes: DataFrame, as_of: Column, active_seconds: int, active_only: bool = False, limit: int | None = None) -> DataFrame:
    """Alerts with their active flag, newest first."""
    rows = episodes.withColumn("active", since("last_window_end", as_of, active_seconds))
    rows = rows.filter("active") if active_only else rows
    rows = rows.orderBy(F.desc("last_window_end"), "patient_id", "first_window_start")
    return rows.limit(limit) if limit else rows


def report_list(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """The latest successful run of each file, newest first."""
    rows = latest(runs.filter(F.col("status") == "success"), "source_file", "finished_at", "run_id")
    rows = rows.orderBy(F.desc("finished_at"), "source_file")
    return rows.limit(limit) if limit else rows


def report_of(report: DataFrame, runs: DataFrame, source_file: str | Column | None = None) -> DataFrame:
    """Report rows of one file, or of the file of the last successful run."""
    if source_file is not None:
        return report.filter(F.col("source_file") == source_file)
    last = runs.filter(F.col("status") == "success").agg(F.max_by("source_file", F.struct("finished_at", "run_id")).alias("source_file"))
    return report.join(F.broadcast(last), "source_file", "left_semi")  # one row
