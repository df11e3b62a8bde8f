"""Patient risk of a period: vitals summary with trends, joined with laboratory results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.operators import files
from pulsegrid.settings import DEFAULT, RISK_ORDER, Limits

# The columns of the report table, in order, and the texts of its reasons.
REPORT_COLUMNS = (
    "report_day", "patient_id", "avg_heart_rate", "avg_spo2", "vitals_abnormal_count", "lab_test_type", "lab_result_value", "lab_abnormal", "risk_flag", "generated_at",
    "source_file", "run_id", "window_start", "window_end", "total_readings", "abnormal_ratio", "avg_temperature", "min_spo2", "max_heart_rate", "hr_trend_bpm_per_min",
    "spo2_trend_pct_per_min", "lab_reference_range", "lab_collected_at", "patient_abnormal_lab_count", "vitals_concerning", "vitals_only_risk", "risk_changed_by_labs", "risk_reasons",
)
REASON_TEXTS = {
    "no_vitals": "no vitals received in window",
    "abnormal_percent": "%.0f%% of %d readings abnormal",
    "spo2_low": "avg SpO2 %.1f%%",
    "heart_rate_high": "avg HR %.0f bpm",
    "heart_rate_low": "avg HR %.0f bpm",
    "temperature_high": "avg temp %.1fC",
    "abnormal_labs": "abnormal labs: %s",
}


def day_summary(readings: DataFrame, origin: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per patient: counts, means, extremes, share of abnormal readings, and least-squares trends per minute.

    Times count from ``origin`` (the start of the period), so that sums stay small; a trend needs two readings.
    """
    minutes = (F.unix_micros("event_time") - F.unix_micros(origin)) / 60_000_000.0
    found = readings.withColumn("_minute", minutes).groupBy(*keys, "patient_id").agg(
        F.count("*").alias("total_readings"),
        F.count_if("is_abnormal").alias("abnormal_readings"),
        F.avg("heart_rate").alias("avg_heart_rate"),
        rules.mean("spo2").alias("avg_spo2"),
        rules.mean("temperature").alias("avg_temperature"),
        F.min("spo2").alias("min_spo2"),
        F.max("heart_rate").alias("max_heart_rate"),
        F.regr_slope("heart_rate", "_minute").alias("heart_rate_trend"),
        F.regr_slope("spo2", "_minute").alias("spo2_trend"),
    )
    return found.withColumn("abnormal_ratio", F.try_divide("abnormal_readings", "total_readings"))


def report(summary: DataFrame, labs: DataFrame, keys: tuple[str, ...] = (), limits: Limits = DEFAULT.limits) -> DataFrame:
    """One row for each patient and lab test; patients without vitals or without labs stay, with nulls.

    labs: rolled-up results (abnormal_labs, abnormal_tests). Counts of what's absent are 0; means and shares stay null.
    """
    on = [*keys, "patient_id"]
    none = lambda name: F.coalesce(F.col(name), F.lit(0))
    joined = summary.join(labs.select(*on, "test_type", "result_value", "reference_range", "ref_low", "ref_high", "collected_at", "lab_abnormal", "abnormal_labs", "abnormal_tests"), on, "full_outer")
    joined = joined.withColumns({c: none(c) for c in ("total_readings", "abnormal_readings", "abnormal_labs")})
    vitals, abnormal = rules.concerning(limits), F.col("abnormal_labs") > 0
    return joined.withColumn("vitals_concerning", vitals).withColumns(
        {
            "risk_before_labs": rules.risk_flag(F.col("vitals_concerning"), F.lit(False)),
            "risk_after_labs": rules.risk_flag(F.col("vitals_concerning"), abnormal),
            "risk_changed_by_labs": abnormal,
        }
    )


def reasons(rows: DataFrame, limits: Limits = DEFAULT.limits) -> DataFrame:
    """rows with risk_reasons: structured parts (code, value), in a fixed order."""
    low, high = limits.normal_heart_rate
    part = lambda code, value: F.struct(F.lit(code).alias("code"), value.cast("double").alias("value"))
    at = F.col
    parts = [
        F.when(at("total_readings") == 0, part("no_vitals", F.lit(0))),
        F.when(at("abnormal_ratio") >= limits.abnormal_share_from, part("abnormal_percent", at("abnormal_ratio") * 100)),
        F.when(at("avg_spo2") < limits.normal_spo2_from, part("spo2_low", at("avg_spo2"))),
        F.when(at("avg_heart_rate") > high, part("heart_rate_high", at("avg_heart_rate"))),
        F.when(at("avg_heart_rate") < low, part("heart_rate_low", at("avg_heart_rate"))),
        F.when(at("avg_temperature") > limits.normal_temperature_to, part("temperature_high", at("avg_temperature"))),
        F.when(at("abnormal_labs") > 0, part("abnormal_labs", at("abnormal_labs"))),
    ]
    return rows.withColumn("risk_reasons", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def shown(value: Column, digits: int, sign: str = "") -> Column:
    """A number with so many decimals, halves up; noise beyond the sixth decimal doesn't tip it."""
    return F.format_string(f"%{sign}.{digits}f", F.round(F.round(value.cast("double"), 6), digits) + F.lit(0.0))


def reasons_text(found: Column, readings: Column, tests: Column) -> Column:
    """Reasons as one line of text."""

    def say(x: Column) -> Column:
        text = F.lit("")
        for code, pattern in REASON_TEXTS.items():
            number = shown(x["value"], 1 if ".1f" in pattern else 0)
            plain = pattern.replace("%.0f", "%s").replace("%.1f", "%s").replace("%d", "%s")
            values = {"abnormal_percent": [number, readings.cast("string")], "abnormal_labs": [F.array_join(tests, ", ")], "no_vitals": []}.get(code, [number])
            text = F.when(x["code"] == code, F.format_string(plain, *values) if values else F.lit(plain)).otherwise(text)
        return text

    return F.array_join(F.transform(found, say), "; ")


def report_order() -> list[Column]:
    """Rows of the report table: most severe first, then patient and test."""
    return [F.col("source_file"), rules.rank_in(RISK_ORDER, F.col("risk_flag")), F.col("patient_id"), F.coalesce(F.col("lab_test_type"), F.lit(""))]


def report_rows(rows: DataFrame, run_id: Column, generated_at: Column, day_seconds: int) -> DataFrame:
    """``report`` rows (with source_file) as the report table keeps them: REPORT_COLUMNS."""
    epoch = F.regexp_extract("source_file", files.NAME, 2).try_cast("long")
    table = {
        "report_day": F.regexp_extract("source_file", files.NAME, 1).try_cast("int"),
        "vitals_abnormal_count": F.col("abnormal_readings"),
        "lab_test_type": F.col("test_type"),
        "lab_result_value": F.col("result_value"),
        "risk_flag": F.col("risk_after_labs"),
        "generated_at": generated_at,
        "run_id": run_id,
        "window_start": F.timestamp_seconds(epoch - day_seconds),
        "window_end": F.timestamp_seconds(epoch),
        "hr_trend_bpm_per_min": F.col("heart_rate_trend"),
        "spo2_trend_pct_per_min": F.col("spo2_trend"),
        "lab_reference_range": F.col("reference_range"),
        "lab_collected_at": F.col("collected_at"),
        "patient_abnormal_lab_count": F.col("abnormal_labs"),
        "vitals_only_risk": F.when(F.col("vitals_concerning"), "elevated").otherwise("normal"),
        "risk_reasons": reasons_text(F.col("risk_reasons"), F.col("total_readings"), F.col("abnormal_tests")),
    }
    return reasons(rows).select(*(table.get(c, F.col(c)).alias(c) for c in REPORT_COLUMNS))
