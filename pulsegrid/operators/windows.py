"""Sliding event-time windows and their alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.settings import DEFAULT, Limits


def sliding_summary(valid: DataFrame, window: str = DEFAULT.times.window, slide: str = DEFAULT.times.slide, watermark: str | None = None, ending_after: Column | None = None) -> DataFrame:
    """One row for each patient and window; with a watermark for streams, without one for tables.

    ending_after: only windows that end later. A window's readings lie at most its length before its end, so those before
    that time less a window's length are not read: the optimizer can't infer that bound through the aggregation.
    """
    rows = valid.withWatermark("event_time", watermark) if watermark else valid
    # a stream's payloads are 32-bit numbers, which add up exactly as doubles: its state needs no more than sum and count
    mean = F.avg if watermark else rules.mean
    if ending_after is not None:
        rows = rows.filter(F.col("event_time") >= ending_after - F.expr(f"INTERVAL {window}"))
    summary = rows.groupBy(F.window("event_time", window, slide).alias("w"), "patient_id").agg(
        F.avg("heart_rate").alias("avg_heart_rate"),
        mean("spo2").alias("avg_spo2"),
        mean("temperature").alias("avg_temperature"),
        F.count_if("is_abnormal").alias("abnormal_count"),
        F.count("*").alias("total_readings"),
        F.max("heart_rate").alias("max_heart_rate"),
        F.min("heart_rate").alias("min_heart_rate"),
        F.min("spo2").alias("min_spo2"),
        F.max("temperature").alias("max_temperature"),
    )
    found = summary.select("patient_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *summary.columns[2:])
    return found if ending_after is None else found.filter(F.col("window_end") > ending_after)


def alerts(summary: DataFrame, limits: Limits = DEFAULT.limits) -> DataFrame:
    """Windows that alert, with reasons (code, value) and severity."""
    return summary.withColumn("reasons", rules.breach_reasons(limits)).withColumn("severity", rules.severity(F.col("reasons"))).filter(F.col("severity").isNotNull())
