"""The driver's tables in the shape of monitoring data: readings from events, lab results and lab files from orders.

All arithmetic is on integers or exact, so another engine gets the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.rules import once

#: Length of a "day" of these tables: three of them hold the month that events span.
DAY_SECONDS = 10 * 86_400
#: First second of the month.
EPOCH = 1_704_067_200
WINDOW, SLIDE = "24 hours", "8 hours"
INGEST_LAG = "2 seconds"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with k, the number in props."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.select("*", once(F.get_json_object("props", "$.k").cast("int")).alias("k"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw readings with lineage columns, not yet judged."""
    bad = (F.col("event_type") == "error") & (F.col("k") < 50)
    signup, k = F.col("event_type") == "signup", F.col("k")
    low_pressure = (F.col("event_type") == "view") & (k == 7)
    return events(spark, sf_dir).select(
        (F.col("event_id") % 4).cast("int").alias("kafka_partition"),
        F.col("event_id").alias("kafka_offset"),
        F.concat(F.lit("P"), (F.col("user_id") + 100).cast("string")).alias("patient_id"),
        F.when(signup & (k % 10 == 0), 999)
        .when(signup & (k % 10 == 1), None)
        .when(bad & (k % 2 == 0), 40 + k % 16)
        .when(bad, 120 + k % 41)
        .otherwise(60 + k % 41)
        .cast("int")
        .alias("heart_rate"),
        F.when(bad, 80 + (k % 101) / 10).otherwise(95 + (k % 51) / 10).cast("double").alias("spo2"),
        F.when(low_pressure, 60).otherwise(100 + k % 31).cast("int").alias("systolic_bp"),
        (65 + k % 21).cast("int").alias("diastolic_bp"),
        F.when(bad, 38.5 + (k % 16) / 10).otherwise(36.1 + (k % 12) / 10).cast("double").alias("temperature"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.expr(f"INTERVAL {INGEST_LAG}")).alias("ingested_at"),
    )


def labs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab lines as text, as a lab file has them, with the day and the source file."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    people = spark.read.parquet(f"{sf_dir}/events.parquet").agg(((F.max("user_id") + 1) * 4 / 3).cast("long").alias("m"))
    key, number = F.col("o_orderkey"), (F.col("o_custkey") % F.col("m") + 100).cast("string")
    day = (1 + key % 3).cast("int")
    return orders.crossJoin(F.broadcast(people)).select(
        day.alias("day"),
        F.concat(F.lit("lab_results_day"), day, F.lit("_"), F.lit(EPOCH) + day * DAY_SECONDS, F.lit(".csv")).alias("source_file"),
        F.when(key % 4 == 0, F.concat(F.lit(" p"), number, F.lit(" "))).when(key % 26 == 0, "BAD").otherwise(F.concat(F.lit("P"), number)).alias("patient_id"),
        F.substring("o_orderpriority", 3, 100).alias("test_type"),
        F.when(key % 14 == 0, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("result_value"),
        F.when(key % 22 == 0, "unknown").otherwise("30000-450000 u").alias("reference_range"),
        F.when(key % 9 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).alias("collected_at"),
    )


def lab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of lab drops: one file for each order date, some with names that aren't lab files.

    file_name, modified (seconds), size (lines).
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    date = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    name = F.when(date % 604_800 == 0, F.concat(F.lit("notes_"), date, F.lit(".txt"))).otherwise(
        F.concat(F.lit("lab_results_day"), F.dayofmonth("o_orderdate"), F.lit("_"), date, F.lit(".csv"))
    )
    return orders.groupBy(name.alias("file_name"), date.alias("modified")).agg(F.count("*").alias("size"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit lines of report runs, one for each order: run_id, source_file, task, status, times, counts. Runs end out of order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    date = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "success").otherwise("running")
    return orders.select(
        key.alias("run_id"),
        F.concat(F.lit("lab_results_day"), F.dayofmonth("o_orderdate"), F.lit("_"), date, F.lit(".csv")).alias("source_file"),
        F.concat(F.lit("report_"), F.col("o_custkey").cast("string")).alias("task"),
        status.alias("status"),
        F.timestamp_seconds(date + key % 3600).alias("started_at"),
        F.when(status != "running", F.timestamp_seconds(date + key % 3600 + 5 + key % 7 + F.col("o_custkey") % 50 * 600)).alias("finished_at"),
        F.when(status == "success", F.col("o_custkey") % 40).alias("rows_written"),
        F.when(status == "failed", F.concat(F.lit("error in "), F.col("o_orderpriority"))).alias("error"),
    )


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of stored reports, one for each line item, under the file of its date: source_file."""
    date = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    name = F.concat(F.lit("lab_results_day"), F.dayofmonth("l_shipdate"), F.lit("_"), date, F.lit(".csv"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(name.alias("source_file"))
