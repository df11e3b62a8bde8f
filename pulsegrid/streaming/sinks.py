"""Idempotent sinks for micro-batches: running a batch again leaves the tables as they are. No rows pass the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import episodes
from pulsegrid.operators.serving import latest
from pulsegrid.sources.layout import BatchTable
from pulsegrid.sources.readers import READING, master_table

#: Most rows of a batch whose keys are broadcast; the keys of larger batches are joined by an exchange.
MOST_BROADCAST = 1_000_000
KEY = ["kafka_partition", "kafka_offset"]
WINDOW_KEY = ["patient_id", "window_start", "window_end"]
#: Buckets of the alert table.
BUCKETS = 256
_NUMBERS = [T.StructField("avg_heart_rate", T.DoubleType()), T.StructField("avg_spo2", T.DoubleType()), T.StructField("avg_temperature", T.DoubleType())]
_COUNTS = [T.StructField("abnormal_count", T.LongType()), T.StructField("total_readings", T.LongType())]
_EXTREMES = [T.StructField("max_heart_rate", T.IntegerType()), T.StructField("min_heart_rate", T.IntegerType()), T.StructField("min_spo2", T.DoubleType()), T.StructField("max_temperature", T.DoubleType())]
_AT = [T.StructField("patient_id", T.StringType()), T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType())]
_DATE, _BATCH = T.StructField("event_date", T.DateType()), T.StructField("batch_id", T.LongType())
WINDOW = T.StructType([*_AT, *_NUMBERS, *_COUNTS, *_EXTREMES, T.StructField("computed_at", T.TimestampType()), _BATCH, _DATE])
BREACH = T.StructType([*_AT, T.StructField("severity", T.StringType()), T.StructField("reasons", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.DoubleType())]))), *_EXTREMES, _BATCH, _DATE])


def _replace(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows in place of the partitions they fall into."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def _as(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


# ---- the master table ------------------------------------------------------------------------------------------------


def append_readings(judged: DataFrame, batch_id: int, path: str, quarantine: str | None = None) -> None:
    """Valid readings, once for each (partition, offset), under their date and batch; rejects with reasons to quarantine.

    Keys that earlier batches hold are left out. A record that comes again has the same event time, so only the folders
    of this batch's dates are listed and read for that, of them only row groups with offsets that the batch has, and the
    table itself isn't exchanged: the batch's keys go to it.
    """
    spark = judged.sparkSession
    rows = _as(judged.filter("is_valid").dropDuplicates(KEY).withColumn("event_date", F.to_date("event_time")), READING).persist()
    try:
        facts = rows.agg(F.collect_set(F.col("event_date").cast("string")).alias("dates"), F.count("*").alias("n"), F.min("kafka_offset").alias("low"), F.max("kafka_offset").alias("high")).first()
        held = master_table(path).read(spark, READING, sorted(facts["dates"]), batch_id)
        master_table(path).write(rows.join(held_keys(held, rows, facts["low"], facts["high"], facts["n"]), KEY, "left_anti"), batch_id)
        if quarantine:
            _replace(judged.filter(~F.col("is_valid")).withColumn("batch_id", F.lit(batch_id).cast("long")), quarantine, "batch_id")
    finally:
        rows.unpersist()


def held_keys(master: DataFrame, rows: DataFrame, low: int | None, high: int | None, n: int) -> DataFrame:
    """Keys of rows that master holds. Keys of up to MOST_BROADCAST rows are broadcast, so that master stays where it is."""
    keys = rows.select(*KEY)
    found = master.filter(F.col("kafka_offset").between(F.lit(low), F.lit(high))).select(*KEY)
    return found.join(F.broadcast(keys) if n <= MOST_BROADCAST else keys, KEY, "left_semi")


def compact_master(spark: SparkSession, path: str, upto: int, dates: list[str] | None = None) -> None:
    """The small files of ended batches as one part for each date."""
    master_table(path).compact(spark, READING, upto, groups=dates)


# ---- windows ---------------------------------------------------------------------------------------------------------


def window_table(path: str) -> BatchTable:
    return BatchTable(path, "event_date")


def upsert_windows(summary: DataFrame, batch_id: int, path: str) -> None:
    """A version of each window of this batch, under the window's date; ``current_windows`` shows the last of each."""
    made = {"computed_at": F.current_timestamp(), "batch_id": F.lit(batch_id).cast("long"), "event_date": F.to_date("window_start")}
    window_table(path).write(_as(summary.withColumns(made), WINDOW), batch_id)


def current_windows(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """The last version of each window (of these dates of their starts)."""
    return latest(window_table(path).read(spark, WINDOW, dates).drop("event_date"), WINDOW_KEY, "batch_id")


def compact_windows(spark: SparkSession, path: str, upto: int, dates: list[str] | None = None) -> None:
    """Drop the versions of ended batches that later ones have superseded; the view stays as it is."""
    window_table(path).compact(spark, WINDOW, upto, lambda rows: latest(rows, [*WINDOW_KEY, "event_date"], "batch_id"), dates)


# ---- breaches and alerts ---------------------------------------------------------------------------------------------


def log_breaches(alerts: DataFrame, batch_id: int, path: str) -> None:
    """Every breaching emission; nothing is retracted."""
    made = {"batch_id": F.lit(batch_id).cast("long"), "event_date": F.to_date("window_start")}
    BatchTable(path, "event_date").write(_as(alerts.withColumns(made), BREACH), batch_id)


def breaches(spark: SparkSession, path: str) -> DataFrame:
    return BatchTable(path, "event_date").read(spark, BREACH).drop("event_date")


def alert_table(path: str) -> BatchTable:
    return BatchTable(path, "bucket", even=True)


ALERT = T.StructType([*episodes.STATE, T.StructField("bucket", T.IntegerType())])
ALERT_KEY = ["patient_id", "first_window_start"]


def merge_alerts(alerts: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> None:
    """Extend, join or open the alert episodes of this batch's patients; all others are neither read nor written.

    Only the folders of the patients' buckets are listed; of them only row groups with episodes that reach into the time
    of the batch's windows are read, and of these the batch's patients.
    """
    spark = alerts.sparkSession
    log = alerts.withColumns({"batch_id": F.lit(batch_id).cast("long"), "bucket": F.pmod(F.xxhash64("patient_id"), F.lit(buckets)).cast("int")}).persist()
    try:
        facts = log.agg(
            F.collect_set("bucket").alias("buckets"), F.count_distinct("patient_id").alias("n"), F.min("window_start").alias("low"), F.max("window_end").alias("high")
        ).first()  # at most one number for each bucket
        if facts["buckets"]:
            held = alert_table(path).read(spark, ALERT, [str(b) for b in sorted(facts["buckets"])], batch_id)
            near = reaching(held, log, facts["low"], facts["high"], facts["n"])
            merged = episodes.merge(latest(near.drop("bucket"), ALERT_KEY, "batch_id"), log)
            alert_table(path).write(_as(merged.withColumn("bucket", F.pmod(F.xxhash64("patient_id"), F.lit(buckets)).cast("int")), ALERT), batch_id)
    finally:
        log.unpersist()


def reaching(held: DataFrame, log: DataFrame, low, high, n: int) -> DataFrame:  # noqa: ANN001
    """Episodes (all their versions) of the log's patients that meet the time from low to high. Later versions reach at least as far."""
    people = log.select("patient_id").distinct()
    near = held.filter((F.col("last_window_end") >= F.lit(low)) & (F.col("first_window_start") <= F.lit(high)))
    return near.join(F.broadcast(people) if n <= MOST_BROADCAST else people, "patient_id", "left_semi")


def current_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alert episodes as ``episodes.episodes`` gives them."""
    return episodes.shown(latest(alert_table(path).read(spark, ALERT).drop("bucket"), ALERT_KEY, "batch_id"))


def compact_alerts(spark: SparkSession, path: str, upto: int) -> None:
    """One version of each episode of ended batches, without those that were joined to others; by time, so that scans skip old ones."""

    def reduced(rows: DataFrame) -> DataFrame:
        return latest(rows, [*ALERT_KEY, "bucket"], "batch_id").filter(~F.col("gone")).select(*ALERT.names)

    alert_table(path).compact(spark, ALERT, upto, reduced)


# ---- reports and runs ------------------------------------------------------------------------------------------------


def replace_report(rows: DataFrame, path: str) -> None:
    """The report of the files among rows; other files stay."""
    _replace(rows, path, "source_file")


RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("status", T.StringType()), T.StructField("at", T.TimestampType()),
        T.StructField("rows_written", T.LongType()), T.StructField("patients", T.LongType()), T.StructField("high_risk", T.LongType()), T.StructField("error", T.StringType()),
    ]
)


def append_run_event(spark: SparkSession, path: str, run_id: str, source_file: str, status: str, at, rows_written=None, patients=None, high_risk=None, error: str | None = None) -> None:  # noqa: ANN001
    """One line of the run audit: running, then success or failed (error cut at 2000 characters)."""
    row = (run_id, source_file, status, at, rows_written, patients, high_risk, error[:2000] if error else None)
    spark.createDataFrame([row], RUN_EVENT).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of each run."""
    return run_states(spark.read.schema(RUN_EVENT).parquet(path))


def run_states(lines: DataFrame) -> DataFrame:
    """The latest of each run's audit lines (run_id, source_file, status, at, ...); of lines of one moment the one that ends it."""
    return latest(lines, ["run_id", "source_file"], "at", F.col("status") != "running")
