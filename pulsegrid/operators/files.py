"""Lab files: names, what is pending, what is ready, and the readings of each file's period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: names of lab files, with their day and epoch.
NAME = r"^lab_results_day(\d+)_(\d+)\.csv$"


def catalog(listing: DataFrame, day_seconds: int) -> DataFrame:
    """listing (file_name, ...) with day, epoch, window_start and window_end; other names fall out. Identity: the name."""
    epoch = F.regexp_extract("file_name", NAME, 2).try_cast("long")
    rows = listing.withColumns({"day": F.regexp_extract("file_name", NAME, 1).try_cast("int"), "epoch": epoch}).filter("epoch is not null")
    return rows.withColumns({"window_start": F.timestamp_seconds(F.col("epoch") - day_seconds), "window_end": F.timestamp_seconds("epoch")})


def pending(files: DataFrame, processed: DataFrame, as_of_epoch: Column, grace_seconds: int, max_age_seconds: int, limit: int | None = None) -> DataFrame:
    """Files without a successful run whose age is within [grace, max_age], oldest first."""
    age = as_of_epoch - F.col("epoch")
    rows = files.join(processed.select(F.col("source_file").alias("file_name")).distinct(), "file_name", "left_anti")
    rows = rows.withColumn("age_seconds", age).filter(F.col("age_seconds").between(grace_seconds, max_age_seconds)).orderBy("epoch", "day", "file_name")
    return rows.limit(limit) if limit else rows


def gate(waiting: DataFrame, latest_event_epoch: Column, as_of_epoch: Column, grace_seconds: int, max_wait_seconds: int) -> DataFrame:
    """waiting with caught_up, waited_out, maybe_incomplete and ready: the oldest-first prefix up to the first file that's neither.

    The order is over pending files, of which a run takes a limited number; it isn't over readings.
    """
    caught = F.coalesce(latest_event_epoch >= F.col("epoch"), F.lit(False))
    waited = as_of_epoch - F.col("epoch") >= grace_seconds + max_wait_seconds
    rows = waiting.withColumns({"caught_up": caught, "waited_out": waited, "maybe_incomplete": ~caught})
    prefix = Window.orderBy("epoch", "day", "file_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("ready", F.bool_and(F.col("caught_up") | F.col("waited_out")).over(prefix))


#: Most files whose periods are taken to the driver and broadcast.
MOST_FILES = 10_000


def readings_per_file(readings: DataFrame, files: DataFrame, day_seconds: int, most_files: int = MOST_FILES) -> DataFrame:
    """Readings of each file's period [epoch - day, epoch), all files in one job; periods may overlap.

    Readings and periods meet by bins of a period's length: an equi-join, in which each period touches two bins. The
    periods of up to ``most_files`` files are broadcast, so that readings aren't exchanged, and their first and last time
    bounds the scan of readings. With more files both sides are exchanged, each bin in parts by patient.
    """
    periods = files.select(F.col("file_name").alias("source_file"), "window_start", "window_end")
    tile = lambda c: F.floor(F.unix_micros(c) / F.lit(1_000_000 * day_seconds))
    bins = F.explode(F.sequence(tile(F.col("window_start")), tile(F.timestamp_micros(F.unix_micros("window_end") - 1)))).alias("_bin")
    inside = (F.col("event_time") >= F.col("window_start")) & (F.col("event_time") < F.col("window_end"))
    few = periods.limit(most_files + 1).collect()
    if len(few) <= most_files:
        at = F.col("event_time")
        near = readings.filter((at >= F.lit(min(r[1] for r in few))) & (at < F.lit(max(r[2] for r in few)))) if few else readings.limit(0)
        tiled = F.broadcast(readings.sparkSession.createDataFrame(few, periods.schema).select("*", bins))
        return near.withColumn("_bin", tile(at)).join(tiled, "_bin").filter(inside).drop("_bin")
    parts = int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiled = periods.select("*", bins).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = readings.withColumns({"_bin": tile(F.col("event_time")), "_part": F.pmod(F.xxhash64("patient_id"), F.lit(parts)).cast("int")})
    return dealt.join(tiled, ["_bin", "_part"]).filter(inside).drop("_bin", "_part")
