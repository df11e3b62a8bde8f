"""Tables replayed as streams: records are written as files, drained through the live path, and its tables returned."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators import files as lab_files
from pulsegrid.operators import ingest, risk
from pulsegrid.settings import DEFAULT
from pulsegrid.sources import readers
from pulsegrid.streaming import live, progress, sinks

NEVER_LATE = "100000 days"
#: Most batches that a drain takes.
BATCHES = 3


def run(spark: SparkSession, base: str, schema, window: str, slide: str, watermark: str = NEVER_LATE, files: int | None = None, compact_every: int = 100) -> None:  # noqa: ANN001
    """Read what is new in the folder of records through both queries, so many files in a batch (all, if None), until they are done; their progress goes to a table."""
    limit = {"maxFilesPerTrigger": files} if files else {}
    source = lambda: spark.readStream.schema(schema).options(**limit).parquet(f"{base}/records")
    settings = replace(DEFAULT, times=replace(DEFAULT.times, window=window, slide=slide))
    beats = progress.Beats()
    queries = live.start(source, ingest.decode_json, base, settings, available_now=True, watermark=watermark, compact_every=compact_every)
    for query in queries:
        query.awaitTermination()
        beats.take(query)
    beats.flush(spark, f"{base}/progress")


def drain(records: DataFrame, window: str, slide: str) -> str:
    """Run both queries over the records until they are done; the folder of their tables. No reading is late.

    The files that tasks have written come in BATCHES batches, or four in each if they are few: more records make larger
    batches, not more of them, since each batch has to look at what the ones before it have left.
    """
    spark, base = records.sparkSession, readers.scratch(records.sparkSession, "replay")
    records.write.parquet(f"{base}/records")
    written = len(spark.read.schema(records.schema).parquet(f"{base}/records").inputFiles())
    run(spark, base, records.schema, window, slide, files=max(4, -(-written // BATCHES)))
    return base


def arrive(records: DataFrame, turn: int, base: str, window: str, slide: str, watermark: str) -> None:
    """The records of one turn (column turn) come in as one batch of files, and the live path, started again, reads them."""
    rows = records.filter(F.col("turn") == turn).drop("turn")
    rows.write.mode("append").parquet(f"{base}/records")
    run(records.sparkSession, base, rows.schema, window, slide, watermark)


def summary(spark: SparkSession, base: str) -> DataFrame:
    """The windows that a drain left."""
    return sinks.current_windows(spark, f"{base}/windows").drop("batch_id", "computed_at")


def master(spark: SparkSession, base: str) -> DataFrame:
    return readers.master(spark, f"{base}/master")


def alerts(spark: SparkSession, base: str) -> DataFrame:
    """The alert table as the batches have merged it."""
    return sinks.current_alerts(spark, f"{base}/alerts")


def report(spark: SparkSession, base: str, files: DataFrame, day_seconds: int, run: str) -> None:
    """Summaries of the files' periods from the master, late readings too, in place of what these files' runs wrote before."""
    span = files.agg(F.min("window_start"), F.max("window_end")).first()
    readings = readers.master(spark, f"{base}/master", F.lit(span[0]), F.lit(span[1]))
    found = risk.day_summary(lab_files.readings_per_file(readings, files, day_seconds), F.col("window_start"), ("source_file",))
    sinks.replace_report(found.withColumn("run", F.lit(run)), f"{base}/reports")


def reports(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/reports")
