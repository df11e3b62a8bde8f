"""Progress of running queries as a table of heartbeats."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulsegrid.operators.serving import latest

BEAT = "component string, beat_at timestamp, details struct<batch_id: bigint, readings_in: bigint, rejected: bigint, input_rate: double, trigger_ms: bigint, watermark: string, state_rows: bigint>"


def details(progress: dict) -> tuple:
    """Batch, input rows, rejected (an observed metric), rates, trigger time, watermark and state rows of one progress report."""
    observed = (progress.get("observedMetrics") or {}).get("quality") or {}
    state = sum(int(s.get("numRowsTotal", 0)) for s in progress.get("stateOperators") or [])
    return (
        progress.get("batchId"), int(progress.get("numInputRows") or 0), int(observed.get("rejected") or 0), float(progress.get("inputRowsPerSecond") or 0.0),
        int((progress.get("durationMs") or {}).get("triggerExecution") or 0), (progress.get("eventTime") or {}).get("watermark"), state,
    )


class Beats(StreamingQueryListener):
    """Keeps each progress report of running queries until ``flush`` appends it to the table: a line for each query and batch."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, int | None], tuple[datetime, dict]] = {}
        self.failed: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.add(event.progress.name or str(event.progress.id), json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.failed[str(event.id)] = event.exception

    def add(self, name: str, report: dict) -> None:
        """A report; of one batch the one with input counts, then the last."""
        key = (name, report.get("batchId"))
        if key not in self.seen or report.get("numInputRows") or not self.seen[key][1].get("numInputRows"):
            self.seen[key] = (datetime.now(UTC), report)

    def take(self, query: StreamingQuery) -> None:
        """What a query itself remembers of its progress, whether or not the listener has been told yet."""
        for report in query.recentProgress:
            self.add(query.name or str(query.id), json.loads(report.json))

    def flush(self, spark: SparkSession, path: str) -> None:
        """Append what is new since the last flush."""
        rows, self.seen = [(name, at, details(p)) for (name, _), (at, p) in self.seen.items()], {}
        if rows:
            spark.createDataFrame(rows, BEAT).coalesce(1).write.mode("append").parquet(path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The last report of each component and batch."""
    rows = spark.read.parquet(path).withColumn("batch_id", F.col("details.batch_id"))
    return latest(rows, ["component", "batch_id"], F.col("details.readings_in"), "beat_at")


def heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """The last beat of each component."""
    return latest(spark.read.parquet(path), "component", "beat_at", F.col("details.batch_id"))


def run_until_any_ends(spark: SparkSession, queries: list[StreamingQuery], beats: Beats | None = None, path: str | None = None, every_seconds: int = 15) -> None:
    """Wait until one query ends, stop the others, and raise what ended it. Other queries of the session don't matter."""
    while all(q.isActive for q in queries):
        try:
            spark.streams.awaitAnyTermination(every_seconds)
        except StreamingQueryException:
            pass  # of whichever query; those at hand are asked below
        spark.streams.resetTerminated()
        if beats and path:
            beats.flush(spark, path)
    for q in queries:
        if q.isActive:
            q.stop()
    for q in queries:
        if q.exception():
            raise q.exception()


def observed(judged: DataFrame) -> DataFrame:
    """judged with counts that progress reports carry."""
    return judged.observe("quality", F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("is_valid")).alias("rejected"))
