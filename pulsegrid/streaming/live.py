"""The live path: two queries from one source of records, each with its own checkpoint and trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.operators import ingest, windows
from pulsegrid.settings import DEFAULT, Settings
from pulsegrid.streaming import progress, sinks


def start(records: Callable[[], DataFrame], decode: Callable[[DataFrame], DataFrame], base: str, settings: Settings = DEFAULT, available_now: bool = False, watermark: str | None = None, compact_every: int = 100) -> list[StreamingQuery]:
    """Start the raw and the window query under the folder ``base``: master, quarantine, windows, breaches, alerts.

    The raw query keeps late readings; the window query drops what its watermark has passed. With available_now both
    take what is there and end. Each replayed batch leaves the tables as they were. Each compact_every-th batch compacts
    what the batches before it, which have ended, wrote.
    """
    times = settings.times

    def judged() -> DataFrame:
        return ingest.judge(ingest.parse(decode(records())), settings.limits)

    def when(seconds: str) -> dict:
        return {"availableNow": True} if available_now else {"processingTime": seconds}

    def raw(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read once, so that the progress report counts each record once
        try:
            sinks.append_readings(batch, batch_id, f"{base}/master", f"{base}/quarantine")
            if batch_id and batch_id % compact_every == 0:
                sinks.compact_master(batch.sparkSession, f"{base}/master", batch_id - 1)
        finally:
            batch.unpersist()

    def live(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            sinks.upsert_windows(batch, batch_id, f"{base}/windows")
            found = windows.alerts(batch, settings.limits)
            sinks.log_breaches(found, batch_id, f"{base}/breaches")
            sinks.merge_alerts(found, batch_id, f"{base}/alerts")
            if batch_id and batch_id % compact_every == 0:
                sinks.compact_windows(batch.sparkSession, f"{base}/windows", batch_id - 1)
                sinks.compact_alerts(batch.sparkSession, f"{base}/alerts", batch_id - 1)
        finally:
            batch.unpersist()

    summary = windows.sliding_summary(judged().filter("is_valid"), times.window, times.slide, watermark or times.watermark)
    return [
        progress.observed(judged()).writeStream.queryName("raw").foreachBatch(raw).option("checkpointLocation", f"{base}/checkpoints/raw").trigger(**when(times.raw_trigger)).start(),
        summary.writeStream.queryName("windows").outputMode("update").foreachBatch(live).option("checkpointLocation", f"{base}/checkpoints/windows").trigger(**when(times.window_trigger)).start(),
    ]
