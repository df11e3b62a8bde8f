"""Registered queries: each operator applied to the driver's tables. Times come out as microseconds, means rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.operators import episodes, files, health, ingest, labs, report, risk, serving, windows
from pulsegrid.settings import RISK_ORDER, STATUS_ORDER
from pulsegrid.sources import adapters as a
from pulsegrid.sources import readers
from pulsegrid.streaming import progress, replay, sinks

DAY = 86_400


def plain(df: DataFrame) -> DataFrame:
    """Comparable columns: times as microseconds, floating-point numbers rounded, structs and arrays as text."""

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("timestamp"):
            return F.unix_micros(c).alias(name)
        if kind in ("double", "float"):
            return F.round(c.cast("double"), 6).alias(name)
        if kind == "array<struct<code:string,value:double>>":
            # values in thousandths
            return F.array_join(F.transform(c, lambda x: F.concat(x["code"], F.lit("="), F.round(F.round(x["value"], 6) * 1000).cast("long").cast("string"))), ",").alias(name)
        if kind == "array<string>":
            return F.array_join(c, ",").alias(name)
        return c.cast("long").alias(name) if kind in ("int", "bigint") else c.alias(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.judge(a.readings(spark, sf))


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).filter("is_valid").drop("reject_reasons", "is_valid")


def as_of(spark: SparkSession, sf: str) -> Column:
    """The last event's time, as a literal, so that filters on it reach the scan."""
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    return F.timestamp_micros(F.lit(last or 0))


def before(at: Column, days: int) -> Column:
    return at - F.make_dt_interval(days=F.lit(days))


def summary(spark: SparkSession, sf: str, ending_after: Column | None = None) -> DataFrame:
    return windows.sliding_summary(valid(spark, sf), a.WINDOW, a.SLIDE, ending_after=ending_after)


def log(spark: SparkSession, sf: str, ending_after: Column | None = None) -> DataFrame:
    return windows.alerts(summary(spark, sf, ending_after)).withColumn("batch_id", F.lit(0).cast("long"))


def alert_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.episodes(log(spark, sf))


def clean_labs(spark: SparkSession, sf: str) -> DataFrame:
    return labs.clean(a.labs_raw(spark, sf), ("source_file",))


def periods(spark: SparkSession, sf: str) -> DataFrame:
    return files.catalog(a.labs_raw(spark, sf).select(F.col("source_file").alias("file_name")).distinct(), a.DAY_SECONDS)


def per_file(spark: SparkSession, sf: str) -> DataFrame:
    return files.readings_per_file(valid(spark, sf), periods(spark, sf), a.DAY_SECONDS)


def per_day(spark: SparkSession, sf: str) -> DataFrame:
    return risk.day_summary(per_file(spark, sf), F.col("window_start"), ("source_file",))


def risk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return risk.report(per_day(spark, sf), labs.rollup(clean_labs(spark, sf), ("source_file",)), ("source_file",))


def report_table(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the report table; run and time of generation follow the file."""
    epoch = F.regexp_extract("source_file", files.NAME, 2).cast("long")
    return risk.report_rows(risk_rows(spark, sf), F.concat(F.lit("run-"), epoch.cast("string")), F.timestamp_seconds(epoch), a.DAY_SECONDS)


def ward(spark: SparkSession, sf: str, now: Column) -> DataFrame:
    """Windows and alerts are made from the readings that they need: ten days for alerts, twice as many where one is older."""
    alerts = episodes.active(lambda edge: log(spark, sf, edge), now, 2 * DAY, 10 * DAY)
    return serving.ward_patients(valid(spark, sf), summary(spark, sf, before(now, 10)), alerts, report_table(spark, sf), now, 2 * DAY, 2 * DAY, 2 * DAY, 5 * DAY)


# ---- queries ---------------------------------------------------------------------------------------------------------


def decode_payload(spark: SparkSession, sf: str) -> DataFrame:
    records = a.events(spark, sf).withColumn("value", F.when(F.col("k") % 17 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")))
    schema = F.schema_of_json(F.lit('{"k": 1}'))
    return plain(ingest.decode_json(records, schema).select("event_id", F.col("payload.k").cast("int").alias("k")))


def as_records(spark: SparkSession, sf: str) -> DataFrame:
    """Readings as a stream source gives them: partition, offset, timestamp, value."""
    r = a.readings(spark, sf)
    iso = F.when(F.col("kafka_offset") % 10 == 0, "not a time").otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    body = F.to_json(
        F.struct(
            F.concat(F.lit(" "), F.lower("patient_id"), F.lit(" ")).alias("patient_id"), "heart_rate", "spo2", "systolic_bp", "diastolic_bp", "temperature", iso.alias("timestamp")
        )
    )
    return r.select(F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"), F.col("ingested_at").alias("timestamp"), body.cast("binary").alias("value"))


def parse_readings(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse(ingest.decode_json(as_records(spark, sf)))
    return plain(rows.withColumns({"spo2": F.round("spo2", 3), "temperature": F.round("temperature", 3)}))


def reading_quality(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ingest.quality_counts(judged(spark, sf)))


def readings_in_window(spark: SparkSession, sf: str) -> DataFrame:
    start = F.timestamp_seconds(F.lit(a.EPOCH + a.DAY_SECONDS))
    return plain(ingest.readings_between(valid(spark, sf), start, F.timestamp_seconds(F.lit(a.EPOCH + 2 * a.DAY_SECONDS))))


def sliding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(summary(spark, sf))


def window_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(windows.alerts(summary(spark, sf)).select("patient_id", "window_start", "severity", "reasons"))


def lab_clean(spark: SparkSession, sf: str) -> DataFrame:
    return plain(clean_labs(spark, sf))


def lab_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return plain(labs.rollup(clean_labs(spark, sf), ("source_file",)).select("source_file", "patient_id", "test_type", "abnormal_labs", "abnormal_tests"))


def lab_quality(spark: SparkSession, sf: str) -> DataFrame:
    return plain(labs.load_stats(a.labs_raw(spark, sf), clean_labs(spark, sf)))


_TRENDS = ("heart_rate_trend", "spo2_trend")


def day_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(per_day(spark, sf).drop(*_TRENDS))


def vitals_trend(spark: SparkSession, sf: str) -> DataFrame:
    return plain(per_day(spark, sf).select("source_file", "patient_id", *_TRENDS))


def risk_report(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("source_file", "patient_id", "test_type", "total_readings", "abnormal_ratio", "result_value", "abnormal_labs", "vitals_concerning", "risk_before_labs", "risk_after_labs", "risk_changed_by_labs")
    return plain(risk_rows(spark, sf).select(*columns).withColumn("risk_rank", rules.rank_in(RISK_ORDER, F.col("risk_after_labs"))))


def risk_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = risk.reasons(risk_rows(spark, sf))
    text = risk.reasons_text(F.col("risk_reasons"), F.col("total_readings"), F.col("abnormal_tests"))
    return plain(rows.select("source_file", "patient_id", "test_type", "risk_reasons", text.alias("risk_text")))


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    return plain(report_table(spark, sf).orderBy(*risk.report_order()))


def report_consolidated(spark: SparkSession, sf: str) -> DataFrame:
    cents = lambda x: F.round(x["result_value"] * 100).cast("long").cast("string")
    said = F.array_join(F.transform("labs", lambda x: F.concat(x["test_type"], F.lit("="), cents(x), F.lit("/"), x["reference_range"], F.when(x["abnormal"], "!").otherwise(""))), ";")
    return plain(report.consolidated(report_table(spark, sf)).withColumn("labs", said))


def report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return plain(report.markdown_lines(report_table(spark, sf)))


def risk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(report.risk_counts(report.consolidated(report_table(spark, sf))))


def labs_effect(spark: SparkSession, sf: str) -> DataFrame:
    return plain(report.labs_effect(report.consolidated(report_table(spark, sf))))


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(report.run_stats(report_table(spark, sf)))


def report_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Requested: every lab file of the catalogue. Stored rows: the line items of its date."""
    asked = files.catalog(a.lab_files(spark, sf), DAY).select(F.col("file_name").alias("source_file"))
    runs = a.run_events(spark, sf)
    return plain(report.validation(asked, runs, a.stored_lines(spark, sf)))


def latest_reading(spark: SparkSession, sf: str) -> DataFrame:
    return plain(serving.latest(valid(spark, sf), "patient_id", "event_time", "kafka_offset"))


def ward_patients(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ward(spark, sf, as_of(spark, sf)))


def ward_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    now = as_of(spark, sf)
    return plain(serving.ward_snapshot(valid(spark, sf), ward(spark, sf, now), now, 2 * DAY, 5 * DAY))


def patient_detail(spark: SparkSession, sf: str) -> DataFrame:
    return plain(serving.patient_detail(valid(spark, sf), summary(spark, sf), alert_episodes(spark, sf), report_table(spark, sf), as_of(spark, sf), 7 * 24 * 60))


def alert_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = serving.alert_list(alert_episodes(spark, sf), as_of(spark, sf), 2 * DAY)
    return plain(rows.select("patient_id", "first_window_start", "last_window_end", "severity", "reasons", "active"))


def report_list(spark: SparkSession, sf: str) -> DataFrame:
    return plain(serving.report_list(a.run_events(spark, sf)).select("source_file", "run_id", "finished_at", "rows_written"))


def readings_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return plain(per_file(spark, sf).groupBy("source_file").agg(F.count("*").alias("readings"), F.count_distinct("patient_id").alias("patients"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")))


def _catalog(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """The catalogue of lab files, and the newest one's time as a literal."""
    found = files.catalog(a.lab_files(spark, sf), DAY)
    return found, F.lit(found.agg(F.max("epoch")).first()[0] or 0)


def _waiting(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Column]:
    found, now = _catalog(spark, sf)
    done = a.run_events(spark, sf).filter(F.col("status") == "success")
    return files.pending(found, done, now, DAY, 1500 * DAY), found, now


def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    return plain(_waiting(spark, sf)[0].select("file_name", "day", "epoch", "age_seconds"))


def completeness_gate(spark: SparkSession, sf: str) -> DataFrame:
    waiting, _, now = _waiting(spark, sf)
    rows = files.gate(waiting, now - 200 * DAY, now, DAY, 30 * DAY)
    return plain(rows.select("file_name", "caught_up", "waited_out", "maybe_incomplete", "ready"))


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    return plain(ingest.ingest_stats(judged(spark, sf)))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One conditional aggregate for each table, over the part of it that counts; two jobs give the times that bound them."""
    facts = judged(spark, sf)
    last, newest, hour = facts.agg(
        F.max(F.unix_micros("event_time")), F.max(F.when(F.col("is_valid"), F.unix_micros("ingested_at"))), F.max(F.unix_micros(F.date_trunc("hour", "ingested_at")))
    ).first()
    now, newest, hour = (F.timestamp_micros(F.lit(x or 0)) for x in (last, newest, hour))
    readings = facts.filter("is_valid").drop("reject_reasons", "is_valid")
    beats = facts.filter(F.col("ingested_at") >= hour).groupBy(F.date_trunc("hour", "ingested_at").alias("beat_at")).agg(
        F.struct(F.count("*").alias("readings_in"), F.count_if(~F.col("is_valid")).alias("rejected"), (F.count("*") / 3600.0).alias("input_rate")).alias("details")
    )
    waiting, catalog, last_file = _waiting(spark, sf)
    runs = a.run_events(spark, sf)
    # the newest reading's windows are the newest; alerts that are active or opened lately need no more than five days
    recent = summary(spark, sf, F.least(newest, before(now, 5)))
    alerts = episodes.episodes(windows.alerts(recent).withColumn("batch_id", F.lit(0).cast("long")))
    return health.unpivoted(
        health.reading_metrics(readings, now, 5 * DAY, 2 * DAY, newest),
        health.window_metrics(recent, now, "window_start"),
        health.heartbeat_metrics(beats, now),
        health.alert_metrics(alerts, now, 2 * DAY, 5 * DAY),
        health.run_metrics(runs, F.timestamp_seconds(last_file), 200 * DAY),
        health.file_metrics(catalog, waiting, last_file + DAY),
        health.open_alert_metrics(health.run_alerts(runs)),
    )


def pipeline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return plain(metrics(spark, sf))


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return health.evaluate(metrics(spark, sf), readers.rules(spark), DAY)


def rule_eval(spark: SparkSession, sf: str) -> DataFrame:
    return plain(evaluated(spark, sf).select("name", "metric", "limit", "value", "severity", "breached", "message"))


def run_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(health.run_alerts(a.run_events(spark, sf)))


def exposition(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the text format, with the values that a reader sees."""
    rows = health.exposition(metrics(spark, sf), readers.rules(spark), DAY)
    return rows.select(F.col("place.part").cast("long").alias("part"), F.col("place.of").alias("of"), "text")


def health_status(spark: SparkSession, sf: str) -> DataFrame:
    return plain(health.overall(evaluated(spark, sf)))


def alert_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Rules are patients here: an open alert where the month's first half breached, a result for the second half."""
    half = F.timestamp_seconds(F.lit(a.EPOCH + 15 * DAY))
    found = windows.alerts(summary(spark, sf))
    opened = found.filter(F.col("window_start") < half).groupBy(F.col("patient_id").alias("name")).agg(F.min("window_start").alias("opened_at"), F.max("window_start").alias("last_seen_at"))
    opened = opened.withColumn("message", F.concat(F.lit("open since "), F.unix_seconds("opened_at").cast("string")))
    late = found.filter(F.col("window_start") >= half).groupBy("patient_id").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))
    people = valid(spark, sf).select("patient_id").distinct().join(late, "patient_id", "left")
    said = F.concat("patient_id", F.lit(": "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" windows"))
    results = people.select(F.col("patient_id").alias("name"), "severity", (F.coalesce("n", F.lit(0)) >= 3).alias("breached"), F.col("n").cast("double").alias("value"), said.alias("message"))
    return plain(health.sync(results, opened, as_of(spark, sf)))


def sustained_breach(spark: SparkSession, sf: str) -> DataFrame:
    """Series: patients' windows by start; breached: any abnormal reading; held for 16 hours."""
    samples = summary(spark, sf).select(F.col("patient_id").alias("series"), F.col("window_start").alias("at"), (F.col("abnormal_count") > 0).alias("breached"))
    return plain(health.sustained(samples, 16 * 3600))


def series_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Series: patients; samples: valid readings; gaps of over two days."""
    samples = valid(spark, sf).select(F.col("patient_id").alias("series"), F.col("event_time").alias("at"))
    expected = a.readings(spark, sf).select(F.col("patient_id").alias("series"))
    return plain(health.gaps(expected, samples, F.timestamp_seconds(F.lit(a.EPOCH)), as_of(spark, sf), 2 * DAY))


def absent_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series: patients; those without a window with an abnormal reading that began in the last three days."""
    windowed = summary(spark, sf).filter("abnormal_count > 0").select(F.col("patient_id").alias("series"), F.col("window_start").alias("at"))
    expected = a.readings(spark, sf).select(F.col("patient_id").alias("series")).distinct()
    return plain(health.absent(expected, windowed, as_of(spark, sf), 3 * DAY))


# ---- ordered views ---------------------------------------------------------------------------------------------------


def report_order(spark: SparkSession, sf: str) -> DataFrame:
    """Where each row of the report table stands in its file's report."""
    rows = serving.placed(report_table(spark, sf), *risk.report_order(), by=("source_file",))
    return plain(rows.select("source_file", "place", "patient_id", "risk_flag", "lab_test_type"))


def ward_order(spark: SparkSession, sf: str) -> DataFrame:
    """Where each patient stands among those of the same state, and the state's rank."""
    rows = serving.placed(ward(spark, sf, as_of(spark, sf)), *serving.ward_order(), by=("status",))
    return plain(rows.select(rules.rank_in(STATUS_ORDER, F.col("status")).alias("status_rank"), "place", "patient_id", "status"))


def pipeline_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of tasks by state: open ones and resolved ones, each with its place from the newest on."""
    found = health.run_alerts(a.run_events(spark, sf))
    parts = [health.by_status(found, state).withColumn("state", F.lit(state)) for state in ("open", "resolved")]
    rows = serving.placed(parts[0].unionByName(parts[1]), F.desc("opened_at"), F.col("name"), by=("state",))
    return plain(rows.select("state", "place", "name", "opened_at", "resolved_at"))


def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report of the file whose run succeeded last, and that of a file asked for by name (a run's report comes a day after its file)."""
    table = report_table(spark, sf)
    runs = table.select("source_file", "run_id", F.col("generated_at").alias("finished_at")).distinct().withColumn("status", F.lit("success"))
    first = F.concat(F.lit("lab_results_day1_"), F.lit(a.EPOCH + a.DAY_SECONDS), F.lit(".csv"))
    asked = serving.report_of(table, runs, first)
    rows = serving.report_of(table, runs).withColumn("asked", F.lit("latest")).unionByName(asked.withColumn("asked", F.lit("named")))
    return plain(rows.select("asked", "source_file", "patient_id", "lab_test_type", "risk_flag", "report_day"))


# ---- the master table and audits -------------------------------------------------------------------------------------


def master_range(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of the second ten days, read from a master table that three batches have filled (the third with much that was there), compacted in between."""
    base, rows = readers.scratch(spark, "master"), judged(spark, sf)
    for n, batch in enumerate((rows.filter("kafka_offset % 3 < 2"), rows.filter("kafka_offset % 3 = 2"), rows.filter("kafka_offset % 2 = 0"))):
        sinks.append_readings(batch, n, f"{base}/master", f"{base}/quarantine")
        if n == 1:
            sinks.compact_master(spark, f"{base}/master", 0)
    start, end = (F.timestamp_seconds(F.lit(a.EPOCH + k * a.DAY_SECONDS)) for k in (1, 2))
    return plain(readers.master(spark, f"{base}/master", start, end))


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected readings with their reasons, as a batch's quarantine holds them after the batch ran twice."""
    base, rows = readers.scratch(spark, "quarantine"), judged(spark, sf)
    for _ in range(2):
        sinks.append_readings(rows, 0, f"{base}/master", f"{base}/quarantine")
    return plain(spark.read.parquet(f"{base}/quarantine").select("kafka_offset", "patient_id", "reject_reasons", "batch_id"))


def run_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each run from its audit lines: one when it starts, one when it ends."""
    runs = a.run_events(spark, sf)
    starts = runs.select("run_id", "source_file", F.lit("running").alias("status"), F.col("started_at").alias("at"), F.lit(None).cast("long").alias("rows_written"))
    ends = runs.filter("finished_at is not null").select("run_id", "source_file", "status", F.col("finished_at").alias("at"), "rows_written")
    return plain(sinks.run_states(starts.unionByName(ends)))


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the batches of breach observations: windows, patients, alerts opened and extended, and all of them so far."""
    found = arrivals(spark, sf)
    stats = ingest.window_stats(found.select("batch_id", "patient_id"), found)
    return plain(ingest.cumulative(stats, ("windows", "alerts_opened", "alerts_extended")))


# ---- alerts by batches -----------------------------------------------------------------------------------------------


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Breach observations as seven batches bring them: a patient's windows come in turn in five, and every fourth comes again in one of two."""
    slot = F.floor(F.unix_seconds("window_start") / 28_800)
    first = log(spark, sf).withColumn("batch_id", F.pmod(slot + F.substring("patient_id", 2, 20).cast("long"), F.lit(5)))
    return first.unionByName(first.filter(F.pmod(slot, F.lit(4)) == 0).withColumn("batch_id", 5 + F.pmod(slot, F.lit(8)) / 4)).withColumn("batch_id", F.col("batch_id").cast("long"))


def alerts_by_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The alert table after seven batches that come out of order, bridge what were separate alerts, and come twice; compacted in between."""
    base = readers.scratch(spark, "alerts")
    arrivals(spark, sf).write.partitionBy("batch_id").parquet(f"{base}/log")
    found = spark.read.parquet(f"{base}/log")
    for n in range(7):
        batch = found.filter(F.col("batch_id") == n).drop("batch_id")
        sinks.merge_alerts(batch, n, f"{base}/alerts", 32)
        if n == 3:
            sinks.merge_alerts(batch, n, f"{base}/alerts", 32)  # replayed
        if n == 4:
            sinks.compact_alerts(spark, f"{base}/alerts", 3)
    return plain(sinks.current_alerts(spark, f"{base}/alerts"))


def alerts_by_arrival(spark: SparkSession, sf: str) -> DataFrame:
    return plain(episodes.arrival_episodes(arrivals(spark, sf)))


# ---- streams ---------------------------------------------------------------------------------------------------------


def stream_sliding_summary(spark: SparkSession, sf: str) -> DataFrame:
    return plain(replay.summary(spark, replay.drain(as_records(spark, sf), a.WINDOW, a.SLIDE)))


def stream_raw_append(spark: SparkSession, sf: str) -> DataFrame:
    return plain(replay.master(spark, replay.drain(as_records(spark, sf), a.WINDOW, a.SLIDE)))


def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return plain(replay.alerts(spark, replay.drain(as_records(spark, sf), a.WINDOW, a.SLIDE)))


def in_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Records that arrive in three turns, ten days each; every seventh of the first twenty days comes late, in the last turn."""
    late = F.when(F.col("offset") % 7 == 0, 2)
    day = lambda n: F.timestamp_seconds(F.lit(a.EPOCH + n * DAY))
    at = F.col("timestamp")
    return as_records(spark, sf).withColumn("turn", F.when(at < day(10), F.coalesce(late, F.lit(0))).when(at < day(20), F.coalesce(late, F.lit(1))).otherwise(2))


def stream_late_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows under a watermark of two days: what comes after its window has closed isn't in it."""
    base, records = readers.scratch(spark, "late"), in_turns(spark, sf)
    for turn in range(3):
        replay.arrive(records, turn, base, a.WINDOW, a.SLIDE, "2 days")
    return plain(replay.summary(spark, base))


def late_correction(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of the first two lab files' periods before the late turn; afterwards the first file's is made again from the master, and only it is replaced."""
    base, records = readers.scratch(spark, "late"), in_turns(spark, sf)
    for turn in range(2):
        replay.arrive(records, turn, base, a.WINDOW, a.SLIDE, "2 days")
    replay.report(spark, base, periods(spark, sf).filter("day <= 2"), a.DAY_SECONDS, "first")
    replay.arrive(records, 2, base, a.WINDOW, a.SLIDE, "2 days")
    replay.report(spark, base, periods(spark, sf).filter("day = 1"), a.DAY_SECONDS, "again")
    return plain(replay.reports(spark, base).drop(*_TRENDS))


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The progress table of the running queries: for each batch of the raw query its readings and rejects, and the metrics of the last beat."""
    base, records = readers.scratch(spark, "progress"), in_turns(spark, sf)
    for turn in range(3):
        replay.arrive(records, turn, base, a.WINDOW, a.SLIDE, "2 days")
    beats = progress.batches(spark, f"{base}/progress").filter((F.col("component") == "raw") & (F.col("details.readings_in") > 0))
    ratio = health.heartbeat_metrics(progress.heartbeats(spark, f"{base}/progress").filter("component = 'raw'"), F.timestamp_seconds(F.lit(0))).select("speed_layer_rejected_ratio")
    return plain(beats.select("batch_id", "details.readings_in", "details.rejected").join(F.broadcast(ratio)))  # one row


# ---- lab drops -------------------------------------------------------------------------------------------------------


def lab_drop_listing(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of drops, listed: its lab files and how many lines they hold; what has another name falls out."""
    folder, lines = readers.scratch(spark, "drops"), a.labs_raw(spark, sf)
    columns = [f.name for f in readers.LAB_SCHEMA]
    names = [r[0] for r in lines.select("source_file").distinct().collect()]  # three files
    for name in (*names, "notes_1.txt"):
        lines.filter(F.col("source_file") == name).select(*columns).write.option("header", True).csv(f"{folder}/{name}")
    found = files.catalog(readers.listing(spark, folder), a.DAY_SECONDS)
    held = readers.lab_csv(spark, *(f"{folder}/{name}" for name in names)).groupBy(F.element_at(F.split("path", "/"), -2).alias("file_name")).agg(F.count("*").alias("lines"))
    return plain(found.filter("size > 0").join(held, "file_name").select("file_name", "day", "epoch", "window_start", "window_end", "lines"))


def lab_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Lab lines written as CSV drops and read back with their file."""
    folder = readers.scratch(spark, "lab-drops")
    lines = a.labs_raw(spark, sf)
    columns = [f.name for f in readers.LAB_SCHEMA]
    lines.select("source_file", *columns).write.partitionBy("source_file").option("header", True).csv(folder)
    read = readers.lab_csv(spark, f"{folder}/source_file=*")
    drop = F.regexp_extract("path", r"source_file=([^/]+)/", 1)
    return plain(read.groupBy(drop.alias("source_file")).agg(F.count("*").alias("lines"), F.count("collected_at").alias("timed"), F.count_distinct("test_type").alias("tests")))


def lab_file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return plain(files.catalog(a.lab_files(spark, sf), DAY).select("file_name", "day", "epoch", "size", "window_start", "window_end"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        decode_payload, parse_readings, reading_quality, readings_in_window, sliding_summary, window_alerts, lab_clean, lab_rollup, lab_quality, day_summary,
        vitals_trend, risk_report, risk_reasons, report_rows, report_markdown, report_consolidated, risk_counts, labs_effect, run_stats, report_validation, latest_reading, ward_patients,
        ward_snapshot, patient_detail, alert_list, report_list, readings_per_file, pending_files, completeness_gate, ingest_stats, pipeline_metrics, rule_eval,
        health_status, run_alerts, exposition, alert_sync, sustained_breach, series_gaps, absent_series, lab_csv_scan, lab_file_catalog,
        report_order, ward_order, pipeline_alerts, latest_report, master_range, quarantine, run_audit, window_counts, lab_drop_listing, alerts_by_batches, alerts_by_arrival, stream_sliding_summary, stream_raw_append, stream_alerts, stream_late_windows, late_correction, stream_progress,
    )
} | {"alert_episodes": lambda spark, sf: plain(alert_episodes(spark, sf))}
