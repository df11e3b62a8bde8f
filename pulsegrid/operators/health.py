"""Pipeline health: metrics from tables, rules as data, and the life of an alert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.serving import age_seconds, since

# Names of the metrics and what they tell.
METRIC_HELP = {
    "vitals_last_ingest_age_seconds": "Seconds since the newest raw reading was stored",
    "vitals_last_event_lag_seconds": "Ingest time minus event time of the newest reading (end-to-end latency)",
    "vitals_readings_5m": "Raw readings stored in the last 5 minutes",
    "vitals_abnormal_ratio_5m": "Share of abnormal readings in the last 5 minutes",
    "active_patients_2m": "Patients with at least one reading in the last 2 minutes",
    "live_summary_last_update_age_seconds": "Seconds since vitals_live_summary was last upserted",
    "speed_layer_heartbeat_age_seconds": "Seconds since the speed-layer driver last reported",
    "speed_layer_rejected_ratio": "Share of consumed readings rejected by data-quality rules",
    "speed_layer_input_rows_per_second": "Kafka input rate of the raw query (last micro-batch)",
    "patient_alerts_active": "Patient alert episodes updated in the last 2 minutes",
    "patient_alerts_24h": "Patient alert episodes opened in the last 24 hours",
    "batch_runs_success_30m": "Successful batch-layer runs in the last 30 minutes",
    "batch_runs_failed_30m": "Failed batch-layer runs in the last 30 minutes",
    "batch_failure_ratio_30m": "Failed / finished batch runs in the last 30 minutes",
    "batch_last_success_age_seconds": "Seconds since the last successful batch run",
    "batch_last_duration_seconds": "Duration of the last finished batch run",
    "lab_feed_last_file_age_seconds": "Seconds since the newest lab results file was dropped",
    "lab_files_pending": "Lab files older than the grace period without a successful batch run",
    "pipeline_alerts_open": "Open pipeline-health alerts",
}
RULE_HELP = "1 if the health-check rule is currently breached"


def reading_metrics(readings: DataFrame, as_of: Column, recent_seconds: int, active_seconds: int, newest: Column | None = None) -> DataFrame:
    """One row: age of the newest reading, lag of its event, counts and abnormal share of the recent past.

    newest: when the newest reading was stored; then nothing before it and before the recent past is read.
    """
    recent = since("ingested_at", as_of, recent_seconds)
    if newest is not None:
        wide = F.lit(max(recent_seconds, active_seconds)).cast("decimal(18,6)")
        readings = readings.filter(F.col("ingested_at") >= F.least(newest, as_of - F.make_dt_interval(secs=wide)))
    last = F.max("ingested_at")
    return readings.agg(
        age_seconds(last, as_of).alias("vitals_last_ingest_age_seconds"),
        F.max_by((F.unix_micros("ingested_at") - F.unix_micros("event_time")) / 1_000_000.0, F.struct("ingested_at", "event_time")).alias("vitals_last_event_lag_seconds"),
        F.count_if(recent).cast("double").alias("vitals_readings_5m"),
        F.avg(F.when(recent, F.col("is_abnormal").cast("int"))).alias("vitals_abnormal_ratio_5m"),
        F.count_distinct(F.when(since("ingested_at", as_of, active_seconds), F.col("patient_id"))).cast("double").alias("active_patients_2m"),
    )


def window_metrics(windows: DataFrame, as_of: Column, at: str = "computed_at") -> DataFrame:
    return windows.agg(age_seconds(F.max(at), as_of).alias("live_summary_last_update_age_seconds"))


def heartbeat_metrics(progress: DataFrame, as_of: Column) -> DataFrame:
    """From the latest progress record: its age, the share of rejected readings, the input rate. details: a struct."""
    last = progress.agg(F.max_by(F.struct("beat_at", "details"), F.struct("beat_at")).alias("p"))
    seen = F.col("p.details.readings_in")
    return last.select(
        age_seconds(F.col("p.beat_at"), as_of).alias("speed_layer_heartbeat_age_seconds"),
        F.when(seen > 0, F.col("p.details.rejected") / seen).alias("speed_layer_rejected_ratio"),
        F.col("p.details.input_rate").cast("double").alias("speed_layer_input_rows_per_second"),
    )


def alert_metrics(episodes: DataFrame, as_of: Column, active_seconds: int, opened_seconds: int) -> DataFrame:
    """Active alerts and those that opened lately. Episodes of windows that end after the earlier of both times suffice.

    One that is cut there was open before, and counts as active alike.
    """
    return episodes.agg(
        F.count_if(since("last_window_end", as_of, active_seconds)).cast("double").alias("patient_alerts_active"),
        F.count_if(since("first_window_start", as_of, opened_seconds)).cast("double").alias("patient_alerts_24h"),
    )


def open_alert_metrics(alerts: DataFrame) -> DataFrame:
    """alerts of the pipeline (resolved_at is null while they are open)."""
    return alerts.agg(F.count_if(F.col("resolved_at").isNull()).cast("double").alias("pipeline_alerts_open"))


def run_alerts(runs: DataFrame, key: str = "task") -> DataFrame:
    """Alerts of tasks: a failed run opens one, further failures are seen in it, the next successful run resolves it.

    runs: key, run_id, status, finished_at, error, in any order. Key of an alert: name, opened_at.
    """
    failed, ok = F.col("status") == "failed", F.col("status") == "success"
    done = runs.filter((failed | ok) & F.col("finished_at").isNotNull())
    before = Window.partitionBy(key).orderBy("finished_at", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    rounds = done.withColumn("_round", F.coalesce(F.sum(ok.cast("int")).over(before), F.lit(0)))
    said = F.concat(F.lit("task "), F.col(key), F.lit(" failed (run "), F.col("run_id").cast("string"), F.lit("): "), F.coalesce("error", F.lit("")))
    found = rounds.groupBy(key, "_round").agg(
        F.count_if(failed).alias("failures"),
        F.min(F.when(failed, F.col("finished_at"))).alias("opened_at"),
        F.max(F.when(failed, F.col("finished_at"))).alias("_last"),
        F.max(F.when(ok, F.col("finished_at"))).alias("resolved_at"),
        F.max_by(F.substring(said, 1, 2000), F.when(failed, F.struct("finished_at", "run_id"))).alias("message"),
    )
    found = found.filter("failures > 0")
    return found.select(F.concat(F.lit("task:"), F.col(key)).alias("name"), F.lit("critical").alias("severity"), "failures", "opened_at", F.coalesce("resolved_at", "_last").alias("last_seen_at"), "resolved_at", "message")


def run_metrics(runs: DataFrame, as_of: Column, recent_seconds: int) -> DataFrame:
    """Successes and failures among runs that started lately, their ratio (0 if none ended), age of the last success, duration of the last finished run."""
    recent = since("started_at", as_of, recent_seconds)
    ok, bad = F.count_if(recent & (F.col("status") == "success")), F.count_if(recent & (F.col("status") == "failed"))
    finished = F.when(F.col("finished_at").isNotNull(), F.struct("finished_at", "run_id"))
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000.0
    return runs.agg(
        ok.cast("double").alias("batch_runs_success_30m"),
        bad.cast("double").alias("batch_runs_failed_30m"),
        F.coalesce(F.try_divide(bad, ok + bad), F.lit(0.0)).alias("batch_failure_ratio_30m"),
        age_seconds(F.max(F.when(F.col("status") == "success", F.col("finished_at"))), as_of).alias("batch_last_success_age_seconds"),
        F.max_by(took, finished).alias("batch_last_duration_seconds"),
    )


def file_metrics(files: DataFrame, waiting: DataFrame, as_of_epoch: Column) -> DataFrame:
    newest = files.agg((as_of_epoch - F.max("epoch")).cast("double").alias("lab_feed_last_file_age_seconds"))
    return newest.join(F.broadcast(waiting.agg(F.count("*").cast("double").alias("lab_files_pending"))))  # one row each


def unpivoted(*facts: DataFrame) -> DataFrame:
    """One-row tables as rows (metric, value)."""
    out = None
    for row in facts:
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))
        part = row.select(F.inline(pairs))
        out = part if out is None else out.unionByName(part)
    return out


def general(value: Column) -> Column:
    """A number with six significant digits, without trailing zeros, with an exponent where that is shorter: 0.5, 216000, 1e+06."""
    said = F.format_string("%.5e", value)
    power = F.split_part(said, F.lit("e"), F.lit(2)).try_cast("int")
    short = lambda text: F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    bare = lambda text: F.regexp_replace(F.when(F.contains(text, F.lit(".")), short(text)).otherwise(text), r"\.$", "")
    out = F.concat(bare(F.split_part(said, F.lit("e"), F.lit(1))), F.lit("e"), F.split_part(said, F.lit("e"), F.lit(2)))
    for p in range(-4, 6):
        out = F.when(power == p, bare(F.format_string(f"%.{5 - p}f", value))).otherwise(out)
    return F.when(value == 0, "0").when(value.isNotNull(), out)


def _limit(rule: Callable[[str], Column], day_seconds: int) -> Column:
    return F.coalesce(rule("threshold_simulated_days") * day_seconds, rule("threshold").cast("double"))


def _breached(value: Column, rule: Callable[[str], Column], edge: Column) -> Column:
    op = rule("op")
    holds = F.when(op == ">", value > edge).when(op == ">=", value >= edge).when(op == "<", value < edge).when(op == "<=", value <= edge)
    return F.when(value.isNull(), F.coalesce(rule("on_missing") == "breach", F.lit(False))).otherwise(F.coalesce(holds, F.lit(False)))


def evaluate(metrics: DataFrame, rules: DataFrame, day_seconds: int) -> DataFrame:
    """Each rule (name, metric, op, threshold, threshold_simulated_days, on_missing, severity) with its value and breached.

    Rules are a configuration file, far smaller than data; metrics has one row for each metric.
    """
    rows = rules.withColumn("limit", _limit(F.col, day_seconds)).join(metrics, "metric", "left")
    value, edge = F.col("value"), F.col("limit")
    shown = F.when(value.isNull(), "no data").otherwise(F.format_string("%.2f", F.round(F.round(value, 6), 2)))
    message = F.concat(F.col("description"), F.lit(" (value="), shown, F.lit(", threshold="), general(edge), F.lit(")"))
    return rows.withColumns({"breached": _breached(value, F.col, edge), "message": message})


def overall(evaluated: DataFrame) -> DataFrame:
    """One row: critical, degraded or ok, and the number of breaches."""
    critical = F.bool_or(F.col("breached") & (F.col("severity") == "critical"))
    return evaluated.agg(
        F.when(critical, "critical").when(F.bool_or("breached"), "degraded").otherwise("ok").alias("status"),
        F.coalesce(critical, F.lit(False)).alias("has_critical"),
        F.count_if("breached").alias("breaches"),
    )


def sync(evaluated: DataFrame, opened: DataFrame, as_of: Column) -> DataFrame:
    """The next state of alerts: rule results (with message) against open alerts (name, opened_at, last_seen_at, message), at most one each.

    action: insert, refresh, resolve, or nothing; a rule that is gone leaves its alert as it is. An insert and a refresh
    take the result's message; an alert that resolves keeps its last one, and was last seen when it resolved.
    """
    rows = evaluated.select("name", "severity", "breached", "value", F.col("message").alias("_said")).join(opened, "name", "full_outer")
    is_open = F.col("opened_at").isNotNull()
    breached = F.col("breached")
    action = (
        F.when(breached & ~is_open, "insert").when(breached & is_open, "refresh").when(~breached & is_open, "resolve").otherwise("nothing")
    )
    rows = rows.withColumn("action", action)
    kept = F.col("action").isin("insert", "refresh")
    return rows.select(
        "name", "severity", "value", "action",
        F.coalesce("opened_at", F.when(kept, as_of)).alias("opened_at"),
        F.when(kept | (F.col("action") == "resolve"), as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(F.col("action") == "resolve", as_of).alias("resolved_at"),
        F.when(kept, F.col("_said")).otherwise(F.col("message")).alias("message"),
    )


def sustained(samples: DataFrame, hold_seconds: int) -> DataFrame:
    """samples (series, at, breached) with sustained: breached at every sample of the last hold_seconds, which history covers."""
    seconds = F.unix_timestamp("at")
    order = Window.partitionBy("series").orderBy("_s")
    rows = samples.withColumn("_s", seconds)
    every = F.min(F.col("breached").cast("int")).over(order.rangeBetween(-hold_seconds, 0)) == 1
    covers = F.col("_s") - F.min("_s").over(order) >= hold_seconds
    return rows.withColumn("sustained", every & covers).drop("_s")


def absent(expected: DataFrame, samples: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Series of expected (series) without a sample (series, at) in the last so many seconds."""
    recent = samples.filter(since("at", as_of, seconds)).select("series").distinct()
    return expected.join(recent, "series", "left_anti")


def gaps(expected: DataFrame, samples: DataFrame, start: Column, end: Column, seconds: int, tile_seconds: int = 86_400) -> DataFrame:
    """Stretches of over so many seconds from start to end in which a series of expected (series) has no sample (series, at).

    series, gap_from, gap_to, seconds; a series without any sample is one gap. What is known of a sample lasts until the
    next one, so a gap begins at a sample (or at start) and ends at the next (or at end).

    Samples are dealt by series and tile of time, so that one series is no single task; of a tile only its first and last
    sample and those after a gap go on, which meet by series.
    """
    inside = samples.filter((F.col("at") >= start) & (F.col("at") < end)).select("series", "at")
    ends = expected.select("series").distinct().withColumn("at", end)
    tile = F.floor(F.unix_micros("at") / F.lit(1_000_000 * tile_seconds))
    inside = inside.join(ends.select("series"), "series", "left_semi").unionByName(ends).withColumn("_tile", tile)
    near = Window.partitionBy("series", "_tile").orderBy("at")
    lasted = lambda since: (F.unix_micros("at") - F.unix_micros(since)) / 1_000_000.0
    rows = inside.withColumns({"_before": F.lag("at").over(near), "_after": F.lead("at").over(near)})
    rows = rows.filter(F.col("_before").isNull() | F.col("_after").isNull() | (lasted("_before") > seconds))
    # the first sample of a tile comes before others of its time, so that it follows the last one of an earlier tile
    far = F.lag("at").over(Window.partitionBy("series").orderBy("at", F.asc_nulls_first("_before")))
    rows = rows.withColumn("gap_from", F.coalesce("_before", far, start)).withColumn("seconds", lasted("gap_from"))
    return rows.select("series", "gap_from", F.col("at").alias("gap_to"), "seconds").filter(F.col("seconds") > seconds)


def by_status(alerts: DataFrame, status: str = "all", limit: int | None = None) -> DataFrame:
    """Alerts (opened_at, resolved_at): open, resolved, or all; newest first."""
    wanted = {"open": F.col("resolved_at").isNull(), "resolved": F.col("resolved_at").isNotNull(), "all": F.lit(True)}[status]
    rows = alerts.filter(F.col("opened_at").isNotNull() & wanted).orderBy(F.desc("opened_at"), "name")
    return rows.limit(limit) if limit else rows


def plain_number(value: Column) -> Column:
    """A number with the fewest digits that tell it from others, with a point; an exponent only below 0.0001 and from 1e16 on: 60.0, 12345678.0, 1e-05."""
    said, size = value.cast("string"), F.abs(value)
    spread = F.regexp_replace(said.try_cast("decimal(38,22)").cast("string"), r"0+$", "")
    wide = F.regexp_replace(said.try_cast("decimal(38,12)").cast("string"), r"0+$", "")
    pointed = lambda text: F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)
    power = F.split_part(said, F.lit("E"), F.lit(2)).try_cast("int")
    exponent = F.concat(F.regexp_replace(F.split_part(said, F.lit("E"), F.lit(1)), r"\.0$", ""), F.lit("e"), F.format_string("%+03d", power))
    return (
        F.when(value.isNull(), "NaN").when((size >= 1e7) & (size < 1e16), pointed(wide)).when((size < 1e-3) & (size >= 1e-4), spread).when(power.isNotNull(), exponent).otherwise(said)
    )


def exposition(metrics: DataFrame, rules: DataFrame, day_seconds: int, prefix: str = "pipeline_") -> DataFrame:
    """Metrics, then rule states, in the text format of monitoring systems, as rows (place, text): NaN where there is no data.

    metrics is read once: the rules of each metric, a list of configuration, stand beside it, and its lines and theirs
    are made from one row.
    """
    name = F.concat(F.lit(prefix), F.col("metric"))
    texts = F.create_map(*(F.lit(x) for pair in METRIC_HELP.items() for x in pair))
    said = F.coalesce(F.try_element_at(texts, F.col("metric")), F.col("metric"))
    line = lambda part, of, text: F.struct(F.struct(F.lit(part).alias("part"), of.alias("of")).alias("place"), text.alias("text"))
    about = F.concat(F.lit("# HELP "), name, F.lit(" "), said, F.lit("\n# TYPE "), name, F.lit(" gauge\n"), name, F.lit(" "), plain_number(F.col("value")))
    title = f"{prefix}health_rule_breached"

    def state(rule: Column) -> Column:
        of = lambda field: rule[field]
        breached = _breached(F.col("value"), of, _limit(of, day_seconds)).cast("int").cast("string")
        return line(2, rule["name"], F.concat(F.lit(f'{title}{{rule="'), rule["name"], F.lit('"} '), breached))

    grouped = rules.groupBy("metric").agg(F.collect_list(F.struct(*rules.columns)).alias("rules"), F.lit(True).alias("ruled"))
    rows = metrics.withColumn("known", F.lit(True)).join(grouped, "metric", "full_outer")
    states = F.transform(F.coalesce("rules", F.array()), state)
    lines = rows.select(F.explode(F.concat(F.when(F.col("known"), F.array(line(0, F.col("metric"), about))).otherwise(F.array()), states)).alias("line")).select("line.*")
    heading = rules.limit(1).select(line(1, F.lit(""), F.lit(f"# HELP {title} {RULE_HELP}\n# TYPE {title} gauge")).alias("line")).select("line.*")
    return lines.unionByName(heading).orderBy("place")
