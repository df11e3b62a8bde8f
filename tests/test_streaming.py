"""Sinks, replay, late data and progress of the live path."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pulsegrid.operators import episodes, ingest
from pulsegrid.plans import queries
from pulsegrid.settings import DEFAULT
from pulsegrid.sources import adapters, layout, readers
from pulsegrid.streaming import live, progress, replay, sinks

AT = datetime(2024, 1, 1, tzinfo=UTC)


def plan_of(df) -> str:  # noqa: ANN001
    return df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def rows_of(df):  # noqa: ANN001, ANN201
    return sorted(map(str, df.drop("computed_at", "batch_id").collect()))


def test_sinks_are_idempotent(spark, sf_dir, tmp_path) -> None:  # noqa: ANN001
    judged = ingest.judge(adapters.readings(spark, sf_dir))
    first, second = judged.filter("kafka_offset < 600"), judged.filter("kafka_offset >= 400")  # 200 readings come twice
    path, bad = f"{tmp_path}/master", f"{tmp_path}/bad"
    for batch_id, batch in ((0, first), (1, second)):
        sinks.append_readings(batch, batch_id, path, bad)
    once = rows_of(readers.master(spark, path))
    for batch_id, batch in ((1, second), (0, first), (1, second)):  # replays
        sinks.append_readings(batch, batch_id, path, bad)
        assert rows_of(readers.master(spark, path)) == once
    assert len(once) == judged.filter("is_valid").count()
    assert spark.read.parquet(bad).select("kafka_offset").distinct().count() == judged.filter(~F.col("is_valid")).count()
    start, end = (F.timestamp_seconds(F.lit(adapters.EPOCH + d * 86_400)) for d in (1, 2))
    part = readers.master(spark, path, start, end)
    assert 0 < part.count() < len(once)
    assert {f.split("event_date=")[1][:10] for f in part.inputFiles()} <= {"2024-01-02", "2024-01-03"}
    # compacted, run twice, and a batch replayed that the compaction holds
    for _ in range(2):
        sinks.compact_master(spark, path, 1)
        assert rows_of(readers.master(spark, path)) == once
        assert all("part=c-000000000001" in f for f in readers.master(spark, path).inputFiles())
    sinks.append_readings(first, 0, path)
    sinks.append_readings(judged.filter("kafka_offset >= 900"), 2, path)
    assert rows_of(readers.master(spark, path)) == once


def test_append_lists_the_dates_of_its_batch_only(spark, sf_dir, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    judged = ingest.judge(adapters.readings(spark, sf_dir))
    path, seen = f"{tmp_path}/master", []
    sinks.append_readings(judged, 0, path)
    one_day = judged.filter(F.to_date("event_time") == "2024-01-03")
    rows = one_day.filter("is_valid")
    listed = layout.folders
    monkeypatch.setattr(layout, "folders", lambda spark, folder, prefix: seen.append(folder) or listed(spark, folder, prefix))
    sinks.append_readings(one_day, 1, path)
    assert seen == [f"{path}/event_date=2024-01-03"]
    day = readers.master_table(path).read(spark, readers.READING, ["2024-01-03"], 1)
    assert day.inputFiles() and all("event_date=2024-01-03" in f for f in day.inputFiles())
    held = sinks.held_keys(day, rows, 3, 900, 40)
    plan = plan_of(held)
    assert "GreaterThanOrEqual(kafka_offset,3)" in plan and "LessThanOrEqual(kafka_offset,900)" in plan
    # the master isn't exchanged: keys of the batch go to it; a large batch is joined by an exchange
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert held.count() == rows.filter("kafka_offset between 3 and 900").count() > 0
    assert readers.master(spark, path).count() == judged.filter("is_valid").count()
    monkeypatch.setattr(sinks, "MOST_BROADCAST", 0)
    sinks.append_readings(one_day, 2, path)
    assert readers.master(spark, path).count() == judged.filter("is_valid").count()
    sinks.append_readings(judged.limit(0), 3, path)


def test_windows_after_compaction(spark, tmp_path) -> None:  # noqa: ANN001
    path = f"{tmp_path}/windows"

    def batch(n: int, starts: range):  # noqa: ANN202
        rows = [(f"P{100 + s % 3}", AT + timedelta(hours=8 * s), AT + timedelta(hours=8 * s + 24), float(n), 1.0, 1.0, n, n + 1, 1, 1, 1.0, 1.0) for s in starts]
        kind = "patient_id string, window_start timestamp, window_end timestamp, avg_heart_rate double, avg_spo2 double, avg_temperature double, abnormal_count long, total_readings long, max_heart_rate int, min_heart_rate int, min_spo2 double, max_temperature double"
        sinks.upsert_windows(spark.createDataFrame(rows, kind), n, path)

    for n, starts in enumerate((range(0, 9), range(3, 12), range(6, 15), range(0, 3))):
        batch(n, starts)
    view = rows_of(sinks.current_windows(spark, path))
    assert len(view) == 15
    stored = lambda: sinks.window_table(path).read(spark, sinks.WINDOW).count()
    assert stored() == 30
    for _ in range(2):
        sinks.compact_windows(spark, path, 2)  # batch 3 hasn't ended
        assert rows_of(sinks.current_windows(spark, path)) == view and stored() == 15 + 3
    batch(3, range(0, 3))  # replayed
    assert rows_of(sinks.current_windows(spark, path)) == view
    sinks.compact_windows(spark, path, 3)
    assert rows_of(sinks.current_windows(spark, path)) == view and stored() == 15  # one version for each window
    day = sinks.current_windows(spark, path, ["2024-01-02"])
    assert day.count() == 3 and all("event_date=2024-01-02" in f for f in day.inputFiles())


def test_a_compaction_cut_short_changes_nothing(spark, tmp_path) -> None:  # noqa: ANN001
    """What a compaction has replaced is not read, whether or not it could be removed."""
    table = layout.BatchTable(f"{tmp_path}/t", "day")
    schema = spark.createDataFrame([], "x int, day int").schema
    for n in range(3):
        table.write(spark.createDataFrame([(n, 1), (n, 2)], schema), n)
    rows = lambda: sorted(map(tuple, table.read(spark, schema).collect()))
    before = rows()
    table._put(table.read(spark, schema, before=2), "c-000000000001")  # written, old parts still there
    assert rows() == before
    table.compact(spark, schema, 1)
    assert rows() == before and layout.folders(spark, f"{tmp_path}/t/day=1", "part=") == ["b-000000000002", "c-000000000001"]
    assert sorted(map(tuple, table.read(spark, schema, ["2"], before=2).collect())) == [(0, 2), (1, 2)]
    assert table.read(spark, schema, ["9"]).count() == 0


# ---- alerts by batches -----------------------------------------------------------------------------------------------

KIND = "patient_id string, window_start timestamp, window_end timestamp, severity string, reasons array<struct<code string, value double>>, max_heart_rate int, min_heart_rate int, min_spo2 double, max_temperature double"


def observations(rng: random.Random, patients: range, n: int) -> list[tuple]:
    out = []
    for _ in range(n):
        s = rng.randint(0, 40)
        start = AT + timedelta(seconds=10 * s)
        rate = rng.randint(40, 160)
        out.append((f"P{rng.choice(patients)}", start, start + timedelta(seconds=30), rng.choice(["warning", "critical"]), [("heart_rate_high", float(rate))], rate, rate - 5, 90.0 + s / 10, 36.0 + s / 10))
    return list({(x[0], x[1]): x for x in out}.values())  # one emission for each window of a batch


def test_merged_alerts_equal_the_whole_log(spark, tmp_path) -> None:  # noqa: ANN001
    """Out of order, bridging, replayed, compacted in between."""
    rng, path, log = random.Random(6), f"{tmp_path}/alerts", []
    batches = [observations(rng, range(100, 112), 12) for _ in range(7)]
    batches[6] = [x for x in observations(rng, range(100, 112), 200) if x[0] < "P104"]  # bridges nearly all gaps of four patients
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, KIND)
        sinks.merge_alerts(batch, n, path, 8)
        if n in (2, 5):
            sinks.merge_alerts(batch, n, path, 8)  # replayed
        log += [(*r, n) for r in rows]
        if n == 3:
            sinks.compact_alerts(spark, path, 2)
        if n in (1, 4, 6):
            want = episodes.episodes(spark.createDataFrame(log, KIND + ", batch_id long"))
            got = sinks.current_alerts(spark, path)
            assert rows_of(got.select(*want.columns)) == rows_of(want), n
    for _ in range(2):
        sinks.compact_alerts(spark, path, 6)
        assert rows_of(sinks.current_alerts(spark, path).select(*want.columns)) == rows_of(want)
    assert sinks.alert_table(path).read(spark, sinks.ALERT).filter("gone").count() == 0
    sinks.merge_alerts(spark.createDataFrame([], KIND), 7, path, 8)


def test_a_merge_reads_and_writes_its_patients_only(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    rng, path = random.Random(7), f"{tmp_path}/alerts"
    sinks.merge_alerts(spark.createDataFrame(observations(rng, range(100, 160), 300), KIND), 0, path, 16)
    batch = spark.createDataFrame([x for x in observations(rng, range(100, 101), 20)], KIND)
    seen: list[str] = []
    listed = layout.folders
    monkeypatch.setattr(layout, "folders", lambda spark, folder, prefix: seen.append(folder) or listed(spark, folder, prefix))
    sinks.merge_alerts(batch, 1, path, 16)
    bucket = batch.select(F.pmod(F.xxhash64("patient_id"), F.lit(16))).first()[0]
    assert seen == [f"{path}/bucket={bucket}"]
    written = spark.read.parquet(f"{path}/bucket={bucket}/part=b-000000000001")
    assert {r.patient_id for r in written.collect()} == {"P100"}
    held = sinks.alert_table(path).read(spark, sinks.ALERT, [str(bucket)], 1)
    plan = plan_of(sinks.reaching(held, batch, AT, AT + timedelta(seconds=60), 1))
    assert "GreaterThanOrEqual(last_window_end" in plan and "LessThanOrEqual(first_window_start" in plan and "BroadcastHashJoin" in plan


def by_arrival(rows: list[tuple]) -> list[tuple]:
    """One observation after the other: extend the newest episode if it reaches the start, else open one."""
    out: dict[str, list[list]] = {}
    for patient, start, end, severity, reasons, high, low, spo2, temperature, _ in sorted(rows, key=lambda r: (r[-1], r[1], r[2])):
        own = out.setdefault(patient, [])
        best = max((e for e in own if e[1] >= start), key=lambda e: e[1], default=None)
        if best is None:
            own.append([start, end, severity, 1, reasons, high, low, spo2, temperature])
            continue
        best[3] += end > best[1]
        best[1] = max(best[1], end)
        if severity == "critical" or best[2] == "warning":
            best[4] = reasons
        best[2] = "critical" if "critical" in (severity, best[2]) else "warning"
        best[5:] = max(best[5], high), min(best[6], low), min(best[7], spo2), max(best[8], temperature)
    return sorted((p, *e[:4], e[4][0][1], *e[5:]) for p, es in out.items() for e in es)


def test_arrival_episodes_equal_a_fold(spark) -> None:  # noqa: ANN001
    rng = random.Random(8)
    log = [(*r, n) for n in range(8) for r in observations(rng, range(100, 130), 60)]
    got = episodes.arrival_episodes(spark.createDataFrame(log, KIND + ", batch_id long")).collect()
    utc = lambda t: t.astimezone(UTC)
    assert sorted(
        (r.patient_id, utc(r.first_window_start), utc(r.last_window_end), r.severity, r.breaching_windows, r.reasons[0].value, r.max_heart_rate, r.min_heart_rate, r.min_spo2, r.max_temperature) for r in got
    ) == by_arrival(log)


def test_a_failing_query_stops_the_others(spark) -> None:  # noqa: ANN001
    stream = lambda: spark.readStream.format("rate").option("rowsPerSecond", 10).load()
    broken = stream().select(F.raise_error(F.lit("broken on purpose")).cast("string").alias("x")).writeStream.queryName("broken").format("noop").start()
    fine = stream().writeStream.queryName("fine").format("noop").start()
    with pytest.raises(StreamingQueryException):
        progress.run_until_any_ends(spark, [fine, broken], every_seconds=1)
    assert not fine.isActive and not broken.isActive


def test_report_replaces_its_file_only(spark, tmp_path) -> None:  # noqa: ANN001
    write = lambda rows: sinks.replace_report(spark.createDataFrame(rows, "x int, source_file string"), f"{tmp_path}/r")
    write([(1, "f"), (2, "f"), (3, "g")])
    write([(4, "f")])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/r").collect())) == [(3, "g"), (4, "f")]


def test_run_audit(spark, tmp_path) -> None:  # noqa: ANN001
    path = f"{tmp_path}/runs"
    sinks.append_run_event(spark, path, "r1", "f", "running", AT)
    sinks.append_run_event(spark, path, "r1", "f", "success", AT, rows_written=3, patients=2, high_risk=1)
    sinks.append_run_event(spark, path, "r2", "g", "failed", AT, error="x" * 5000)
    got = {r["run_id"]: r for r in sinks.runs(spark, path).collect()}
    assert (got["r1"]["status"], got["r1"]["rows_written"], len(got["r2"]["error"])) == ("success", 3, 2000)


def reading(patient: str, offset: int, seconds: int, rate: int = 80) -> tuple:
    at = AT + timedelta(seconds=seconds)
    body = f'{{"patient_id": "{patient}", "heart_rate": {rate}, "spo2": 98.0, "systolic_bp": 120, "diastolic_bp": 80, "temperature": 37.0, "timestamp": "{at.isoformat()}"}}'
    return (0, offset, at, body.encode())


def test_live_path_drops_late_readings_from_windows_only(spark, tmp_path) -> None:  # noqa: ANN001
    kind = "partition int, offset long, timestamp timestamp, value binary"
    schema = spark.createDataFrame([], kind).schema
    batches = [[reading("P101", 0, 0), reading("P101", 1, 5, 140)], [reading("P101", 2, 600)], [reading("P101", 3, 2), reading("P101", 4, 610)]]
    base, settings = str(tmp_path), replace(DEFAULT, times=replace(DEFAULT.times, watermark="30 seconds"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    for batch in batches:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{base}/in")
        for q in live.start(source, ingest.decode_json, base, settings, available_now=True):
            q.awaitTermination()
    assert readers.master(spark, f"{base}/master").count() == 5  # the late reading too
    windows = sinks.current_windows(spark, f"{base}/windows").filter(F.unix_seconds("window_start") == int(AT.timestamp())).first()
    assert windows["total_readings"] == 2  # without the late one
    assert sinks.breaches(spark, f"{base}/breaches").select("window_start").distinct().count() >= 1
    assert sinks.current_alerts(spark, f"{base}/alerts").count() >= 1


def test_progress_records() -> None:
    report = {"batchId": 3, "numInputRows": 10, "inputRowsPerSecond": 2.5, "durationMs": {"triggerExecution": 7}, "eventTime": {"watermark": "w"}, "stateOperators": [{"numRowsTotal": 4}, {"numRowsTotal": 5}], "observedMetrics": {"quality": {"rejected": 2}}}
    assert progress.details(report) == (3, 10, 2, 2.5, 7, "w", 9)
    assert progress.details({}) == (None, 0, 0, 0.0, 0, None, 0)


def test_beats_and_supervision(spark, tmp_path) -> None:  # noqa: ANN001
    beats = progress.Beats()
    spark.streams.addListener(beats)
    try:
        stream = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
        query = stream.writeStream.queryName("beat").format("noop").trigger(availableNow=True).start()
        progress.run_until_any_ends(spark, [query], beats, f"{tmp_path}/beats", 1)
        beats.take(query)
        beats.flush(spark, f"{tmp_path}/beats")
    finally:
        spark.streams.removeListener(beats)
    assert progress.heartbeats(spark, f"{tmp_path}/beats").first()["component"] == "beat"


def test_progress_table_of_batches(spark, tmp_path) -> None:  # noqa: ANN001
    """Of a batch that is reported more than once, the report with input counts; flushes append only what is new."""
    beats, path = progress.Beats(), f"{tmp_path}/beats"
    report = lambda n, rows, bad=0: {"batchId": n, "numInputRows": rows, "observedMetrics": {"quality": {"rejected": bad}}}
    for x in (report(0, 10, 2), report(0, 0), report(1, 7, 1)):
        beats.add("raw", x)
    beats.flush(spark, path)
    beats.flush(spark, path)
    beats.add("raw", report(1, 0))
    beats.add("raw", report(2, 4))
    beats.flush(spark, path)
    assert spark.read.parquet(path).count() == 4
    assert sorted((r.batch_id, r.details.readings_in, r.details.rejected) for r in progress.batches(spark, path).collect()) == [(0, 10, 2), (1, 7, 1), (2, 4, 0)]
    assert progress.heartbeats(spark, path).first()["details"]["batch_id"] == 2


def test_rate_limit_and_compaction_of_the_running_path(spark, tmp_path) -> None:  # noqa: ANN001
    """One file for each trigger gives a batch for each; compacting every second batch leaves all views as they are."""
    rng, kind = random.Random(9), "partition int, offset long, timestamp timestamp, value binary"
    rows = [[reading(f"P{rng.randint(100, 104)}", 20 * n + i, 300 * n + 15 * i, rng.choice([80, 140])) for i in range(20)] for n in range(5)]
    views = []
    for name, every in (("often", 2), ("never", 100)):
        base = f"{tmp_path}/{name}"
        for batch in rows:
            spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(f"{base}/records")
        replay.run(spark, base, spark.createDataFrame([], kind).schema, "30 seconds", "10 seconds", files=1, compact_every=every)
        views.append([rows_of(x) for x in (readers.master(spark, f"{base}/master"), sinks.current_windows(spark, f"{base}/windows"), sinks.current_alerts(spark, f"{base}/alerts"))])
        told = progress.batches(spark, f"{base}/progress").filter("component = 'raw' and details.readings_in > 0").collect()
        assert sorted((r.batch_id, r.details.readings_in) for r in told) == [(n, 20) for n in range(5)]
        parts = {f.split("part=")[1][0] for f in readers.master(spark, f"{base}/master").inputFiles()}
        assert parts == ({"b", "c"} if every == 2 else {"b"})
    assert views[0] == views[1] and all(views[0])


def test_drained_stream_equals_batch(spark, sf_dir) -> None:  # noqa: ANN001
    got = queries.QUERIES["stream_raw_append"](spark, sf_dir)
    assert got.count() == queries.valid(spark, sf_dir).count()


def test_a_turn_comes_in_several_files_and_one_batch(spark, sf_dir, tmp_path) -> None:  # noqa: ANN001
    records = queries.in_turns(spark, sf_dir).repartition(6)
    base = f"{tmp_path}/turns"
    replay.arrive(records, 0, base, adapters.WINDOW, adapters.SLIDE, "2 days")
    assert len(spark.read.parquet(f"{base}/records").inputFiles()) > 1
    beats = progress.batches(spark, f"{base}/progress").filter("component = 'raw' and details.readings_in > 0").collect()
    assert [(b["batch_id"], b["details"]["readings_in"]) for b in beats] == [(0, records.filter("turn = 0").count())]
    # buckets of alerts are dealt to several tasks
    written = sinks.alert_table(f"{base}/alerts").read(spark, sinks.ALERT).inputFiles()
    assert len({f.rsplit("/part-", 1)[1][:5] for f in written}) > 1


def test_more_files_make_no_more_batches(spark, sf_dir) -> None:  # noqa: ANN001
    records = queries.as_records(spark, sf_dir).filter("offset < 300").repartition(24)
    base = replay.drain(records, adapters.WINDOW, adapters.SLIDE)
    beats = progress.batches(spark, f"{base}/progress").filter("component = 'raw' and details.readings_in > 0").collect()
    assert len(beats) == replay.BATCHES and sum(b["details"]["readings_in"] for b in beats) == 300
