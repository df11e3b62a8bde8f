"""DuckDB SQL for the registered queries, written against the driver's tables and independent of the operators."""

from __future__ import annotations

from pulsegrid.operators.health import METRIC_HELP, RULE_HELP

EPOCH = "cast(1704067200 as bigint)"


def thousandths(value: str) -> str:
    return f"cast(round(round({value}, 6) * 1000) as bigint)"


def shown(value: str, digits: int, sign: str = "") -> str:
    """A number with so many decimals, as text."""
    return f"printf('%{sign}.{digits}f', round(round({value}, 6), {digits}) + 0.0::double)"


READINGS = """
e as (select event_id, user_id, event_type, ts, cast(json_extract_string(props, '$.k') as integer) as k from events),
readings as (
  select event_id % 4 as kafka_partition, event_id as kafka_offset, 'P' || (100 + user_id) as patient_id,
         case when event_type = 'signup' and k % 10 = 0 then 999
              when event_type = 'signup' and k % 10 = 1 then null
              when event_type = 'error' and k < 50 and k % 2 = 0 then 40 + k % 16
              when event_type = 'error' and k < 50 then 120 + k % 41
              else 60 + k % 41 end as heart_rate,
         case when event_type = 'error' and k < 50 then 80 + (k % 101) / 10 else 95 + (k % 51) / 10 end as spo2,
         case when event_type = 'view' and k = 7 then 60 else 100 + k % 31 end as systolic_bp,
         65 + k % 21 as diastolic_bp,
         case when event_type = 'error' and k < 50 then cast(38.5 as double) + (k % 16) / 10 else cast(36.1 as double) + (k % 12) / 10 end as temperature,
         ts as event_time, ts + interval 2 second as ingested_at
  from e
),
judged as (
  select *, coalesce(regexp_matches(patient_id, '^P\\d{3,}$') and heart_rate between 20 and 250 and spo2 between 50 and 100
                     and temperature between 30 and 45 and systolic_bp between 30 and 260 and diastolic_bp between 30 and 260
                     and systolic_bp > diastolic_bp, false) as is_valid,
         coalesce(heart_rate < 60 or heart_rate > 100 or spo2 < 95 or temperature > 37.5::double, false) as is_abnormal
  from readings
),
valid as (select * from judged where is_valid),
now as (select max(ts) as t from events)
"""

WINDOWS = (
    READINGS
    + f""",
spread as (
  select *, (epoch_us(event_time) // 28800000000 - j) * 28800000000 as ws from valid, (values (0), (1), (2)) as s(j)
),
summary as (
  select patient_id, ws as window_start, ws + 86400000000 as window_end, avg(heart_rate) as avg_heart_rate, avg(spo2) as avg_spo2,
         avg(temperature) as avg_temperature, count(*) filter (where is_abnormal) as abnormal_count, count(*) as total_readings,
         max(heart_rate) as max_heart_rate, min(heart_rate) as min_heart_rate, min(spo2) as min_spo2, max(temperature) as max_temperature
  from spread group by patient_id, ws
),
alerts as (
  select *, case when critical <> '' then 'critical' else 'warning' end as severity,
         case when critical <> '' then critical else 'abnormal_readings=' || abnormal_count * 1000 end as reasons
  from (select *, concat_ws(',', case when avg_spo2 < 90 then 'spo2_low=' || {thousandths("avg_spo2")} end, case when avg_heart_rate < 50 then 'heart_rate_low=' || {thousandths("avg_heart_rate")} end,
                   case when avg_heart_rate > 130 then 'heart_rate_high=' || {thousandths("avg_heart_rate")} end, case when avg_temperature >= 39 then 'temperature_high=' || {thousandths("avg_temperature")} end) as critical
        from summary)
  where critical <> '' or abnormal_count > 0
)
"""
)

EPISODES = (
    WINDOWS
    + """,
reached as (
  select *, max(window_end) over (partition by patient_id order by window_start, window_end rows between unbounded preceding and 1 preceding) as reach from alerts
),
numbered as (
  select *, sum(case when reach is null or window_start > reach then 1 else 0 end) over (partition by patient_id order by window_start, window_end rows unbounded preceding) as n
  from reached
),
episodes as (
  select patient_id, min(window_start) as first_window_start, max(window_end) as last_window_end,
         case when bool_or(severity = 'critical') then 'critical' else 'warning' end as severity,
         count(distinct window_end) as breaching_windows,
         arg_max(reasons, case when severity = 'critical' then 1 else 0 end * 10000000000000000 + window_start) as reasons,
         max(max_heart_rate) as max_heart_rate, min(min_heart_rate) as min_heart_rate, min(min_spo2) as min_spo2, max(max_temperature) as max_temperature
  from numbered group by patient_id, n
)
"""
)

LABS = f"""
people as (select cast(floor((max(user_id) + 1) * 4 / 3) as bigint) as m from events),
labs_raw as (
  select 'lab_results_day' || day || '_' || ({EPOCH} + day * 864000) || '.csv' as source_file, {EPOCH} + day * 864000 as epoch,
         case when key % 4 = 0 then ' p' || (100 + o_custkey % m) || ' ' when key % 26 = 0 then 'BAD' else 'P' || (100 + o_custkey % m) end as patient_id,
         substr(o_orderpriority, 3) as test_type,
         case when key % 14 = 0 then null else o_totalprice end as result_value,
         key % 22 <> 0 as ranged,
         case when key % 9 = 0 then null else epoch_us(o_orderdate) end as collected_at
  from (select *, o_orderkey as key, 1 + o_orderkey % 3 as day from orders), people
),
lab_lines as (
  select source_file, upper(trim(patient_id)) as patient_id, test_type, round(result_value, 2) as result_value, collected_at,
         row_number() over (partition by source_file, upper(trim(patient_id)), test_type order by collected_at desc nulls last, result_value desc) as place
  from labs_raw where patient_id <> 'BAD' and result_value is not null and ranged
),
labs as (
  select source_file, patient_id, test_type, result_value, collected_at, '30000-450000 u' as reference_range, cast(30000 as double) as ref_low, cast(450000 as double) as ref_high,
         not (result_value between 30000 and 450000) as lab_abnormal
  from lab_lines where place = 1
),
rolled as (
  select *, sum(lab_abnormal::int) over (partition by source_file, patient_id) as abnormal_labs,
         coalesce(list_aggregate(list_sort(list_distinct(list(test_type) filter (where lab_abnormal) over (partition by source_file, patient_id))), 'string_agg', ','), '') as abnormal_tests
  from labs
),
periods as (select distinct source_file, epoch from labs_raw)
"""

FIELDS = (
    "report_day", "run_id", "window_start", "window_end", "generated_at", "risk_flag", "vitals_only_risk", "risk_changed_by_labs", "vitals_concerning", "total_readings",
    "vitals_abnormal_count", "abnormal_ratio", "avg_heart_rate", "avg_spo2", "avg_temperature", "min_spo2", "max_heart_rate", "hr_trend_bpm_per_min", "spo2_trend_pct_per_min",
    "patient_abnormal_lab_count", "risk_reasons",
)
REPORT = (
    READINGS
    + ","
    + LABS
    + f""",
per_file as (
  select p.source_file, p.epoch, v.* from valid v, periods p
  where epoch_us(v.event_time) >= (p.epoch - 864000) * 1000000 and epoch_us(v.event_time) < p.epoch * 1000000
),
day as (
  select source_file, patient_id, count(*) as total_readings, count(*) filter (where is_abnormal) as abnormal_readings, avg(heart_rate) as avg_heart_rate,
         avg(spo2) as avg_spo2, avg(temperature) as avg_temperature, min(spo2) as min_spo2, max(heart_rate) as max_heart_rate,
         regr_slope(heart_rate, (epoch_us(event_time) - (epoch - 864000) * 1000000) / 60000000.0::double) as heart_rate_trend,
         regr_slope(spo2, (epoch_us(event_time) - (epoch - 864000) * 1000000) / 60000000.0::double) as spo2_trend,
         count(*) filter (where is_abnormal) / count(*) as abnormal_ratio
  from per_file group by source_file, patient_id
),
joined as (
  select coalesce(d.source_file, l.source_file) as source_file, coalesce(d.patient_id, l.patient_id) as patient_id, test_type, result_value,
         coalesce(total_readings, 0) as total_readings, coalesce(abnormal_readings, 0) as abnormal_readings, coalesce(abnormal_labs, 0) as abnormal_labs, abnormal_ratio,
         avg_heart_rate, avg_spo2, avg_temperature, min_spo2, max_heart_rate, heart_rate_trend, spo2_trend, reference_range, collected_at, lab_abnormal, abnormal_tests
  from day d full join rolled l on d.source_file = l.source_file and d.patient_id = l.patient_id
),
flagged as (
  select *, coalesce(total_readings > 0 and (abnormal_ratio >= 0.2::double or avg_heart_rate < 60 or avg_heart_rate > 100 or avg_spo2 < 95 or avg_temperature > 37.5::double), false) as vitals_concerning
  from joined
),
report as (
  select *, case when vitals_concerning then 'elevated_vitals' else 'normal' end as risk_before_labs,
         case when vitals_concerning and abnormal_labs > 0 then 'high' when vitals_concerning then 'elevated_vitals' when abnormal_labs > 0 then 'elevated_labs' else 'normal' end as risk_after_labs
  from flagged
),
said as (
  select *, concat_ws('; ', case when total_readings = 0 then 'no vitals received in window' end,
      case when abnormal_ratio >= 0.2::double then {shown("abnormal_ratio * 100", 0)} || '% of ' || total_readings || ' readings abnormal' end,
      case when avg_spo2 < 95 then 'avg SpO2 ' || {shown("avg_spo2", 1)} || '%' end,
      case when avg_heart_rate > 100 or avg_heart_rate < 60 then 'avg HR ' || {shown("avg_heart_rate", 0)} || ' bpm' end,
      case when avg_temperature > 37.5::double then 'avg temp ' || {shown("avg_temperature", 1)} || 'C' end,
      case when abnormal_labs > 0 then 'abnormal labs: ' || replace(abnormal_tests, ',', ', ') end) as risk_text
  from report
),
kept as (
  select cast(regexp_extract(source_file, 'day(\\d+)', 1) as bigint) as report_day, patient_id, avg_heart_rate, avg_spo2, abnormal_readings as vitals_abnormal_count, test_type as lab_test_type,
         result_value as lab_result_value, lab_abnormal, risk_after_labs as risk_flag, epoch * 1000000 as generated_at, source_file, 'run-' || epoch as run_id,
         (epoch - 864000) * 1000000 as window_start, epoch * 1000000 as window_end, total_readings, abnormal_ratio, avg_temperature, min_spo2, max_heart_rate,
         heart_rate_trend as hr_trend_bpm_per_min, spo2_trend as spo2_trend_pct_per_min, reference_range as lab_reference_range, collected_at as lab_collected_at,
         cast(abnormal_labs as bigint) as patient_abnormal_lab_count, vitals_concerning, case when vitals_concerning then 'elevated' else 'normal' end as vitals_only_risk,
         abnormal_labs > 0 as risk_changed_by_labs, risk_text as risk_reasons
  from (select *, cast(regexp_extract(source_file, '_(\\d+)\\.csv', 1) as bigint) as epoch from said)
),
patients as (
  select source_file, patient_id, {", ".join(f"any_value({c}) as {c}" for c in FIELDS)},
         coalesce(string_agg(lab_test_type || '=' || cast(round(lab_result_value * 100) as bigint) || '/' || lab_reference_range || case when lab_abnormal then '!' else '' end,
                             ';' order by lab_test_type) filter (where lab_test_type is not null), '') as labs
  from kept group by source_file, patient_id
)
"""
)

FILES = """
drops as (
  select case when d % 604800 = 0 then 'notes_' || d || '.txt' else 'lab_results_day' || day(o_orderdate) || '_' || d || '.csv' end as file_name, d as epoch,
         day(o_orderdate) as day, d, count(*) as size
  from (select *, cast(epoch(o_orderdate) as bigint) as d from orders) group by all
),
files as (select file_name, day, epoch, size from drops where d % 604800 <> 0),
runs as (
  select o_orderkey as run_id, 'report_' || o_custkey as task, 'error in ' || o_orderpriority as error, 'lab_results_day' || day(o_orderdate) || '_' || d || '.csv' as source_file,
         case o_orderstatus when 'F' then 'failed' when 'P' then 'success' else 'running' end as status,
         d + o_orderkey % 3600 as started_at, case when o_orderstatus in ('F', 'P') then d + o_orderkey % 3600 + 5 + o_orderkey % 7 + o_custkey % 50 * 600 end as finished_at,
         case when o_orderstatus = 'P' then o_custkey % 40 end as rows_written
  from (select *, cast(epoch(o_orderdate) as bigint) as d from orders)
),
last as (select max(epoch) as t from files),
pending as (
  select file_name, day, epoch, t - epoch as age_seconds from files, last
  where file_name not in (select source_file from runs where status = 'success') and t - epoch between 86400 and 129600000
)
"""

WARD = (
    EPISODES.replace(READINGS, REPORT)
    + """,
ward as (
  select r.patient_id, epoch_us(r.event_time) as last_reading_at, r.heart_rate, r.spo2, r.systolic_bp, r.diastolic_bp, r.temperature, r.is_abnormal as last_reading_abnormal,
         w.window_start, w.window_end, w.avg_heart_rate, w.avg_spo2, w.avg_temperature, w.abnormal_count as window_abnormal_count, w.total_readings as window_readings,
         a.alert_id, a.severity as alert_severity, a.reasons as alert_reasons, k.risk_flag as latest_daily_risk, k.report_day as latest_report_day,
         greatest(0, (epoch_us(r.t) - epoch_us(r.event_time)) / 1000000.0::double) as seconds_since_last_reading
  from (select *, row_number() over (partition by patient_id order by event_time desc, kafka_offset desc) as p from valid, now where event_time > t - interval 5 day) r
  left join (select *, row_number() over (partition by patient_id order by window_end desc) as p from summary, now where window_end > epoch_us(t) - 432000000000) w on w.patient_id = r.patient_id and w.p = 1
  left join (select *, patient_id || '-' || first_window_start // 1000000 as alert_id,
                    row_number() over (partition by patient_id order by severity = 'critical' desc, last_window_end desc, first_window_start desc) as p
             from episodes, now where last_window_end > epoch_us(t) - 172800000000) a on a.patient_id = r.patient_id and a.p = 1
  left join (select *, row_number() over (partition by patient_id order by generated_at desc, source_file desc) as p from patients) k on k.patient_id = r.patient_id and k.p = 1
  where r.p = 1
),
ward_status as (
  select *, coalesce(alert_severity, case when seconds_since_last_reading > 172800 then 'no_signal' else 'normal' end) as status, seconds_since_last_reading <= 172800 as monitored from ward
)
"""
)

METRICS = (
    EPISODES
    + ","
    + FILES
    + """,
ages as (
  select greatest(0, epoch_us(t) - epoch_us(max(ingested_at))) / 1000000.0::double as ingest, count(*) filter (where ingested_at > t - interval 5 day) as recent,
         avg(is_abnormal::int) filter (where ingested_at > t - interval 5 day) as share, count(distinct patient_id) filter (where ingested_at > t - interval 2 day) as people
  from valid, now group by t
),
beat as (
  select date_trunc('hour', ingested_at) as h, count(*) as n, count(*) filter (where not is_valid) as bad from judged group by 1 order by 1 desc limit 1
),
done as (
  select count(*) filter (where status = 'success' and started_at > t - 17280000) as ok, count(*) filter (where status = 'failed' and started_at > t - 17280000) as bad,
         greatest(0, t - max(finished_at) filter (where status = 'success')) as age,
         arg_max(finished_at - started_at, finished_at * 100000000 + run_id) filter (where finished_at is not null) as took
  from runs, last group by t
),
rounds as (
  select *, coalesce(sum(case when status = 'success' then 1 else 0 end) over (partition by task order by finished_at, run_id rows between unbounded preceding and 1 preceding), 0) as n
  from runs where finished_at is not null
),
run_alerts as (
  select 'task:' || task as name, 'critical' as severity, count(*) filter (where status = 'failed') as failures, min(finished_at) filter (where status = 'failed') as opened_at,
         coalesce(max(finished_at) filter (where status = 'success'), max(finished_at)) as last_seen_at, max(finished_at) filter (where status = 'success') as resolved_at,
         'task ' || task || ' failed (run ' || arg_max(run_id, finished_at * 100000000 + run_id) filter (where status = 'failed') || '): '
           || arg_max(error, finished_at * 100000000 + run_id) filter (where status = 'failed') as message
  from rounds group by task, n having count(*) filter (where status = 'failed') > 0
),
metrics as (
  select 'vitals_last_ingest_age_seconds' as metric, cast(ingest as double) as value from ages
  union all select 'vitals_last_event_lag_seconds', 2 from ages
  union all select 'vitals_readings_5m', recent from ages
  union all select 'vitals_abnormal_ratio_5m', share from ages
  union all select 'active_patients_2m', people from ages
  union all select 'live_summary_last_update_age_seconds', greatest(0, epoch_us(t) - max(window_start)) / 1000000.0::double from summary, now group by t
  union all select 'speed_layer_heartbeat_age_seconds', greatest(0, epoch_us(t) - epoch_us(h)) / 1000000.0::double from beat, now
  union all select 'speed_layer_rejected_ratio', bad / n from beat
  union all select 'speed_layer_input_rows_per_second', n / 3600.0::double from beat
  union all select 'patient_alerts_active', count(*) filter (where last_window_end > epoch_us(t) - 172800000000) from episodes, now
  union all select 'patient_alerts_24h', count(*) filter (where first_window_start > epoch_us(t) - 432000000000) from episodes, now
  union all select 'batch_runs_success_30m', ok from done
  union all select 'batch_runs_failed_30m', bad from done
  union all select 'batch_failure_ratio_30m', coalesce(bad / nullif(ok + bad, 0), 0) from done
  union all select 'batch_last_success_age_seconds', age from done
  union all select 'batch_last_duration_seconds', took from done
  union all select 'lab_feed_last_file_age_seconds', 86400
  union all select 'lab_files_pending', count(*) from pending
  union all select 'pipeline_alerts_open', count(*) from run_alerts where resolved_at is null
),
rules as (
  select * from (values
    ('vitals_stream_stale', 'vitals_last_ingest_age_seconds', 60::double, true, 'critical', 'No vitals reading stored in the last 60s - producer, Kafka or speed layer is down'),
    ('speed_layer_down', 'speed_layer_heartbeat_age_seconds', 60, true, 'critical', 'Speed-layer driver has not reported a heartbeat in 60s - Spark job stopped or crashed'),
    ('live_summary_stale', 'live_summary_last_update_age_seconds', 90, true, 'warning', 'Real-time serving view (vitals_live_summary) not updated in 90s'),
    ('lab_feed_stale', 'lab_feed_last_file_age_seconds', 216000, true, 'warning', 'No new lab results file for 2.5 simulated days - daily batch source is late'),
    ('batch_backlog', 'lab_files_pending', 2, false, 'warning', 'More than 2 lab files are waiting for the batch layer - Airflow/batch job is falling behind'),
    ('batch_job_failing', 'batch_failure_ratio_30m', 0.2, false, 'critical', 'More than 20% of batch-layer runs failed in the last 30 minutes'),
    ('data_quality_rejects_high', 'speed_layer_rejected_ratio', 0.05, false, 'warning', 'More than 5% of consumed readings rejected as invalid - producer or schema problem'),
    ('ward_abnormal_rate_high', 'vitals_abnormal_ratio_5m', 0.3, false, 'warning', 'More than 30% of readings in the last 5 minutes are abnormal (expected ~10%) - ward-wide event or faulty sensors')
  ) as r(name, metric, edge, missing, severity, description)
),
evaluated as (
  select r.name, r.metric, r.edge, m.value, r.severity, case when m.value is null then r.missing else m.value > r.edge end as breached,
         description || ' (value=' || coalesce(printf('%.2f', round(round(m.value, 6), 2)), 'no data') || ', threshold='
           || printf('%g', edge) || ')' as message
  from rules r left join metrics m on m.metric = r.metric
)
"""
)

#: As the stream's records carry them: 32-bit numbers, and the broker's time where the device's can't be read.
_SPO2 = "case when event_type = 'error' and k < 50 then 80 + (k % 101) / 10 else 95 + (k % 51) / 10 end"
_TEMPERATURE = "case when event_type = 'error' and k < 50 then cast(38.5 as double) + (k % 16) / 10 else cast(36.1 as double) + (k % 12) / 10 end"
STREAMED = {
    READINGS: READINGS.replace(_SPO2, f"cast(cast({_SPO2} as float) as double)")
    .replace(_TEMPERATURE, f"cast(cast({_TEMPERATURE} as float) as double)")
    .replace("ts as event_time", "case when event_id % 10 = 0 then ts + interval 2 second else ts end as event_time")
}
STREAM_EPISODES = EPISODES.replace(READINGS, STREAMED[READINGS])

#: Breach observations by batches, and episodes of all of them; then the same taken one after the other.
ARRIVALS = (
    WINDOWS
    + """,
slotted as (select *, window_start // 28800000000 as slot, cast(substr(patient_id, 2) as bigint) as person from alerts),
log as (select *, (slot + person) % 5 as batch from slotted union all select *, 5 + slot % 8 // 4 from slotted where slot % 4 = 0)
"""
)
BATCHED = (
    ARRIVALS
    + """,
reached as (select *, max(window_end) over (partition by patient_id order by window_start, window_end, batch rows between unbounded preceding and 1 preceding) as reach from log),
numbered as (
  select *, sum(case when reach is null or window_start > reach then 1 else 0 end) over (partition by patient_id order by window_start, window_end, batch rows unbounded preceding) as n from reached
),
episodes as (
  select patient_id, min(window_start) as first_window_start, max(window_end) as last_window_end, case when bool_or(severity = 'critical') then 'critical' else 'warning' end as severity,
         count(distinct window_end) as breaching_windows, arg_max(reasons, (case when severity = 'critical' then 10 else 0 end + batch) * 10000000000000000 + window_start) as reasons,
         max(max_heart_rate) as max_heart_rate, min(min_heart_rate) as min_heart_rate, min(min_spo2) as min_spo2, max(max_temperature) as max_temperature
  from numbered group by patient_id, n
)
"""
)
FOLDED = (
    ARRIVALS
    + """,
arrived as (select *, row_number() over (partition by patient_id order by batch, window_start, window_end) as r from log),
fold as (
  select patient_id, r, 1 as episode, window_start as first_window_start, window_end as last_window_end, severity, 1 as breaching_windows, reasons, max_heart_rate, min_heart_rate, min_spo2, max_temperature
  from arrived where r = 1
  union all
  select patient_id, r, episode + opens, if(opens = 1, window_start, first_window_start), if(opens = 1, window_end, greatest(last_window_end, window_end)),
         if(opens = 1, x_severity, if(severity = 'critical' or x_severity = 'critical', 'critical', 'warning')), if(opens = 1, 1, breaching_windows + if(window_end > last_window_end, 1, 0)),
         if(opens = 1 or x_severity = 'critical' or severity = 'warning', x_reasons, reasons), if(opens = 1, x_max_rate, greatest(max_heart_rate, x_max_rate)),
         if(opens = 1, x_min_rate, least(min_heart_rate, x_min_rate)), if(opens = 1, x_spo2, least(min_spo2, x_spo2)), if(opens = 1, x_temperature, greatest(max_temperature, x_temperature))
  from (select f.* exclude (r), x.r, x.window_start, x.window_end, x.severity as x_severity, x.reasons as x_reasons, x.max_heart_rate as x_max_rate, x.min_heart_rate as x_min_rate, x.min_spo2 as x_spo2,
               x.max_temperature as x_temperature, if(x.window_start > f.last_window_end, 1, 0) as opens
        from fold f join arrived x on x.patient_id = f.patient_id and x.r = f.r + 1)
),
episodes as (select * exclude (p) from (select *, row_number() over (partition by patient_id, episode order by r desc) as p from fold) where p = 1)
"""
)
#: Records in three turns, and how far the watermark is when a turn begins.
TURNS = (
    STREAMED[READINGS]
    + f""",
turned as (
  select *, case when epoch_us(ingested_at) < ({EPOCH} + 864000) * 1000000 then if(kafka_offset % 7 = 0, 2, 0) when epoch_us(ingested_at) < ({EPOCH} + 1728000) * 1000000 then if(kafka_offset % 7 = 0, 2, 1) else 2 end as turn
  from judged
),
marks as (select t.turn, coalesce(max(epoch_us(event_time)) // 1000 * 1000 - 172800000000, 0) as mark from (values (0), (1), (2)) as t(turn) left join turned x on x.is_valid and x.turn < t.turn group by t.turn)
"""
)

_MEANS = ", ".join(f"round({c}, 6) as {c}" for c in ("avg_heart_rate", "avg_spo2", "avg_temperature"))
_SUMMARY = f"""select patient_id, window_start, window_end, {_MEANS}, abnormal_count, total_readings, max_heart_rate, min_heart_rate,
  round(min_spo2, 6) as min_spo2, round(max_temperature, 6) as max_temperature from summary"""
_MASTER = """select kafka_partition, kafka_offset, patient_id, heart_rate, round({spo2}, 6) as spo2, systolic_bp, diastolic_bp, round({temperature}, 6) as temperature,
  {time} as event_time"""
_ROUNDED = ", ".join(
    f"round({c}, 6) as {c}" for c in ("abnormal_ratio", "avg_heart_rate", "avg_spo2", "avg_temperature", "min_spo2", "hr_trend_bpm_per_min", "spo2_trend_pct_per_min")
)
_WHEN = "strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S+00:00')"
_RANK = "list_position(['high', 'elevated_vitals', 'elevated_labs', 'normal'], risk_flag)"
_EPISODES = """select patient_id, first_window_start, last_window_end, severity, breaching_windows, reasons, max_heart_rate, min_heart_rate,
  round(min_spo2, 6) as min_spo2, round(max_temperature, 6) as max_temperature from episodes"""

ORACLE_SQL: dict[str, str] = {
    "decode_payload": f"with {READINGS} select event_id, case when k % 17 = 0 then null else k end as k from e",
    "parse_readings": f"with {READINGS} "
    + _MASTER.format(spo2="round(spo2, 3)", temperature="round(temperature, 3)", time="epoch_us(case when kafka_offset % 10 = 0 then ingested_at else event_time end)")
    + " from readings",
    "reading_quality": f"""with {READINGS}, r as (
      select case when heart_rate between 20 and 250 then null else 'heart_rate' end as a, case when spo2 between 50 and 100 then null else 'spo2' end as b,
             case when temperature between 30 and 45 then null else 'temperature' end as c, case when systolic_bp between 30 and 260 then null else 'systolic_bp' end as d,
             case when diastolic_bp between 30 and 260 then null else 'diastolic_bp' end as f, case when systolic_bp > diastolic_bp then null else 'pressure_order' end as g,
             case when is_valid then 'valid' end as h, case when is_valid and is_abnormal then 'valid_abnormal' end as i from judged)
      select label, count(*) as readings from (select unnest([a, b, c, d, f, g, h, i]) as label from r) where label is not null group by label""",
    "readings_in_window": f"""with {READINGS} select patient_id, heart_rate, round(spo2, 6) as spo2, round(temperature, 6) as temperature, is_abnormal, epoch_us(event_time) as event_time
      from valid where epoch_us(event_time) >= ({EPOCH} + 864000) * 1000000 and epoch_us(event_time) < ({EPOCH} + 1728000) * 1000000""",
    "sliding_summary": f"with {WINDOWS} {_SUMMARY}",
    "window_alerts": f"with {WINDOWS} select patient_id, window_start, severity, reasons from alerts",
    "alert_episodes": f"with {EPISODES} {_EPISODES}",
    "lab_clean": f"with {LABS} select *, cast(regexp_extract(source_file, 'day(\\d+)', 1) as bigint) as day from labs",
    "lab_rollup": f"with {LABS} select source_file, patient_id, test_type, cast(abnormal_labs as bigint) as abnormal_labs, abnormal_tests from rolled",
    "lab_quality": f"""with {LABS} select r.source_file, raw_rows, coalesce(clean_rows, 0) as clean_rows, coalesce(abnormal_rows, 0) as abnormal_rows, raw_rows - coalesce(clean_rows, 0) as dropped_rows
      from (select source_file, count(*) as raw_rows from labs_raw group by 1) r
      left join (select source_file, count(*) as clean_rows, count(*) filter (where lab_abnormal) as abnormal_rows from labs group by 1) c using (source_file)""",
    "day_summary": f"""with {REPORT} select source_file, patient_id, total_readings, abnormal_readings, {_MEANS}, round(min_spo2, 6) as min_spo2, max_heart_rate,
      round(abnormal_ratio, 6) as abnormal_ratio from day""",
    "vitals_trend": f"with {REPORT} select source_file, patient_id, round(heart_rate_trend, 6) as heart_rate_trend, round(spo2_trend, 6) as spo2_trend from day",
    "risk_report": f"""with {REPORT} select source_file, patient_id, test_type, total_readings, round(abnormal_ratio, 6) as abnormal_ratio, result_value, cast(abnormal_labs as bigint) as abnormal_labs,
      vitals_concerning, risk_before_labs, risk_after_labs, abnormal_labs > 0 as risk_changed_by_labs,
      cast(list_position(['high', 'elevated_vitals', 'elevated_labs', 'normal'], risk_after_labs) as bigint) as risk_rank from report""",
    "risk_reasons": f"""with {REPORT} select source_file, patient_id, test_type, concat_ws(',', case when total_readings = 0 then 'no_vitals=0' end,
      case when abnormal_ratio >= 0.2::double then 'abnormal_percent=' || {thousandths("abnormal_ratio * 100")} end, case when avg_spo2 < 95 then 'spo2_low=' || {thousandths("avg_spo2")} end,
      case when avg_heart_rate > 100 then 'heart_rate_high=' || {thousandths("avg_heart_rate")} end, case when avg_heart_rate < 60 then 'heart_rate_low=' || {thousandths("avg_heart_rate")} end,
      case when avg_temperature > 37.5::double then 'temperature_high=' || {thousandths("avg_temperature")} end,
      case when abnormal_labs > 0 then 'abnormal_labs=' || cast(abnormal_labs * 1000 as bigint) end) as risk_reasons, risk_text from said""",
    "report_rows": f"with {REPORT} select * replace ({_ROUNDED}) from kept",
    "report_consolidated": f"with {REPORT} select * replace ({_ROUNDED}) from patients",
    "report_markdown": f"""with {REPORT}, f as (select source_file, any_value(report_day) as day, any_value(run_id) as run, any_value(window_start) as a, any_value(window_end) as b from patients group by 1),
      flags as (select * from (values (0, 'high'), (1, 'elevated_vitals'), (2, 'elevated_labs'), (3, 'normal')) as g(r, flag)),
      changed as (select source_file, string_agg(patient_id, ', ' order by patient_id) filter (where vitals_only_risk = 'elevated' and risk_flag = 'high') as up,
                   string_agg(patient_id, ', ' order by patient_id) filter (where risk_flag = 'elevated_labs') as fresh from patients group by 1),
      x as (
        select source_file, 0 as section, 0 as risk_rank, '' as patient_id, ['# Daily Patient Risk Report - simulated day ' || day, '', '- **Lab file:** `' || source_file || '`',
          '- **Vitals window (UTC):** ' || {_WHEN.format("a")} || ' -> ' || {_WHEN.format("b")}, '- **Generated:** ' || {_WHEN.format("b")} || ' (run `' || run || '`)',
          '', '## Risk summary', '', '| Risk flag | Patients |', '|---|---|'] as l from f
        union all select f.source_file, 1, r, '', ['| ' || flag || ' | ' || (select count(*) from patients p where p.source_file = f.source_file and p.risk_flag = flag) || ' |'] from f, flags
        union all select source_file, 2, 0, '', ['', '**How yesterday''s labs change the risk picture**', '',
          '- Escalated to *high* (concerning vitals confirmed by abnormal labs): ' || coalesce(up, 'none'), '- Newly flagged by labs alone (vitals looked normal): ' || coalesce(fresh, 'none'),
          '', '## Patients (most severe first)', '', '| Patient | Risk | Vitals-only | Readings | Abnormal % | Avg HR | Avg SpO2 | Avg Temp | HR trend (bpm/min) | SpO2 trend (%/min) | Reasons |',
          '|---|---|---|---|---|---|---|---|---|---|---|'] from changed
        union all select source_file, 4, 0, '', ['', '## Lab results', '', '| Patient | Test | Result | Reference range | Abnormal |', '|---|---|---|---|---|'] from f)
      select source_file, cast(section as bigint) as section, cast(risk_rank as bigint) as risk_rank, patient_id, cast(i - 1 as bigint) as place, l[i] as line from (select *, unnest(range(1, len(l) + 1)) as i from x)
      union all select source_file, 3, {_RANK}, patient_id, 0, '| ' || concat_ws(' | ', patient_id, '**' || risk_flag || '**', vitals_only_risk, total_readings,
        coalesce({shown("abnormal_ratio * 100", 0)}, '-'), coalesce({shown("avg_heart_rate", 0)}, '-'), coalesce({shown("avg_spo2", 1)}, '-'), coalesce({shown("avg_temperature", 1)}, '-'),
        coalesce({shown("hr_trend_bpm_per_min", 1, "+")}, '-'), coalesce({shown("spo2_trend_pct_per_min", 2, "+")}, '-'), coalesce(risk_reasons, '')) || ' |' from patients
      union all select source_file, 4, {_RANK}, patient_id, row_number() over (partition by source_file, patient_id order by lab_test_type) - 1,
        '| ' || concat_ws(' | ', patient_id, lab_test_type, cast(lab_result_value as varchar), lab_reference_range, case when lab_abnormal then '**YES**' else 'no' end) || ' |'
        from kept where lab_test_type is not null""",
    "risk_counts": f"""with {REPORT}, flags as (select * from (values (0, 'high'), (1, 'elevated_vitals'), (2, 'elevated_labs'), (3, 'normal')) as f(risk_rank, risk))
      select f.source_file, cast(risk_rank as bigint) as risk_rank, risk, count(p.patient_id) as patients
      from (select distinct source_file, risk_rank, risk from patients, flags) f left join patients p on p.source_file = f.source_file and p.risk_flag = f.risk group by all""",
    "labs_effect": f"""with {REPORT} select source_file, coalesce(string_agg(patient_id, ',' order by patient_id) filter (where vitals_only_risk = 'elevated' and risk_flag = 'high'), '') as escalated_by_labs,
      coalesce(string_agg(patient_id, ',' order by patient_id) filter (where risk_flag = 'elevated_labs'), '') as newly_flagged_by_labs from patients group by source_file""",
    "run_stats": f"""with {REPORT} select source_file, count(*) as report_rows, count(distinct patient_id) as patients,
      count(distinct patient_id) filter (where risk_after_labs = 'high') as high_patients, count(distinct patient_id) filter (where risk_after_labs = 'elevated_vitals') as elevated_vitals_patients,
      count(distinct patient_id) filter (where risk_after_labs = 'elevated_labs') as elevated_labs_patients, count(distinct patient_id) filter (where risk_after_labs = 'normal') as normal_patients
      from report group by source_file""",
    "report_validation": f"""with {FILES}, l as (select *, row_number() over (partition by source_file order by started_at desc, run_id desc) as p from runs),
      s as (select 'lab_results_day' || day(l_shipdate) || '_' || cast(epoch(l_shipdate) as bigint) || '.csv' as source_file, count(*) as n from lineitem group by 1)
      select f.file_name as source_file, l.status, l.rows_written, coalesce(s.n, 0) as stored_rows,
             l.status is distinct from 'success' or coalesce(s.n, 0) = 0 or coalesce(s.n, 0) is distinct from l.rows_written as problem
      from files f left join l on l.source_file = f.file_name and l.p = 1 left join s on s.source_file = f.file_name""",
    "latest_reading": f"with {READINGS} "
    + _MASTER.format(spo2="spo2", temperature="temperature", time="epoch_us(event_time)")
    + ", epoch_us(ingested_at) as ingested_at, is_abnormal from (select *, row_number() over (partition by patient_id order by event_time desc, kafka_offset desc) as p from valid) where p = 1",
    "ward_patients": f"with {WARD} select * replace ({', '.join(f'round({c}, 6) as {c}' for c in ('spo2', 'temperature', 'avg_heart_rate', 'avg_spo2', 'avg_temperature', 'seconds_since_last_reading'))}) from ward_status",
    "ward_snapshot": f"""with {WARD} select * from (
        select count(distinct patient_id) filter (where ingested_at > t - interval 2 day) as active_patients, count(*) filter (where ingested_at > t - interval 5 day) as recent_readings,
               round(avg(is_abnormal::int) filter (where ingested_at > t - interval 5 day), 6) as abnormal_ratio,
               round(avg(heart_rate) filter (where ingested_at > t - interval 5 day), 6) as avg_heart_rate, round(avg(spo2) filter (where ingested_at > t - interval 5 day), 6) as avg_spo2,
               round(avg(temperature) filter (where ingested_at > t - interval 5 day), 6) as avg_temperature
        from valid, now),
      (select count(*) filter (where monitored) as monitored, count(*) filter (where status = 'critical') as critical, count(*) filter (where status = 'warning') as warning from ward_status)""",
    "patient_detail": f"""with {EPISODES.replace(READINGS, REPORT)}, r as (
        select patient_id, 'reading' as kind, row_number() over (partition by patient_id order by event_time desc, kafka_offset desc) as place, epoch_us(event_time) as at, cast(heart_rate as double) as heart_rate,
               round(spo2, 6) as spo2, round(temperature, 6) as temperature, systolic_bp, diastolic_bp, is_abnormal
        from valid, now where event_time > t - interval 7 day),
      w as (select patient_id, 'window' as kind, row_number() over (partition by patient_id order by window_end desc) as place, window_end as at, window_start, round(avg_heart_rate, 6) as heart_rate,
                   round(avg_spo2, 6) as spo2, round(avg_temperature, 6) as temperature, abnormal_count, total_readings from summary),
      x as (select patient_id, 'alert' as kind, row_number() over (partition by patient_id order by last_window_end desc) as place, last_window_end as at, first_window_start as window_start, severity, reasons,
                   breaching_windows from episodes),
      y as (select patient_id, 'report' as kind, row_number() over (partition by patient_id order by coalesce(lab_test_type, '')) as place, generated_at as at, risk_flag, risk_reasons, lab_test_type,
                   lab_result_value, lab_reference_range, lab_abnormal
            from kept r where source_file = (select max(source_file) from kept x where x.patient_id = r.patient_id))
      select * from r where place <= 200 union all by name select * from w where place <= 60 union all by name select * from x where place <= 20 union all by name select * from y""",
    "alert_list": f"with {EPISODES} select patient_id, first_window_start, last_window_end, severity, reasons, last_window_end > epoch_us(t) - 172800000000 as active from episodes, now",
    "report_list": f"""with {FILES} select source_file, run_id, finished_at * 1000000 as finished_at, rows_written
      from (select *, row_number() over (partition by source_file order by finished_at desc, run_id desc) as p from runs where status = 'success') where p = 1""",
    "readings_per_file": f"""with {REPORT} select source_file, count(*) as readings, count(distinct patient_id) as patients, epoch_us(min(event_time)) as first_event, epoch_us(max(event_time)) as last_event
      from per_file group by source_file""",
    "pending_files": f"with {FILES} select file_name, day, epoch, age_seconds from pending",
    "completeness_gate": f"""with {FILES}, g as (select p.*, t - 17280000 >= epoch as caught_up, t - epoch >= 2678400 as waited_out from pending p, last)
      select file_name, caught_up, waited_out, not caught_up as maybe_incomplete, bool_and(caught_up or waited_out) over (order by epoch, day, file_name rows unbounded preceding) as ready from g""",
    "ingest_stats": f"""with {READINGS} select kafka_partition, count(*) as readings_in, count(*) filter (where is_valid) as written, count(*) filter (where not is_valid) as rejected,
      count(*) filter (where is_valid and is_abnormal) as abnormal, count(distinct patient_id) filter (where is_valid) as patients, round(count(*) filter (where not is_valid) / count(*), 6) as rejected_ratio
      from judged group by kafka_partition""",
    "pipeline_metrics": f"with {METRICS} select metric, round(value, 6) as value from metrics",
    "rule_eval": f'with {METRICS} select name, metric, edge as "limit", round(value, 6) as value, severity, breached, message from evaluated',
    "run_alerts": f"""with {METRICS} select name, severity, failures, opened_at * 1000000 as opened_at, last_seen_at * 1000000 as last_seen_at, resolved_at * 1000000 as resolved_at, message from run_alerts""",
    "exposition": f"""with {METRICS}, h as (select unnest([{", ".join(f"'{n}'" for n in METRIC_HELP)}]) as metric, unnest([{", ".join(f"'{t}'" for t in METRIC_HELP.values())}]) as help)
      select cast(0 as bigint) as part, m.metric as of, '# HELP pipeline_' || m.metric || ' ' || help || chr(10) || '# TYPE pipeline_' || m.metric || ' gauge' || chr(10) || 'pipeline_' || m.metric || ' '
        || coalesce(cast(value as varchar), 'NaN') as text
      from metrics m join h on h.metric = m.metric
      union all select 1, '', '# HELP pipeline_health_rule_breached {RULE_HELP}' || chr(10) || '# TYPE pipeline_health_rule_breached gauge'
      union all select 2, name, 'pipeline_health_rule_breached{{rule="' || name || '"}} ' || cast(breached as int) from evaluated""",
    "health_status": f"""with {METRICS} select case when bool_or(breached and severity = 'critical') then 'critical' when bool_or(breached) then 'degraded' else 'ok' end as status,
      bool_or(breached and severity = 'critical') as has_critical, count(*) filter (where breached) as breaches from evaluated""",
    "alert_sync": f"""with {WINDOWS}, half as (select ({EPOCH} + 15 * 86400) * 1000000 as h),
      o as (select patient_id as name, min(window_start) as opened_at, max(window_start) as last_seen_at from alerts, half where window_start < h group by 1),
      n as (select patient_id, count(*) as n, max(severity) as severity from alerts, half where window_start >= h group by 1),
      r as (select p.patient_id as name, severity, coalesce(n, 0) >= 3 as breached, cast(n as double) as value, p.patient_id || ': ' || coalesce(n, 0) || ' windows' as said from (select distinct patient_id from valid) p left join n on n.patient_id = p.patient_id),
      s as (select coalesce(r.name, o.name) as name, severity, value, said, opened_at, last_seen_at, epoch_us(t) as t,
                   case when breached and opened_at is null then 'insert' when breached then 'refresh' when not breached and opened_at is not null then 'resolve' else 'nothing' end as action
            from r full join o on o.name = r.name, now)
      select name, severity, value, action, coalesce(opened_at, case when action in ('insert', 'refresh') then t end) as opened_at,
             case when action in ('insert', 'refresh', 'resolve') then t else last_seen_at end as last_seen_at, case when action = 'resolve' then t end as resolved_at,
             case when action in ('insert', 'refresh') then said when opened_at is not null then 'open since ' || opened_at // 1000000 end as message from s""",
    "sustained_breach": f"""with {WINDOWS} select patient_id as series, window_start as at, abnormal_count > 0 as breached,
      bool_and(abnormal_count > 0) over (partition by patient_id order by window_start range between 57600000000 preceding and current row)
      and window_start - min(window_start) over (partition by patient_id) >= 57600000000 as sustained from summary""",
    "lab_csv_scan": f"with {LABS} select source_file, count(*) as lines, count(collected_at) as timed, count(distinct test_type) as tests from labs_raw group by source_file",
    "lab_file_catalog": f"with {FILES} select file_name, day, epoch, size, (epoch - 86400) * 1000000 as window_start, epoch * 1000000 as window_end from files",
    "stream_raw_append": f"with {STREAMED[READINGS]} "
    + _MASTER.format(spo2="spo2", temperature="temperature", time="epoch_us(event_time)")
    + ", is_abnormal from valid",
    "stream_sliding_summary": f"with {STREAM_EPISODES} {_SUMMARY}",
    "stream_alerts": f"with {STREAM_EPISODES} {_EPISODES}",
    "alerts_by_batches": f"with {BATCHED} {_EPISODES}",
    "alerts_by_arrival": f"with recursive {FOLDED} {_EPISODES}",
    "stream_late_windows": f"""with {TURNS}, late as (
        select x.*, (epoch_us(event_time) // 28800000000 - j) * 28800000000 as ws, mark from turned x join marks m on m.turn = x.turn, (values (0), (1), (2)) as s(j) where is_valid),
      summary as (select patient_id, ws as window_start, ws + 86400000000 as window_end, avg(heart_rate) as avg_heart_rate, avg(spo2) as avg_spo2, avg(temperature) as avg_temperature,
                         count(*) filter (where is_abnormal) as abnormal_count, count(*) as total_readings, max(heart_rate) as max_heart_rate, min(heart_rate) as min_heart_rate, min(spo2) as min_spo2,
                         max(temperature) as max_temperature from late where ws + 86400000000 > mark group by patient_id, ws)
      {_SUMMARY}""",
    "late_correction": f"""with {TURNS}, p as (select 1 as day, 'again' as run, 2 as until union all select 2, 'first', 1)
      select 'lab_results_day' || day || '_' || ({EPOCH} + day * 864000) || '.csv' as source_file, patient_id, run, count(*) as total_readings, count(*) filter (where is_abnormal) as abnormal_readings,
             round(avg(heart_rate), 6) as avg_heart_rate, round(avg(spo2), 6) as avg_spo2, round(avg(temperature), 6) as avg_temperature, round(min(spo2), 6) as min_spo2, max(heart_rate) as max_heart_rate,
             round(count(*) filter (where is_abnormal) / count(*), 6) as abnormal_ratio
      from turned x join p on x.turn <= p.until and epoch_us(event_time) >= ({EPOCH} + (day - 1) * 864000) * 1000000 and epoch_us(event_time) < ({EPOCH} + day * 864000) * 1000000
      where is_valid group by day, run, patient_id""",
    "stream_progress": f"""with {TURNS}, b as (select turn as batch_id, count(*) as readings_in, count(*) filter (where not is_valid) as rejected from turned group by turn)
      select *, (select round(rejected / readings_in, 6) from b order by batch_id desc limit 1) as speed_layer_rejected_ratio from b""",
    "series_gaps": f"""with {READINGS}, s as (select distinct patient_id as series from readings),
      x as (select patient_id as series, epoch_us(event_time) as moment from valid, now where event_time < t union all select series, epoch_us(t) from s, now),
      g as (select series, coalesce(lag(moment) over (partition by series order by moment), {EPOCH} * 1000000) as gap_from, moment as gap_to from x)
      select *, (gap_to - gap_from) / 1000000.0::double as seconds from g where gap_to - gap_from > 172800000000""",
    "absent_series": f"""with {WINDOWS} select distinct patient_id as series from readings
      where patient_id not in (select patient_id from summary, now where abnormal_count > 0 and window_start > epoch_us(t) - 259200000000)""",
    "report_order": f"""with {REPORT} select source_file, patient_id, risk_flag, lab_test_type,
      row_number() over (partition by source_file order by {_RANK}, patient_id, coalesce(lab_test_type, '')) as place from kept""",
    "ward_order": f"""with {WARD}, w as (select *, list_position(['critical', 'warning', 'no_signal', 'normal'], status) as r from ward_status)
      select cast(r as bigint) as status_rank, row_number() over (partition by status order by patient_id) as place, patient_id, status from w""",
    "pipeline_alerts": f"""with {METRICS}, s as (select *, if(resolved_at is null, 'open', 'resolved') as state from run_alerts)
      select state, row_number() over (partition by state order by opened_at desc, name) as place, name, opened_at * 1000000 as opened_at, resolved_at * 1000000 as resolved_at from s""",
    "latest_report": f"""with {REPORT} select asked, source_file, patient_id, lab_test_type, risk_flag, report_day
      from kept join (values ('latest', 3), ('named', 1)) as x(asked, d) on report_day = d""",
    "master_range": f"with {READINGS} "
    + _MASTER.format(spo2="spo2", temperature="temperature", time="epoch_us(event_time)")
    + f", is_abnormal from valid where epoch_us(event_time) >= ({EPOCH} + 864000) * 1000000 and epoch_us(event_time) < ({EPOCH} + 1728000) * 1000000",
    "quarantine": f"""with {READINGS} select kafka_offset, patient_id, 0 as batch_id,
      concat_ws(',', case when not regexp_matches(patient_id, '^P\\d{{3,}}$') then 'patient_id' end, case when heart_rate between 20 and 250 then null else 'heart_rate' end,
        case when spo2 between 50 and 100 then null else 'spo2' end, case when temperature between 30 and 45 then null else 'temperature' end, case when systolic_bp between 30 and 260 then null else 'systolic_bp' end,
        case when diastolic_bp between 30 and 260 then null else 'diastolic_bp' end, case when systolic_bp > diastolic_bp then null else 'pressure_order' end) as reject_reasons
      from judged where not is_valid""",
    "run_audit": f"""with {FILES} select run_id, source_file, status, coalesce(finished_at, started_at) * 1000000 as at, rows_written from runs""",
    "window_counts": f"""with {ARRIVALS}, x as (select *, max(window_end) over (partition by patient_id order by batch, window_start, window_end rows between unbounded preceding and 1 preceding) as reach from log),
      b as (select batch as batch_id, count(*) as windows, count(distinct patient_id) as patients, count(*) filter (where reach is null or reach < window_start) as alerts_opened,
                   count(*) filter (where reach >= window_start) as alerts_extended from x group by batch)
      select *, cast(sum(windows) over o as bigint) as total_windows, cast(sum(alerts_opened) over o as bigint) as total_alerts_opened, cast(sum(alerts_extended) over o as bigint) as total_alerts_extended
      from b window o as (order by batch_id rows unbounded preceding)""",
    "lab_drop_listing": f"""with {LABS} select source_file as file_name, cast(regexp_extract(source_file, 'day(\\d+)', 1) as bigint) as day, epoch, (epoch - 864000) * 1000000 as window_start, epoch * 1000000 as window_end,
      count(*) as lines from labs_raw group by source_file, epoch""",
}
