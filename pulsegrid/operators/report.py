"""Consolidated reports, their counts, exports and validation. Rows are those of the report table (``risk.report_rows``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import rules
from pulsegrid.operators.risk import report_order, shown
from pulsegrid.settings import RISK_ORDER

# What a consolidated report says of a patient, and of its file.
PATIENT_FIELDS = (
    "risk_flag", "vitals_only_risk", "risk_changed_by_labs", "vitals_concerning", "total_readings", "vitals_abnormal_count", "abnormal_ratio", "avg_heart_rate", "avg_spo2",
    "avg_temperature", "min_spo2", "max_heart_rate", "hr_trend_bpm_per_min", "spo2_trend_pct_per_min", "patient_abnormal_lab_count", "risk_reasons",
)
FILE_FIELDS = ("report_day", "run_id", "window_start", "window_end", "generated_at")
# The text of a written report. Names in braces stand for values.
HEAD_LINES = (
    "# Daily Patient Risk Report - simulated day {report_day}",
    "",
    "- **Lab file:** `{file}`",
    "- **Vitals window (UTC):** {window_start} -> {window_end}",
    "- **Generated:** {generated_at} (run `{run_id}`)",
    "",
    "## Risk summary",
    "",
    "| Risk flag | Patients |",
    "|---|---|",
)
EFFECT_LINES = (
    "",
    "**How yesterday's labs change the risk picture**",
    "",
    "- Escalated to *high* (concerning vitals confirmed by abnormal labs): {escalated_by_labs}",
    "- Newly flagged by labs alone (vitals looked normal): {newly_flagged_by_labs}",
    "",
    "## Patients (most severe first)",
    "",
    "| Patient | Risk | Vitals-only | Readings | Abnormal % | Avg HR | Avg SpO2 | Avg Temp | HR trend (bpm/min) | SpO2 trend (%/min) | Reasons |",
    "|---|---|---|---|---|---|---|---|---|---|---|",
)
LAB_LINES = ("", "## Lab results", "", "| Patient | Test | Result | Reference range | Abnormal |", "|---|---|---|---|---|")


def consolidated(rows: DataFrame, key: str = "source_file") -> DataFrame:
    """One row for each file and patient, with the labs nested (an empty array if there are none)."""
    lab = F.struct(F.col("lab_test_type").alias("test_type"), F.col("lab_result_value").alias("result_value"), F.col("lab_reference_range").alias("reference_range"), F.col("lab_abnormal").alias("abnormal"))
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    labs = F.array_sort(F.collect_list(F.when(F.col("lab_test_type").isNotNull(), lab)))  # a few tests of one patient
    return rows.groupBy(key, "patient_id").agg(*map(one, FILE_FIELDS), *map(one, PATIENT_FIELDS), labs.alias("labs"))


def risk_counts(patients: DataFrame, key: str = "source_file") -> DataFrame:
    """Patients for each file and flag; every flag has a row."""
    flags = patients.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, RISK_ORDER))).alias("risk_rank", "risk"))
    found = patients.groupBy(key, F.col("risk_flag").alias("risk")).agg(F.count("*").alias("n"))
    return flags.join(found, [key, "risk"], "left").select(key, "risk_rank", "risk", F.coalesce("n", F.lit(0)).alias("patients"))


def labs_effect(patients: DataFrame, key: str = "source_file") -> DataFrame:
    """Ordered ids of patients whom labs raised from elevated vitals to high, and of those whom only labs flag.

    One list of ids for each file, as the written report has it.
    """
    ids = lambda found: F.array_sort(F.collect_list(F.when(found, F.col("patient_id"))))
    raised = (F.col("vitals_only_risk") == "elevated") & (F.col("risk_flag") == "high")
    return patients.groupBy(key).agg(ids(raised).alias("escalated_by_labs"), ids(F.col("risk_flag") == "elevated_labs").alias("newly_flagged_by_labs"))


def run_stats(rows: DataFrame, key: str = "source_file") -> DataFrame:
    """Rows, distinct patients, and distinct patients of each flag."""
    per_flag = (F.count_distinct(F.when(F.col("risk_flag") == flag, F.col("patient_id"))).alias(f"{flag}_patients") for flag in RISK_ORDER)
    return rows.groupBy(key).agg(F.count("*").alias("report_rows"), F.count_distinct("patient_id").alias("patients"), *per_flag)


def validation(requested: DataFrame, runs: DataFrame, stored: DataFrame) -> DataFrame:
    """requested (source_file) with their latest run, stored rows, and whether there is a problem.

    A problem: the run didn't succeed, nothing is stored, or other than the run wrote.
    """
    latest = runs.groupBy("source_file").agg(F.max_by(F.struct("status", "rows_written"), F.struct("started_at", "run_id")).alias("run"))
    count = stored.groupBy("source_file").agg(F.count("*").alias("stored_rows"))
    found = requested.join(latest, "source_file", "left").join(count, "source_file", "left")
    rows = F.coalesce("stored_rows", F.lit(0))
    problem = ~F.col("run.status").eqNullSafe("success") | (rows == 0) | ~rows.eqNullSafe(F.col("run.rows_written"))
    return found.select("source_file", F.col("run.status").alias("status"), F.col("run.rows_written").alias("rows_written"), rows.alias("stored_rows"), problem.alias("problem"))


def _line(section: int, rank: Column | int, patient: Column | str, place: Column | int, line: Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(section).alias("section"), as_column(rank).alias("risk_rank"), as_column(patient).alias("patient_id"), as_column(place).alias("place"), line.alias("line"))


def _filled(text: str, values: dict[str, Column]) -> Column:
    """A fixed text with its values."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*(values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)))


def markdown_lines(rows: DataFrame, key: str = "source_file") -> DataFrame:
    """Lines of the Markdown reports: key, section, risk_rank, patient_id, place, line, to be written in this order.

    Sections: 0 the head, 1 the table of risks, 2 what the labs changed, 3 patients, 4 laboratory results. One aggregate
    gives all lines of a file's own, and each patient's row gives all of theirs.
    """
    patients = consolidated(rows, key)
    when = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ssxxx")
    said = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
    ids = lambda found: F.array_sort(F.collect_list(F.when(found, F.col("patient_id"))))
    per_file = patients.groupBy(key).agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in FILE_FIELDS),
        *(F.count_if(F.col("risk_flag") == flag).alias(f"n_{flag}") for flag in RISK_ORDER),
        ids((F.col("vitals_only_risk") == "elevated") & (F.col("risk_flag") == "high")).alias("up"),
        ids(F.col("risk_flag") == "elevated_labs").alias("fresh"),
    )
    values = {
        "file": F.col(key), "report_day": F.col("report_day").cast("string"), "run_id": F.col("run_id").cast("string"), "escalated_by_labs": said("up"), "newly_flagged_by_labs": said("fresh"),
        **{c: when(c) for c in ("window_start", "window_end", "generated_at")},
    }
    own = [_line(section, 0, "", i, _filled(text, values)) for section, lines in ((0, HEAD_LINES), (2, EFFECT_LINES), (4, LAB_LINES)) for i, text in enumerate(lines)]
    own += [_line(1, rank, "", 0, F.format_string("| %s | %d |", F.lit(flag), F.col(f"n_{flag}"))) for rank, flag in enumerate(RISK_ORDER)]
    number = lambda c, digits, sign="": F.coalesce(F.when(c.isNotNull(), shown(c, digits, sign)), F.lit("-"))
    cells = (
        F.col("patient_id"), F.concat(F.lit("**"), F.col("risk_flag"), F.lit("**")), F.col("vitals_only_risk"), F.col("total_readings").cast("string"),
        number(F.col("abnormal_ratio") * 100, 0), number(F.col("avg_heart_rate"), 0), number(F.col("avg_spo2"), 1), number(F.col("avg_temperature"), 1),
        number(F.col("hr_trend_bpm_per_min"), 1, "+"), number(F.col("spo2_trend_pct_per_min"), 2, "+"), F.coalesce("risk_reasons", F.lit("")),
    )
    row = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    rank, patient = rules.rank_in(RISK_ORDER, F.col("risk_flag")), F.col("patient_id")
    lab = lambda x: row(patient, x["test_type"], x["result_value"].cast("string"), x["reference_range"], F.when(x["abnormal"], "**YES**").otherwise("no"))
    theirs = F.concat(F.array(_line(3, rank, patient, 0, row(*cells))), F.transform("labs", lambda x, i: _line(4, rank, patient, i, lab(x))))
    return per_file.select(key, F.inline(F.array(*own))).unionByName(patients.select(key, F.inline(theirs)))


def write_markdown(rows: DataFrame, path: str, key: str = "source_file") -> None:
    """One folder of text for each file; its parts, in the order of their names, are its report. A large report has several tasks."""
    order = (key, "section", "risk_rank", "patient_id", "place")
    lines = markdown_lines(rows, key).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select(key, F.col("line").alias("value")).write.option("partitionOverwriteMode", "dynamic").partitionBy(key).mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, key: str = "source_file") -> None:
    """The report as CSV with a header, in report order, one folder for each file; only files among rows are replaced."""
    flat = rows.orderBy(*report_order()).select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct")) else F.col(c) for c, t in rows.dtypes))
    flat.write.option("header", True).option("partitionOverwriteMode", "dynamic").partitionBy(key).mode("overwrite").csv(path)
