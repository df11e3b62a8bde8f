"""From raw stream records to judged readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions import rules
from pulsegrid.settings import DEFAULT, Limits

#: Fields of a reading's payload; times are ISO-8601 text.
PAYLOAD = T.StructType(
    [
        T.StructField("patient_id", T.StringType()),
        T.StructField("heart_rate", T.IntegerType()),
        T.StructField("spo2", T.FloatType()),
        T.StructField("systolic_bp", T.IntegerType()),
        T.StructField("diastolic_bp", T.IntegerType()),
        T.StructField("temperature", T.FloatType()),
        T.StructField("timestamp", T.StringType()),
    ]
)


def decode_json(records: DataFrame, schema: T.StructType = PAYLOAD) -> DataFrame:
    """records (value: JSON as text or bytes) with the struct payload; a corrupt value gives nulls and no failure."""
    return records.select("*", rules.once(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"})).alias("payload"))


def decode_avro(records: DataFrame, schema_json: str) -> DataFrame:
    """The same for schemaless Avro; needs Spark's Avro module on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return records.select("*", rules.once(from_avro("value", schema_json, {"mode": "PERMISSIVE"})).alias("payload"))


def parse(decoded: DataFrame) -> DataFrame:
    """Lineage columns and typed fields of decoded records (partition, offset, timestamp, payload).

    The event time is the device's, or the broker's where the device gives none that can be read.
    """
    field = lambda name: F.col(f"payload.{name}")
    return decoded.select(
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("long").alias("kafka_offset"),
        F.upper(F.trim(field("patient_id"))).alias("patient_id"),
        field("heart_rate").alias("heart_rate"),
        field("spo2").cast("double").alias("spo2"),
        field("systolic_bp").alias("systolic_bp"),
        field("diastolic_bp").alias("diastolic_bp"),
        field("temperature").cast("double").alias("temperature"),
        F.coalesce(F.try_to_timestamp(field("timestamp")), F.col("timestamp")).alias("event_time"),
    )


def judge(readings: DataFrame, limits: Limits = DEFAULT.limits) -> DataFrame:
    """readings with reject_reasons (codes), is_valid and is_abnormal."""
    return readings.withColumns({"reject_reasons": rules.reject_reasons(limits), "is_valid": rules.plausible(limits), "is_abnormal": rules.abnormal(limits)})


def ingest_stats(judged: DataFrame, batch: F.Column | str = "kafka_partition") -> DataFrame:
    """Counts for each batch of readings: in, written, rejected, abnormal, patients, and the share rejected."""
    valid = F.col("is_valid")
    return judged.groupBy(batch).agg(
        F.count("*").alias("readings_in"),
        F.count_if(valid).alias("written"),
        F.count_if(~valid).alias("rejected"),
        F.count_if(valid & F.col("is_abnormal")).alias("abnormal"),
        F.countDistinct(F.when(valid, F.col("patient_id"))).alias("patients"),
        F.try_divide(F.count_if(~valid), F.count("*")).alias("rejected_ratio"),
    )


def window_stats(updates: DataFrame, log: DataFrame) -> DataFrame:
    """Counts for each batch of window updates (batch_id, patient_id): windows, patients, and alerts opened and extended.

    log: breach observations (batch_id, patient_id, window_start, window_end). In order of arrival an observation extends
    an alert if one of its patient's reaches its start, and opens one otherwise.
    """
    before = Window.partitionBy("patient_id").orderBy("batch_id", "window_start", "window_end").rowsBetween(Window.unboundedPreceding, -1)
    extends = F.coalesce(F.max("window_end").over(before) >= F.col("window_start"), F.lit(False))
    found = log.withColumn("_extends", extends).groupBy("batch_id").agg(F.count_if(~F.col("_extends")).alias("alerts_opened"), F.count_if("_extends").alias("alerts_extended"))
    counts = updates.groupBy("batch_id").agg(F.count("*").alias("windows"), F.count_distinct("patient_id").alias("patients"))
    return counts.join(found, "batch_id", "left").fillna(0, ["alerts_opened", "alerts_extended"])


def cumulative(stats: DataFrame, names: tuple[str, ...], batch: str = "batch_id") -> DataFrame:
    """stats (one row for each batch) with total_<name>: the counts of all batches so far."""
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stats.withColumns({f"total_{n}": F.sum(n).over(so_far) for n in names})


def quality_counts(judged: DataFrame) -> DataFrame:
    """How many readings each reject reason hits, and how many are valid or abnormal (a reading may have several)."""
    labels = F.concat(
        F.col("reject_reasons"),
        F.filter(F.array(F.when(F.col("is_valid"), F.lit("valid")), F.when(F.col("is_valid") & F.col("is_abnormal"), F.lit("valid_abnormal"))), lambda x: x.isNotNull()),
    )
    return judged.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("readings"))


def readings_between(readings: DataFrame, start: F.Column, end: F.Column) -> DataFrame:
    """Readings with start <= event_time < end, and only the columns that summaries use."""
    return readings.filter((F.col("event_time") >= start) & (F.col("event_time") < end)).select(
        "patient_id", "heart_rate", "spo2", "temperature", "is_abnormal", "event_time"
    )
