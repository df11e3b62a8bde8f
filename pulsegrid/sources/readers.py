"""Readers: streams, lab drops, the master table, and rules."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.sources.layout import BatchTable

LAB_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("patient_id", "test_type", "result_value", "reference_range", "collected_at")])
RULE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "metric", "op")]
    + [T.StructField("threshold", T.DoubleType()), T.StructField("threshold_simulated_days", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("on_missing", "severity", "description")]
)
#: Rows of the master table.
READING = T.StructType(
    [
        T.StructField("kafka_partition", T.IntegerType()), T.StructField("kafka_offset", T.LongType()), T.StructField("patient_id", T.StringType()), T.StructField("heart_rate", T.IntegerType()),
        T.StructField("spo2", T.DoubleType()), T.StructField("systolic_bp", T.IntegerType()), T.StructField("diastolic_bp", T.IntegerType()), T.StructField("temperature", T.DoubleType()),
        T.StructField("event_time", T.TimestampType()), T.StructField("is_abnormal", T.BooleanType()), T.StructField("event_date", T.DateType()),
    ]
)
RULES = Path(__file__).with_name("rules.json")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under the checkpoint folder. Only a local session may do without one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def kafka_options(servers: str, topic: str, starting: str = "latest", most_per_trigger: int = 5000, sasl: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a Kafka source. sasl: mechanism and jaas, for brokers that ask for them."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(most_per_trigger), "failOnDataLoss": "false"}
    if sasl:
        options |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": sasl["mechanism"], "kafka.sasl.jaas.config": sasl["jaas"]}
    return options


def kafka(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Records with partition, offset, timestamp, value; needs Spark's Kafka module on the class path."""
    return spark.readStream.format("kafka").options(**options).load().select("partition", "offset", "timestamp", "value")


def avro_schema(path: str) -> str:
    """The text of an Avro schema file, checked to be JSON."""
    text = Path(path).read_text(encoding="utf-8")
    json.loads(text)
    return text


def lab_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Lab lines as text, with path and source_file (the file's name); all files in one scan."""
    read = spark.read.schema(LAB_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(list(paths))
    return read.select(*LAB_SCHEMA.names, F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source_file"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Drops of a folder (file_name, modified, size), without their content; a missing folder has none.

    A drop is a file, or a folder of part files as Spark writes it, which counts as one.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return spark.createDataFrame([], "file_name string, modified timestamp, size long")
    root = files.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inside = F.element_at(F.split(F.col("path"), re.escape(root), 2), -1)  # the path below the folder
    rows = found.select(F.split_part(inside, F.lit("/"), F.lit(1)).alias("file_name"), "modificationTime", "length")
    return rows.groupBy("file_name").agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("size"))


def master_table(path: str) -> BatchTable:
    """The master table's layout: event dates, then batches."""
    return BatchTable(path, "event_date")


def master(spark: SparkSession, path: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Readings of the master table, or those with start <= event_time < end; then only the folders of their dates are listed."""
    table = master_table(path)
    if start is None or end is None:
        return table.read(spark, READING).drop("event_date")
    first, last = spark.range(1).select(F.to_date(start).cast("string"), F.to_date(end).cast("string")).first()
    rows = table.read(spark, READING, [d for d in table.groups(spark) if first <= d <= last])
    return rows.filter((F.col("event_time") >= start) & (F.col("event_time") < end)).drop("event_date")


def jdbc(spark: SparkSession, url: str, table: str, start: datetime, end: datetime, partitions: int = 1, column: str = "event_time", **options: str) -> DataFrame:
    """Rows of a database table with start <= column < end, by several connections, each with an equal part of that time.

    Spark sends the bounds, the part and the columns to the database; no connection reads the rows of another.
    """
    read = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partitions > 1:
        zone = ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))
        said = lambda t: t.astimezone(zone).strftime("%Y-%m-%d %H:%M:%S.%f")
        read = read.options(partitionColumn=column, lowerBound=said(start), upperBound=said(end), numPartitions=partitions)
    return read.load().filter((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Health rules from a JSON document with the array ``rules``. The packaged ones by default, read on the driver."""
    if path is None:
        found = json.loads(RULES.read_text(encoding="utf-8"))["rules"]
        return spark.createDataFrame([tuple(float(r[n]) if isinstance(r.get(n), int) else r.get(n) for n in RULE_SCHEMA.names) for r in found], RULE_SCHEMA)
    document = spark.read.schema(T.StructType([T.StructField("rules", T.ArrayType(RULE_SCHEMA))])).option("multiLine", True).json(path)
    return document.select(F.inline("rules"))
