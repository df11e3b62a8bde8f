"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Defined cases, for every stage: a null text counts as empty (and stays null where the stage keeps it); a null doc_id is a
document like any other, and the last to be kept among near-duplicates; empty and very long texts go through like others;
rows with equal doc_id and equal text are one document, so line dedup gives both rows the same text and the near-duplicate
stage keeps one; an empty table gives an empty result; extra columns are kept, but for n_lines and n_removed, which line
dedup fills anew, and by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import encode_digests
from pulsegrid.llm.common import remove, scratch, shared_dir, table
from pulsegrid.llm.decontamination import keep_clean
from pulsegrid.llm.line_dedup import dedup_lines
from pulsegrid.llm.quality import keep_good
from pulsegrid.llm.similarity import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows; n_chars is counted anew."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints within two bits, or five-word shingles at 0.8), that with the least id."""
    return keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document that is left."""
    return encode_digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

#: The stages fit a classifier and encode with a vocabulary: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents. What a stage writes in between goes with it."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name.replace(' ', '_')}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)  # what the stage has read
        before = path
    return docs
