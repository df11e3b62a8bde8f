"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put into a seeded random order; the row of rank r among n gets the fractional rank
(r + u) / n, where u is a seeded number of the source between 0 and 1 (so that many small sources don't all fall on
one place). Sorting all rows by it interleaves the sources in proportion, so any run of neighbouring rows holds
the corpus mixture, and cutting the order into equal runs gives shards that match it.

No rank is taken over a whole source or over the whole corpus in one task. A row's rank is the number of rows in
earlier hash ranges of its source (prefix sums over counts per range, in two levels) plus its rank inside its own range.
The number of ranges follows the row count, so a range holds about ``rows_per_range`` rows whatever share a source has.

Defined cases: a null text has no bytes (size 1, checksum 0), and a very long one counts by its bytes alone; a null
source is a stratum of its own; a null doc_id is an id like any other; equal rows are kept, each with a slot; extra
columns pass through unless they are called shard or slot, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, table, text_or_empty

#: The hash that orders rows is read as a number of this many bits.
ORDER_BITS = 48


def _ranges(position: Column, n_ranges: int) -> Column:
    """The range of a 48-bit position; ranges have equal width."""
    return F.floor(position / F.lit(float(1 << ORDER_BITS)) * F.lit(float(n_ranges))).cast("int")


def _seeded(*parts: Column | str) -> Column:
    """A 48-bit number from the MD5 of the parts: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _before(counts: DataFrame, group: list[str], n_ranges: int) -> DataFrame:
    """group, _range, _before (rows in earlier ranges of the group), _size (rows in the group). counts: group, _range, _n.

    Two levels of prefix sums, over blocks of ranges and inside each block, so that no task sees more than about the root
    of a group's ranges.
    """
    counts = counts.withColumn("_block", F.floor(F.col("_range") / max(1, int(n_ranges**0.5))))
    earlier = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(*group, "_block").agg(F.sum("_n").alias("_n"))
    blocks = blocks.withColumns({"_earlier": earlier(group, "_block"), "_size": F.sum("_n").over(Window.partitionBy(*group))}).drop("_n")
    inside = counts.withColumn("_inside", earlier([*group, "_block"], "_range"))
    return inside.join(blocks, [*group, "_block"]).select(*group, "_range", (F.col("_inside") + F.col("_earlier")).alias("_before"), "_size")


def interleave(docs: DataFrame, n_shards: int = 16, seed: int = 20, rows_per_range: int = 1000) -> DataFrame:
    """Add shard (0 to n_shards - 1) and slot (gapless from 0 in each shard): counts of shards differ by one at most.

    docs needs doc_id and source. Rows of equal id are told apart by text_crc32, or by the checksum of text, if there is one
    of these. Law kept: ``rows``.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    crc = F.col("text_crc32") if "text_crc32" in kept else F.crc32(text_or_empty().cast("binary")) if "text" in kept else F.lit(0)
    rows = docs.select(
        F.struct(*kept).alias("_row"),
        F.col("doc_id").alias("_doc"),
        crc.cast("long").alias("_crc"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("_stratum"),
    ).withColumn("_at", _seeded(F.lit(str(seed)), F.col("_doc").cast("string"), F.col("_crc").cast("string")))
    total = rows.count()
    if total == 0:
        return rows.select("_row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n_ranges = max(1, -(-total // rows_per_range))
    rows = rows.withColumn("_range", _ranges(F.col("_at"), n_ranges))

    # rank of a row within its stratum: rows in earlier ranges, plus its rank inside the range
    counts = _before(rows.groupBy("_stratum", "_range").agg(F.count("*").alias("_n")), ["_stratum"], n_ranges)
    inside = Window.partitionBy("_stratum", "_range").orderBy("_at", "_doc", "_crc")
    phase = _seeded(F.lit(str(seed)), F.col("_stratum")) / F.lit(float(1 << ORDER_BITS))
    share = (F.col("_before") + F.col("_rank") + phase) / F.col("_size")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1).join(counts, ["_stratum", "_range"])
    ranked = ranked.select("_row", "_doc", "_crc", "_stratum", F.floor(share * F.lit(float(1 << ORDER_BITS))).cast("long").alias("_key"))
    ranked = cut(ranked)

    # rank among all rows by fractional rank, again range by range
    ranked = ranked.withColumn("_range", _ranges(F.col("_key"), n_ranges))
    spans = _before(ranked.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0)), ["_all"], n_ranges).select("_range", "_before")
    inside = Window.partitionBy("_range").orderBy("_key", "_stratum", "_doc", "_crc")
    placed = ranked.withColumn("_rank", F.row_number().over(inside) - 1).join(spans, "_range")
    placed = placed.withColumn("_place", F.col("_before") + F.col("_rank"))
    shard = F.expr(f"cast((_place * {n_shards}) div {total} as int)")
    # the first place of shard s is the least p with p * n_shards >= s * total
    first = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select("_row.*", "shard", (F.col("_place") - first).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text_or_empty()).cast("long") + 1).alias("size"),
        F.crc32(text_or_empty().cast("binary")).cast("long").alias("text_crc32"),
    )
    return interleave(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
