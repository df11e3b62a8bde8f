"""Line dedup by overlapping windows of three lines, with DataFrame functions only.

Each run of three neighbouring lines of a text is hashed. A window that occurs more than once in the corpus has one
first occurrence (least doc_id, then text hash, then line number); every later occurrence is removed. Windows overlap,
so what goes is the union of the line numbers that later occurrences cover.

A window is known by 96 bits (a 64-bit and a 32-bit hash of its lines). First occurrences come from one aggregation;
the join that marks the others is a plain equi-join, whose hot keys adaptive execution splits.

Defined cases: a null text stays null and has no lines; a text of fewer than three lines has no window and stays;
windows of blank lines only aren't counted; a very long text is split as a whole, and its windows are rows of their own,
so a task holds one text's lines at a time; rows with equal doc_id and equal text are the same document, so they get
the same result and don't count as repeats of one another; a null doc_id counts as greater than any other; an empty
table gives an empty result; extra columns pass through unless they carry the name of a column made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import LONG_MAX, table

_WINDOWS = """
transform(sequence(0, size(_wide) - 3), i -> struct(
  i as pos,
  xxhash64(_wide[i], _wide[i + 1], _wide[i + 2]) as w,
  hash(_narrow[i], _narrow[i + 1], _narrow[i + 2]) as v,
  _blank[i] and _blank[i + 1] and _blank[i + 2] as blank))
"""


def windows(docs: DataFrame) -> DataFrame:
    """One row for each window of three lines: _doc, _text_hash, pos, w, v."""
    lines = (
        docs.filter(F.col("text").isNotNull())
        .select(
            F.coalesce(F.col("doc_id"), F.lit(LONG_MAX)).alias("_doc"),
            F.xxhash64("text").alias("_text_hash"),
            F.split("text", "\n", -1).alias("_lines"),
        )
        .filter(F.size("_lines") >= 3)
        .select(
            "_doc",
            "_text_hash",
            F.transform("_lines", lambda x: F.xxhash64(x)).alias("_wide"),
            F.transform("_lines", lambda x: F.hash(x)).alias("_narrow"),
            F.transform("_lines", lambda x: F.trim(x) == "").alias("_blank"),
        )
    )
    return (
        lines.select("_doc", "_text_hash", F.explode(F.expr(_WINDOWS)).alias("_win"))
        .filter(~F.col("_win.blank"))
        .select("_doc", "_text_hash", "_win.pos", "_win.w", "_win.v")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what is left, and n_lines, n_removed (lines before, lines removed)."""
    made = ["n_lines", "n_removed", "_doc", "_text_hash", "_gone"]
    rows = docs.drop(*made)
    seen = windows(rows)
    place = F.struct("_doc", "_text_hash", "pos")
    repeated = (
        seen.groupBy("w", "v")
        .agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .filter(F.col("_first") != F.col("_last"))
        .drop("_last")
    )
    later = seen.join(repeated, ["w", "v"]).filter(place > F.col("_first")).select("_doc", "_text_hash", "pos")
    gone = later.groupBy("_doc", "_text_hash").agg(F.collect_set("pos").alias("_gone"))
    keyed = rows.withColumns({"_doc": F.coalesce(F.col("doc_id"), F.lit(LONG_MAX)), "_text_hash": F.xxhash64("text")})
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    # lines keep their numbers while those that later windows cover fall out of the set of numbers
    kept = F.array_except(
        F.sequence(F.lit(0), n_lines.cast("int") - 1),
        F.flatten(F.transform("_gone", lambda p: F.array(p, p + 1, p + 2))),
    )
    # a map of one split text over the kept numbers, so that the split is made once
    left = F.element_at(
        F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")), 1
    )
    marked = keyed.join(gone, ["_doc", "_text_hash"], "left").withColumns(
        {
            "n_lines": n_lines,
            "n_removed": F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(n_lines - F.size(kept)).cast("long"),
            "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left),
        }
    )
    return marked.select(*rows.columns, "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their lines, how many were removed, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP7_SQL = """
with lines as (
  select doc_id, md5(text) as th, text, string_split(text, chr(10)) as l from documents
), win as (
  select doc_id, th, i - 1 as pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as w
  from (select doc_id, th, l, unnest(range(1, len(l) - 1)) as i from lines where len(l) >= 3)
  where not (trim(l[i]) = '' and trim(l[i + 1]) = '' and trim(l[i + 2]) = '')
), ranked as (
  select doc_id, pos, row_number() over (partition by w order by doc_id, pos) as r from win
), gone as (
  select distinct doc_id, pos + k as p from ranked, (values (0), (1), (2)) as o(k) where r > 1
), kept as (
  select x.doc_id, count(*) as n, string_agg(x.line, chr(10) order by x.p) as text
  from (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as p from lines) x
  left join gone g on g.doc_id = x.doc_id and g.p = x.p
  where g.p is null group by x.doc_id
)
select d.doc_id, cast(coalesce(len(d.l), 0) as bigint) as n_lines,
       cast(coalesce(len(d.l), 0) - coalesce(k.n, 0) as bigint) as n_removed,
       case when d.text is null then null else coalesce(k.text, '') end as text
from lines d left join kept k on k.doc_id = d.doc_id
"""
