"""Tables that grow by micro-batches: folders by group (a date or a bucket), in each a part for a batch or a compaction.

    <path>/<group>=<value>/part=b-<batch>     rows of one batch; running the batch again replaces them
    <path>/<group>=<value>/part=c-<batch>     rows of all batches up to that one, compacted

The group leads, so a reader lists the folders of the groups that it needs and no others, however many batches there have
been. A compaction is visible at once: from then on readers take its part and the batches after it; what it has replaced
is removed afterwards, and not read if a crash leaves it there. Only batches that have ended may be compacted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "part"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of a folder's subfolders; none if it isn't there."""
    folder, files = _hadoop(spark, path)
    if not files.exists(folder):
        return []
    names = (s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory())
    return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))


def _number(part: str) -> int:
    return int(part[2:])


@dataclass(frozen=True)
class BatchTable:
    """One such table. group: the column that leads its layout; even: its groups are about equal, and many (buckets)."""

    path: str
    group: str
    even: bool = False

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of a batch (with the group column), in place of what the batch wrote before into the same groups."""
        self._put(rows, f"b-{batch_id:012d}")

    def _put(self, rows: DataFrame, part: str) -> None:
        # else each task would write a file into each group; a rebalance leaves all small groups to one task, which for many is slow
        rows = rows.withColumn(PART, F.lit(part))
        dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), self.group) if self.even else rows.hint("rebalance", self.group)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.group, PART).parquet(self.path)

    def groups(self, spark: SparkSession) -> list[str]:
        return folders(spark, self.path, f"{self.group}=")

    def _parts(self, spark: SparkSession, value: str) -> tuple[list[str], list[str]]:
        """(parts that count, parts that a compaction has replaced) of a group, in order of batches."""
        parts = sorted(folders(spark, f"{self.path}/{self.group}={value}", f"{PART}="), key=lambda p: (_number(p), p))
        last = max((p for p in parts if p[0] == "c"), key=_number, default=None)
        lives = [p for p in parts if last is None or p == last or (p[0] == "b" and _number(p) > _number(last))]
        return lives, [p for p in parts if p not in lives]

    def paths(self, spark: SparkSession, groups: Iterable[str] | None = None, before: int | None = None) -> list[str]:
        """Folders to read for these groups (all if none are given); before: without that batch and later ones."""
        return [
            f"{self.path}/{self.group}={g}/{PART}={p}"
            for g in (self.groups(spark) if groups is None else groups)
            for p in self._parts(spark, g)[0]
            if before is None or p[0] == "c" or _number(p) < before
        ]

    def read(self, spark: SparkSession, schema: T.StructType, groups: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """Rows of these groups. schema: of the rows with the group column."""
        found = self.paths(spark, groups, before)
        if not found:
            return spark.createDataFrame([], schema)
        return self._scan(spark, schema, found)

    def _scan(self, spark: SparkSession, schema: T.StructType, paths: list[str]) -> DataFrame:
        return spark.read.schema(schema).option("basePath", self.path).parquet(*paths).select(*schema.names)

    def compact(self, spark: SparkSession, schema: T.StructType, upto: int, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows, groups: Iterable[str] | None = None) -> None:
        """One part for all batches up to ``upto`` of each group, with what ``reduce`` leaves of their rows; one job for all groups.

        Groups with nothing new stay as they are, so running it again changes nothing.
        """
        spent: dict[str, list[str]] = {}
        todo: list[str] = []
        for g in self.groups(spark) if groups is None else groups:
            lives, old = self._parts(spark, g)
            merged = [p for p in lives if _number(p) <= upto]
            spent[g] = old
            if any(p[0] == "b" for p in merged):
                spent[g] = old + merged
                todo += [f"{self.path}/{self.group}={g}/{PART}={p}" for p in merged]
        if todo:
            self._put(reduce(self._scan(spark, schema, todo)), f"c-{upto:012d}")
        for g, parts in spent.items():
            for p in parts:  # from the oldest on
                folder, files = _hadoop(spark, f"{self.path}/{self.group}={g}/{PART}={p}")
                files.delete(folder, True)
