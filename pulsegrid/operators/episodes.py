"""Alert episodes: breaching windows of a patient that overlap or touch are one episode.

Three forms. ``episodes`` is a function of the whole log of breach observations. ``merge`` brings a batch of observations
into stored episodes, which are intervals that carry what later batches need; in any order of arrival, with batches
replayed, it gives what ``episodes`` gives for the log of all batches. ``arrival_episodes`` follows the order of arrival
instead: an observation extends the patient's newest episode if that reaches its start, however old the window is, and
opens one otherwise. Nothing is retracted: a window that breached once stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("patient_id", "first_window_start", "last_window_end", "severity", "breaching_windows", "reasons", "max_heart_rate", "min_heart_rate", "min_spo2", "max_temperature")
#: A stored episode. window_ends: of its windows, so that a repeated observation isn't counted again (8 bytes each);
#: rank: of the observation that gave the reasons; gone: joined to another episode; batch_id: the version.
STATE = [
    T.StructField("patient_id", T.StringType()), T.StructField("first_window_start", T.TimestampType()), T.StructField("last_window_end", T.TimestampType()),
    T.StructField("severity", T.StringType()), T.StructField("breaching_windows", T.LongType()),
    T.StructField("reasons", T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("value", T.DoubleType())]))),
    T.StructField("max_heart_rate", T.IntegerType()), T.StructField("min_heart_rate", T.IntegerType()), T.StructField("min_spo2", T.DoubleType()), T.StructField("max_temperature", T.DoubleType()),
    T.StructField("window_ends", T.ArrayType(T.TimestampType())),
    T.StructField("rank", T.StructType([T.StructField("critical", T.BooleanType()), T.StructField("batch_id", T.LongType()), T.StructField("window_start", T.TimestampType())])),
    T.StructField("gone", T.BooleanType()), T.StructField("batch_id", T.LongType()),
]


#: Breach observations of a patient are brought into episodes by parts of so many seconds first.
TILE_SECONDS = 86_400


def _numbered(rows: DataFrame, start: str, end: str, *order: str, keys: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """rows with _reach (how far those before them in the order go) and _episode: one number for rows that overlap or touch."""
    by = Window.partitionBy(*keys).orderBy(*order)
    opens = F.coalesce(F.col(start) > F.col("_reach"), F.lit(True))
    reach = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_reach", reach).withColumn("_episode", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def episodes(log: DataFrame, tile_seconds: int = TILE_SECONDS) -> DataFrame:
    """log: batch_id, patient_id, window_start, window_end, severity, reasons, max/min extremes. Key: patient, first start.

    breaching_windows counts windows, not repeated observations; severity stays critical once it was; reasons are those
    of the last critical observation, or of the last one.

    Observations are dealt by patient and tile of their window's end, so that one patient's log is no single task; what
    overlaps or touches inside a tile becomes one interval, and only those meet by patient. A window's observations lie in
    one tile, so distinct windows add up.
    """
    tiles = log.withColumns({"_tile": F.floor(F.unix_micros("window_end") / F.lit(1_000_000 * tile_seconds)), "_critical": F.col("severity") == "critical"})
    tiles = tiles.withColumn("_rank", F.struct("_critical", "batch_id", "window_start"))
    parts = (
        _numbered(tiles, "window_start", "window_end", "window_start", "window_end", "batch_id", keys=("patient_id", "_tile"))
        .groupBy("patient_id", "_tile", "_episode")
        .agg(
            F.min("window_start").alias("first_window_start"),
            F.max("window_end").alias("last_window_end"),
            F.bool_or("_critical").alias("_critical"),
            F.count_distinct("window_end").alias("breaching_windows"),
            F.max_by("reasons", "_rank").alias("reasons"),
            F.max("_rank").alias("_rank"),
            *_extremes(),
        )
        .drop("_tile", "_episode")
    )
    return (
        _numbered(parts, "first_window_start", "last_window_end", "first_window_start", "last_window_end")
        .groupBy("patient_id", "_episode")
        .agg(
            F.min("first_window_start").alias("first_window_start"),
            F.max("last_window_end").alias("last_window_end"),
            F.when(F.bool_or("_critical"), "critical").otherwise("warning").alias("severity"),
            F.sum("breaching_windows").alias("breaching_windows"),
            F.max_by("reasons", "_rank").alias("reasons"),
            *_extremes(),
        )
        .drop("_episode")
    )


def _extremes() -> list[Column]:
    return [f(c).alias(c) for f, c in ((F.max, "max_heart_rate"), (F.min, "min_heart_rate"), (F.min, "min_spo2"), (F.max, "max_temperature"))]


def active(log_after: Callable[[Column], DataFrame], as_of: Column, active_seconds: int, horizon_seconds: int, oldest: Column | None = None) -> DataFrame:
    """Episodes that reach into the last active_seconds before as_of, whole, from a log that is read no further back than they go.

    log_after: the log of windows that end after a time. Episodes over it are whole unless one begins at or before that
    time; then the log is read twice as far back, until none does or the time is before ``oldest``. An episode that began
    after the time can't have a window before it, for that window would end before the episode begins.
    """
    while True:
        edge = as_of - F.make_dt_interval(secs=F.lit(horizon_seconds).cast("decimal(18,6)"))
        found = episodes(log_after(edge)).filter(F.col("last_window_end") > as_of - F.make_dt_interval(secs=F.lit(active_seconds).cast("decimal(18,6)")))
        open_left = found.filter(F.col("first_window_start") <= edge)
        if oldest is not None:
            open_left = open_left.filter(edge > oldest)
        if open_left.isEmpty():
            return found
        horizon_seconds *= 2


def as_state(log: DataFrame) -> DataFrame:
    """Observations as episodes of one window."""
    critical = F.col("severity") == "critical"
    return log.select(
        "patient_id", F.col("window_start").alias("first_window_start"), F.col("window_end").alias("last_window_end"), "severity", F.lit(1).cast("long").alias("breaching_windows"), "reasons",
        "max_heart_rate", "min_heart_rate", "min_spo2", "max_temperature", F.array("window_end").alias("window_ends"),
        F.struct(critical.alias("critical"), F.col("batch_id").cast("long").alias("batch_id"), "window_start").alias("rank"), F.lit(False).alias("gone"), F.col("batch_id").cast("long").alias("batch_id"),
    )


def merge(state: DataFrame, log: DataFrame) -> DataFrame:
    """The episodes that a batch's observations change, as rows of the table: new versions, and gone ones that were joined.

    state: current rows of at least those episodes that the observations overlap or touch. A merge may be repeated and
    batches may come in any order: union of intervals, distinct window ends and greatest ranks don't depend on it.
    """
    names = [f.name for f in STATE]
    old = state.filter(~F.col("gone")).select(*names, F.lit(False).alias("_new"))
    rows = old.unionByName(as_state(log).select(*names, F.lit(True).alias("_new")))
    stored = F.when(~F.col("_new"), F.col("first_window_start"))
    merged = (
        _numbered(rows, "first_window_start", "last_window_end", "first_window_start", "last_window_end")
        .groupBy("patient_id", "_episode")
        .agg(
            F.collect_set(stored).alias("_stored"),  # stored episodes that this one joins
            F.min("first_window_start").alias("first_window_start"),
            F.max("last_window_end").alias("last_window_end"),
            F.when(F.bool_or("rank.critical"), "critical").otherwise("warning").alias("severity"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("window_ends")))).alias("window_ends"),
            F.max_by("reasons", "rank").alias("reasons"),
            F.max("rank").alias("rank"),
            *_extremes(),
            F.max(F.when(F.col("_new"), F.col("batch_id"))).alias("batch_id"),
        )
        .filter(F.col("batch_id").isNotNull())
        .withColumns({"breaching_windows": F.size("window_ends").cast("long"), "gone": F.lit(False)})
    )
    first = F.col("first_window_start")
    versions = F.concat(F.array(first), F.filter("_stored", lambda x: x != F.col("first_window_start")))
    spread = merged.withColumn("_start", F.explode(versions)).withColumn("gone", F.col("_start") != first)
    return spread.withColumn("first_window_start", F.col("_start")).select(*names)


def shown(state: DataFrame) -> DataFrame:
    """Current rows of the table as episodes."""
    return state.filter(~F.col("gone")).select(*COLUMNS)


def arrival_episodes(log: DataFrame) -> DataFrame:
    """Episodes in order of arrival (batch, then window start): what a program keeps that sees one observation after the other.

    An observation extends the patient's episode with the greatest end if that is at or after its start (an old window
    extends it too, and leaves its start), and opens one otherwise. So what decides is how far all earlier arrivals
    reach, which is a running maximum: no state is carried from row to row. breaching_windows counts arrivals that move
    the end; severity stays critical; reasons are those of the last critical arrival, or of the last one.
    """
    critical = F.col("severity") == "critical"
    arrival = F.struct("batch_id", "window_start", "window_end")
    moves = F.coalesce(F.col("window_end") > F.col("_reach"), F.lit(True))
    return (
        _numbered(log, "window_start", "window_end", "batch_id", "window_start", "window_end")
        .groupBy("patient_id", "_episode")
        .agg(
            F.min_by("window_start", arrival).alias("first_window_start"),
            F.max("window_end").alias("last_window_end"),
            F.when(F.bool_or(critical), "critical").otherwise("warning").alias("severity"),
            F.count_if(moves).alias("breaching_windows"),
            F.max_by("reasons", F.struct(critical, "batch_id", "window_start", "window_end")).alias("reasons"),
            *_extremes(),
        )
        .drop("_episode")
    )
