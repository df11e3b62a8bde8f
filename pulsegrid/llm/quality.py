"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

1. Each text gives ``STATISTICS`` numbers (lengths, shares of kinds of characters, repetition). Nothing else of a row is
   an input: no id, source, language or label.
2. Random Fourier features of the standardised numbers approximate a Gaussian kernel. Each partition of the labelled
   rows sums its normal equations; the sums are added by row of the matrix, and only the (D + 1) x (D + 2) total goes to
   the driver, whatever the corpus size. A ridge solution of it scores any row.
3. Scores of labelled rows left out of the fit are counted in ``BINS`` equal bins; pooling adjacent violators over the
   bins gives a rising map from raw score to the share of good rows.

The model is fitted on about ``FIT_ROWS`` labelled documents, or all if there are fewer: a share of them by a hash of
the id. Their ids are few enough to be broadcast, so only their texts are measured for the fit; then every text of the
table is measured and scored in one pass, where it lies.

Defined cases: a null text counts as empty and is scored like any other; a very long text is measured whole; several
labels of a document are averaged; a null label is none; a null doc_id is scored, not held out, and has no label;
repeated rows are scored each; without labels every score is 1 (nothing to reject by); an empty table gives an empty
result; extra columns are ignored, and kept by ``keep_good``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lean, table, text_or_empty, write_table

STATISTICS = (
    "log_words", "log_lines", "mean_word", "sd_word", "long_words", "alphabetic", "digits", "capitals", "symbols", "stops", "commas",
    "white", "other_ascii", "beyond_ascii", "entropy", "distinct_words", "top_word", "repeated_lines", "repeated_triples", "ended_lines",
    "capital_words", "bare_words", "words_per_line",
)
THRESHOLD = 0.7
FEATURES = 256
#: Width of the kernel, in standard deviations of a statistic times the root of their number.
WIDTH = 2.0
RIDGE = 1e-3
BINS = 4096
#: Labelled documents that a model is fitted and calibrated on, about.
FIT_ROWS = 20_000
SEED = 11
_ALPHA = re.compile(r"[^\W\d_]")


def _class(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars])


_DIGITS, _CAPITALS, _SMALL = np.arange(48, 58), np.arange(65, 91), np.arange(97, 123)
_SYMBOLS, _STOPS, _COMMAS, _WHITE = _class("#*$%&|<>@=_~^{}[]\\/+"), _class(".!?"), _class(",;:"), _class(" \t\n\r\v\f")


def statistics(text: str) -> list[float]:
    """The numbers of one text, in the order of STATISTICS."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    count = np.bincount(data, minlength=256)
    n = max(1, len(data))
    share = lambda codes: float(count[codes].sum()) / n
    words = text.split()
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(1, len(lines))
    triples = max(1, len(words) - 2)
    seen = count[count > 0] / n
    small, capital = float(count[_SMALL].sum()), float(count[_CAPITALS].sum())
    beyond = float(count[128:].sum()) / n
    return [
        np.log1p(len(words)), np.log1p(len(lines)), float(lengths.mean()), float(lengths.std()), float((lengths > 18).mean()),
        (small + capital) / n + beyond, share(_DIGITS), capital / max(1.0, small + capital), share(_SYMBOLS), share(_STOPS), share(_COMMAS),
        share(_WHITE), max(0.0, 1 - (small + capital) / n - beyond - share(_DIGITS) - share(_SYMBOLS) - share(_STOPS) - share(_COMMAS) - share(_WHITE)),
        beyond, float(-(seen * np.log2(seen)).sum()) if len(seen) else 0.0, len(kinds) / n_words ** 0.8, max(kinds.values(), default=0) / n_words,
        1 - len(set(lines)) / n_lines, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0.0,
        sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / n_lines, sum(map(str.isupper, words)) / n_words,
        sum(not _ALPHA.search(w) for w in kinds) / max(1, len(kinds)), np.log1p(len(words) / n_lines),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    """The statistics of texts, one row each; a null counts as empty."""
    return np.array([statistics(x.as_py() or "") for x in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics, _y (mean label) and _fold of about fit_rows labelled documents of docs; fold 2 is left out."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.avg(F.col("quality").cast("double")).alias("_y")).withColumn("_fold", fold()).filter("_fold <> 2")
    total = marks.count()
    if total > fit_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(fit_rows / total * (1 << 30)))
    names = [*STATISTICS, "_y", "_fold"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in np.ascontiguousarray(found.T)), batch.column(1), batch.column(2)], names)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).join(F.broadcast(marks), "doc_id").select("text", "_y", "_fold")
    return rows.mapInArrow(lean(compute), ", ".join(f"{n} double" for n in [*STATISTICS, "_y"]) + ", _fold long")


def fold() -> Column:
    """0 to 3 by the checksum of the id as text; fold 2 is held out, fold 3 calibrates."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


@dataclass
class Model:
    """All that scoring needs; its size depends on FEATURES and BINS alone."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.shift) * np.sqrt(2 / self.weights.shape[1]), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated share of good rows; a thousandth keeps the order of raw scores inside a level."""
        if not len(self.at):
            return np.ones(len(x))
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return (np.clip((raw + 0.5) / 2, 0, 1 - 1e-9) * BINS).astype(np.int32)


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins: the centre and level of each block."""
    blocks: list[list[float]] = []
    for x, g, m in zip(at.tolist(), good.tolist(), n.tolist(), strict=True):
        blocks.append([g, m, x * m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, m2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + m2, blocks[-1][2] + x2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from the rows of docs (doc_id, text) that labels (doc_id, quality) marks, fold 2 left out."""
    names = list(STATISTICS)
    rng = np.random.default_rng(SEED)
    weights = rng.normal(size=(len(names), FEATURES)) / (WIDTH * np.sqrt(len(names)))
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    known = write_table(labelled(docs, labels, fit_rows), "quality-labelled")
    summary = known.agg(*(F.avg(n).alias(f"a_{n}") for n in names), *(F.stddev_pop(n).alias(f"s_{n}") for n in names), F.count("*").alias("n")).first()
    empty = np.empty(0)
    if not summary["n"]:
        return Model(np.zeros(len(names)), np.ones(len(names)), weights, shift, np.zeros(FEATURES + 1), empty, empty)
    centre = np.array([summary[f"a_{n}"] for n in names])
    scale = np.maximum(np.array([summary[f"s_{n}"] for n in names]), 1e-6)
    model = Model(centre, scale, weights, shift, np.zeros(FEATURES + 1), empty, empty)

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z, y = model.lift(columns(batch)), batch.column(len(names)).to_numpy()
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        row = np.sum([x.as_py() for x in group.column("row")], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([row], pa.list_(pa.float64()))})

    use = [*names, "_y"]
    # folds 0 and 1 fit; if they hold no row, all folds but the held-out one do
    own = known.filter("_fold < 2") if not known.filter("_fold < 2").isEmpty() else known
    parts = own.select(*use).mapInArrow(sums, "i int, row array<double>")
    found = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").collect()
    total = np.array([r["row"] for r in sorted(found, key=lambda r: r["i"])])
    gram = total[:, :-1]
    penalty = RIDGE * max(gram[-1, -1], 1.0) * np.eye(len(gram)) / FEATURES
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(gram + penalty, total[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(columns(batch))
            yield pa.RecordBatch.from_arrays([pa.array(bin_of(raw)), pa.array(raw), batch.column(len(names))], ["bin", "raw", "y"])

    rest = known.filter("_fold = 3") if not known.filter("_fold = 3").isEmpty() else known
    counted = rest.select(*use).mapInArrow(bins, "bin int, raw double, y double").groupBy("bin")
    counted = sorted(counted.agg(F.avg("raw").alias("at"), F.sum("y").alias("good"), F.count("*").alias("n")).collect(), key=lambda r: r["bin"])
    model.at, model.level = isotonic(*(np.array([r[c] for r in counted], dtype=float) for c in ("at", "good", "n")))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(matrix(batch.column(2))))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold() == 2).alias("held_out"), text_or_empty().alias("text"))
    out = rows.mapInArrow(lean(score), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return scored(docs, fit(docs, labels, fit_rows))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(matrix(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(lean(judge), docs.schema)
