"""Periodic run detection: a sparse dynamic program over diagonals (lags) of a text's words.

A diagonal is a lag p; its state is a match length, how many words in a row equal the word p places earlier. A word's
earlier occurrences are what lets diagonals go on: each increments its lag, and a diagonal that no occurrence carries on
ends there. If its length is sufficient, it emits the run that it spans: a stretch with period p.

Taken word by word, each frequent word touches every lag between its occurrences, which is quadratic in a text that
repeats. So the diagonals that can't reach a sufficient length are never opened, and the others move by more than a word:

* Lags under 8 are swept for all words of a slice at once, one vector for each lag.
* For lags from k to 2k (k = 8, 16, 32, ...) a sufficient match has at least k words, so its first k words are a k-gram
  that occurs again p words on. Only earlier occurrences of the k-gram at such a distance, where no match has begun
  before, open a diagonal. Where occurrences lie at most k/2 apart (the gram is itself periodic) they form a group with
  equal steps, and a match can begin only at the first of a group, at its earlier or its later end; that bounds the
  openings of an octave by a small multiple of the words.
* An open diagonal's match length grows by grams: a gram of 2^j words that occurs at both places adds 2^j.

Grams are numbered exactly (a gram of 2k words is a pair of numbers of its halves), and only grams that occur twice in a
text keep a number, so ordinary texts end after one or two octaves.

A stretch whose period isn't its smallest is emitted once for each multiple; the smallest stays. Texts are taken one by
one: no shuffle; a task holds one Arrow batch, dealt into slices of at most ``SLICE_BYTES`` (or one text).

Defined cases: a null text counts as empty; a text without words, or without runs, has no runs and null values of the
longest; very long texts are a slice of their own, with memory of some 4 bytes for each word and doubling; ties for the
longest run go to the smallest start, then period; rows with equal ids or texts each keep their row; an empty table
gives an empty result; extra columns pass through unless they carry the name of a column made here.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lean, table
from pulsegrid.llm.repetition import slices

#: A run has at least so many words, and two periods.
LEAST = 12
#: Lags below this are swept for all words.
DENSE = 8
SLICE_BYTES = 2 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
MADE = {"text": "string", "runs": RUNS}


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, x) for each i and each x of low[i] <= x < high[i]."""
    count = np.maximum(high - low, 0)
    i = np.repeat(np.arange(len(low)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]


def numbered(keys: np.ndarray) -> np.ndarray:
    """Numbers for equal keys; -1 for keys that occur once."""
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    twice = count > 1
    return np.where(twice, np.cumsum(twice) - 1, -1)[inverse].astype(np.int32)


def gram_levels(words: np.ndarray) -> list[np.ndarray]:
    """For k = 1, 2, 4, ...: the number of the k-gram at each place, -1 where it occurs once; up to the last k that repeats."""
    levels = [numbered(words)]
    while True:
        last, k = levels[-1], 1 << (len(levels) - 1)
        at = np.flatnonzero(last[: max(0, len(last) - k)] >= 0)
        at = at[last[at + k] >= 0]
        found = numbered(last[at].astype(np.int64) * len(words) + last[at + k])
        if not (found >= 0).any():
            return levels
        level = np.full(len(words), -1, dtype=np.int32)
        level[at] = found
        levels.append(level)


def openings(words: np.ndarray, gram: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(y, p): places y where a match of the k-gram with the one p words on begins, k <= p < 2k."""
    at = np.flatnonzero(gram >= 0)
    at = at[np.argsort(gram[at], kind="stable")]
    n = len(words) + 2 * k
    key = gram[at] * np.int64(n) + at  # ordered by gram, then place
    first = np.ones(len(at), dtype=bool)
    first[1:] = np.diff(key) > k // 2
    heads = np.flatnonzero(first)
    # a later head with every earlier occurrence, and every later occurrence with an earlier head
    i, early = ranges(np.searchsorted(key, key[heads] - 2 * k, side="right"), np.searchsorted(key, key[heads] - k, side="right"))
    late = heads[i]
    others = np.flatnonzero(~first)
    i, j = ranges(np.searchsorted(key[heads], key[others] - 2 * k, side="right"), np.searchsorted(key[heads], key[others] - k, side="right"))
    early, late = np.concatenate([early, heads[j]]), np.concatenate([late, others[i]])
    y, x = at[early], at[late]
    begins = (y == 0) | (words[y - 1] != words[x - 1])
    return y[begins], (x - y)[begins]


def match_lengths(y: np.ndarray, x: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How many words from y on equal those from x on, for y < x: grown by grams of falling length."""
    length = np.zeros(len(y), dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        gram, k = levels[j], 1 << j
        inside = x + length < len(gram)
        a, b = gram[np.where(inside, y + length, 0)], gram[np.where(inside, x + length, 0)]
        length += np.where(inside & (a >= 0) & (a == b), k, 0)
    return length


def runs_of(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period, of codes of words.

    Words of different texts must have different codes; then one call finds the runs of all texts of a slice.
    """
    found = []
    for p in range(1, min(DENSE, len(words))):
        edges = np.flatnonzero(np.diff(words[p:] == words[:-p], prepend=False, append=False)).reshape(-1, 2)
        length = edges[:, 1] - edges[:, 0] + p
        good = length >= max(least, 2 * p)
        found.append(np.stack([edges[good, 0], length[good], np.full(int(good.sum()), p)], axis=1))
    levels = gram_levels(words) if len(words) > DENSE else []
    for j, gram in enumerate(levels):
        k = 1 << j
        if k < DENSE:
            continue
        y, p = openings(words, gram, k)
        length = match_lengths(y, y + p, levels) + p
        good = length >= np.maximum(least, 2 * p)
        found.append(np.stack([y[good], length[good], p[good]], axis=1))
    out = np.concatenate(found).astype(np.int64) if found else np.empty((0, 3), dtype=np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    smallest = np.ones(len(out), dtype=bool)
    smallest[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
    out = out[smallest]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def split_words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of joined texts (bytes), and where the words of each text end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~space
    starts[1:] &= space[:-1]
    if len(data):
        begins = ends[:-1][ends[:-1] < len(data)]
        starts[begins] = ~space[begins]
    kept = np.cumsum(~space)
    offsets = np.concatenate([kept[starts] - 1, kept[-1:]]).astype(np.int64)  # in the bytes without white space
    if not len(offsets):
        offsets = np.zeros(1, dtype=np.int64)
    n = np.concatenate([[0], np.cumsum(starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])]), n[ends]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Flags of words that stay: those in no run, or in the first period of each run that holds them."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def joined_texts(words: pa.Array, which: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """Words of the given numbers, joined by single spaces, for each text (ends: where its numbers end)."""
    taken = words.take(pa.array(which)).to_pylist()
    start = 0
    for end in ends.tolist():
        yield b" ".join(taken[start:end])
        start = end


Order = Callable[[list, np.ndarray], np.ndarray]


def collapse_runs(docs: DataFrame, least: int = LEAST, order: Order | None = None, key: str = "doc_id") -> DataFrame:
    """docs with runs (start, length, period; by start, then period) and text: words after a run's first period removed.

    Words of the text are joined by single spaces. order: for tests with planted runs, which word stands at each place,
    from the keys of a slice's rows and their numbers of words.
    """
    kept = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(key).cast("string").alias("_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(kept) + 1).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, length in slices(sizes, SLICE_BYTES):
                data = np.frombuffer(b"".join(texts.slice(start, length).to_pylist()), dtype=np.uint8)
                words, ends = split_words(data, np.cumsum(sizes[start : start + length]))
                coded = words.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.diff(ends, prepend=0)
                if order is not None:
                    code = code[order(batch.column(len(kept)).slice(start, length).to_pylist(), n)]
                found = runs_of(code * length + np.repeat(np.arange(length), n), least)
                stay = kept_words(len(code), found)
                left = np.concatenate([[0], np.cumsum(stay)])[ends]
                owner = np.searchsorted(ends, found[:, 0], side="right")
                found[:, 0] -= (ends - n)[owner]
                offsets = np.searchsorted(owner, np.arange(length + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], ["start", "length", "period"]))
                out = pa.array(joined_texts(coded.dictionary, code[stay], left), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, length) for i in range(len(kept))), out, runs], [*(f"c{i}" for i in range(len(kept))), *MADE])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"{c} {t}" for c, t in MADE.items())])
    return rows.mapInArrow(lean(run), schema).toDF(*kept, *MADE)


def planted(keys: list, n: np.ndarray) -> np.ndarray:
    """Places of words in a slice: in one row of ten (by a hash of its key; never a null key) words from some place on repeat."""
    out = np.arange(int(n.sum()))
    for key, size, begin in zip(keys, n.tolist(), (np.cumsum(n) - n).tolist(), strict=True):
        h = 1 if key is None else zlib.crc32(key.encode())
        if size and h % 10 == 0:
            g = h // 10
            a = g % size
            p = 1 + (size - a) // (3 + g % 8)
            out[begin + a : begin + size] = begin + a + np.arange(size - a) % p
    return out


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with planted runs: the number of runs, the longest one, and digests of the runs and of the text without repeats."""
    rows = collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), order=planted)
    longest = F.reduce(
        "runs",
        F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda best, x: F.when(best.isNull() | (x["length"] > best["length"]), x).otherwise(best),  # runs come by start, then period
    )
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    said = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return rows.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(said, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
