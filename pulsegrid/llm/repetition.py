"""Quality rules on repetition: how many characters of a text stand in duplicated n-grams and lines.

Words are numbered within a batch of texts, word numbers become random 64-bit codes, and a rolling polynomial over
them gives one hash for each run of n words, for several n at once over the whole batch. A run is duplicated if its
hash occurs again in the same text; the words under any duplicated run are covered, and what is measured is the share
of the text's word characters that is covered. Duplicated lines are measured alike.

Texts are judged one by one: the job needs no shuffle and a task holds one Arrow batch, dealt into slices of at most
``SLICE_BYTES`` (or one text).

Defined cases: a null text has no words and fails the base rule; so does an empty one; a very long text is a slice of
its own; ties and repeated rows need no care, since rows don't meet; an empty table gives an empty result; extra
columns pass through unless they carry the name of a column made here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Words of the window that the base rule counts.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Most share of the word characters that duplicated runs of n words may cover, and duplicated lines. the
#: falling scale published for web corpora, raised so that one boilerplate line said twice in a short text passes.
MAX_COVER = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
MAX_LINE_COVER = 0.30
SLICE_BYTES = 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Numbers to well-mixed 64-bit codes."""
    x = (x + np.uint64(1)) * _STEP
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n codes: the sum of codes times powers of an odd base."""
    out = np.zeros(max(0, len(codes) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * _STEP + codes[k : k + len(out)]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.isin(keys, twice) if len(twice) else np.zeros(len(keys), dtype=bool)


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The counts and cover shares of each text; one array for each column."""
    numbers: dict[str, int] = {}
    ids: list[int] = []
    ends = np.zeros(len(texts), dtype=np.int64)
    symbols, dup_lines, line_cover, chars = (np.zeros(len(texts), dtype=np.int64) for _ in range(4))
    for t, text in enumerate(texts):
        words = WORD.findall(text)
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        ends[t] = len(ids)
        chars[t] = sum(map(len, words))
        symbols[t] = sum(map(text.count, SYMBOLS))
        lines = text.split("\n")
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            twice = {x for x in lines if x in seen or seen.add(x)}
            first: set[str] = set()
            for line in lines:
                if line in twice and (size := sum(map(len, WORD.findall(line)))):
                    dup_lines[t] += line in first
                    line_cover[t] += size
                    first.add(line)
    n_words = np.diff(ends, prepend=0)
    word = np.array(ids, dtype=np.int64)
    size = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))[word] if len(word) else word
    owner = np.repeat(np.arange(len(texts)), n_words)
    # the text's number goes into the hash, so runs of other texts differ
    codes, of_text = _mix(word.astype(np.uint64)), _mix(owner.astype(np.uint64) + np.uint64(1 << 40))
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "line_cover": line_cover / np.maximum(chars, 1)}
    for n in sorted({*MAX_COVER, WINDOW}):
        if len(word) < n:
            covered = np.zeros(len(word), dtype=bool)
        else:
            whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
            keys = rolling(codes, n)
            keys = keys ^ of_text[: len(keys)]
            twice = np.zeros(len(keys), dtype=bool)
            twice[whole] = repeated(keys[whole])
            # a word is covered if one of the n runs over it is duplicated
            starts = np.concatenate([twice.astype(np.int32), np.zeros(n, dtype=np.int32)])
            starts[n:] -= twice
            covered = np.cumsum(starts)[: len(word)] > 0
        if n == WINDOW:
            out["n_repeat_words"] = np.bincount(owner[covered], minlength=len(texts)) if len(word) else np.zeros(len(texts), dtype=np.int64)
        if n in MAX_COVER:
            sums = np.bincount(owner[covered], weights=size[covered], minlength=len(texts)) if len(word) else np.zeros(len(texts))
            out[f"cover_{n}"] = sums / np.maximum(chars, 1)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    fine = out["line_cover"] <= MAX_LINE_COVER
    for n, most in MAX_COVER.items():
        fine &= out[f"cover_{n}"] <= most
    out["kept"] = ~out["base_failed"] & fine
    return out


_TYPES = {
    **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long"),
    **dict.fromkeys(("base_failed", "kept"), "boolean"),
    **dict.fromkeys(("line_cover", *(f"cover_{n}" for n in MAX_COVER)), "double"),
}


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows whose bytes sum to at most ``most``, or one row."""
    start, held = 0, 0
    for i, x in enumerate(sizes.tolist()):
        if held and held + x > most:
            yield start, i - start
            start, held = i, 0
        held += x
    if start < len(sizes):
        yield start, len(sizes) - start


def repetition(docs: DataFrame) -> DataFrame:
    """docs without text, with the columns of ``measure``."""
    kept = [c for c in docs.columns if c not in _TYPES and c != "text"]
    rows = docs.select(*kept, "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept))
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.large_binary())], dtype=np.int64)
            for start, length in slices(sizes):
                found = measure([x or "" for x in texts.slice(start, length).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, length) for i in range(len(kept))), *(pa.array(found[c]) for c in _TYPES)], [*kept, *_TYPES]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), *(f"{c} {t}" for c, t in _TYPES.items())])
    return rows.mapInArrow(judge, schema)


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: base counts, cover shares and the verdict."""
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(*first, *(F.col(c) for c in _TYPES if c not in first))
