"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised (A-Z in small letters; each run of ASCII white space, punctuation and control characters is one
space) and compared as UTF-8 bytes. A document is contaminated by a benchmark item if some window of ``WINDOW`` bytes
of the item (the whole item, if shorter) occurs in the document with at most ``EDITS`` edits; a shorter window has an
edit budget in proportion. An item of less than q bytes has no q-gram: it must occur as it is, as whole words.

By the q-gram lemma such a window keeps at least T = w + 1 - q (e + 1) of its q-grams, and e edits move it across at
most e + 1 diagonals. So every q-gram of a document is looked up in the benchmark's, hits are counted in diagonal bands
that overlap by half, and only places where T hits of one band lie within w + e bytes go on. Windows that keep enough
short q-grams there, too, are verified by banded alignment of the item's windows. The filter loses nothing; the alignment decides.

The benchmark's index travels to the tasks: its size is checked, and a benchmark of over ``BLOCK_BYTES`` is dealt by a
hash into blocks that are searched one after the other, so that a worker holds one block's index. With one block,
documents aren't moved: no shuffle. With several, each search writes only the hashes of texts with a hit and their items;
these are joined with the documents once, at the end.

Defined cases: a null document text counts as empty, a null or empty benchmark text (once normalised) matches nothing;
very long texts are searched whole; equal items match alike; repeated rows are judged each; an empty table on either
side gives clean documents or no rows; extra columns pass through unless they carry the name of a column made here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lean, table, write_table
from pulsegrid.llm.repetition import slices

Q = 10
WINDOW = 60
EDITS = 4
#: Size of the q-grams that are counted once more before an alignment.
SHORT = 3
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
_BITS = 22
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256))


def normal(text: str | None) -> bytes:
    """The bytes that are compared."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_FOLD).split())


def budget(size: int) -> tuple[int, int, int]:
    """(window, edits, least shared q-grams) for an item of so many bytes."""
    w = min(size, WINDOW)
    e = max(0, min(EDITS * w // WINDOW, w // Q - 1))
    return w, e, w + 1 - Q * (e + 1)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place."""
    one = data.astype(np.uint64)
    two = one[:-1] << np.uint64(8) | one[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(data) - Q + 1
    out = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (two[8 : 8 + n] * np.uint64(0xBF58476D1CE4E5B9))
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x94D049BB133111EB)


@dataclass
class Index:
    """q-grams of benchmark items: sorted hashes, and for each the places (item, offset) that have it; and items without any.

    short: items of less than q bytes as words, with their numbers; ids and texts hold these last.
    """

    ids: list[int]
    texts: list[bytes]
    hashes: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    offsets: np.ndarray
    present: np.ndarray
    short: dict[tuple[bytes, ...], list[int]]

    @staticmethod
    def build(rows: list[tuple[int, str | None]]) -> Index | None:
        every = [(i, t) for i, x in rows if i is not None and (t := normal(x))]
        if not every:
            return None
        kept = [(i, t) for i, t in every if len(t) >= Q]
        small = [(i, t) for i, t in every if len(t) < Q]
        short: dict[tuple[bytes, ...], list[int]] = {}
        for number, (_, t) in enumerate(small, start=len(kept)):
            short.setdefault(tuple(t.split()), []).append(number)
        found = [grams(np.frombuffer(t, dtype=np.uint8)) for _, t in kept] or [np.empty(0, dtype=np.uint64)]
        joined = np.concatenate(found)
        order = np.argsort(joined, kind="stable")
        hashes, starts = np.unique(joined[order], return_index=True)
        present = np.zeros(1 << _BITS, dtype=bool)
        present[hashes >> np.uint64(64 - _BITS)] = True
        items = np.repeat(np.arange(len(kept), dtype=np.int32), [len(f) for f in found[: len(kept)]])[order]
        offsets = np.concatenate([np.arange(len(f), dtype=np.int32) for f in found])[order]
        return Index([i for i, _ in kept + small], [t for _, t in kept + small], hashes, np.append(starts, len(joined)).astype(np.int32), items, offsets, present, short)

    def whole_words(self, text: bytes) -> set[int]:
        """Short items that occur in a normalised text as whole words."""
        words = text.split()
        sizes = {len(w) for w in self.short}
        return {k for n in sizes for i in range(len(words) - n + 1) for k in self.short.get(tuple(words[i : i + n]), ())}

    def search(self, texts: list[bytes]) -> list[set[int]]:
        """For each normalised text, the items (by number) that contaminate it."""
        out = [self.whole_words(t) for t in texts] if self.short else [set() for _ in texts]
        if not len(self.hashes):
            return out
        joined = b"\0".join(texts) + b"\0" * Q
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        places, numbers = [], []
        for start in range(0, len(data) - Q + 1, 1 << 16):
            own = grams(data[start : start + (1 << 16) + Q - 1])
            maybe = np.flatnonzero(self.present[own >> np.uint64(64 - _BITS)])
            at = np.searchsorted(self.hashes, own[maybe])
            at[at == len(self.hashes)] = 0
            real = self.hashes[at] == own[maybe]
            places.append(maybe[real] + start)
            numbers.append(at[real])
        place, number = np.concatenate(places), np.concatenate(numbers)
        if not len(place):
            return out
        copies = self.starts[number + 1] - self.starts[number]
        i = np.repeat(place, copies).astype(np.int64)
        entry = np.repeat(self.starts[number], copies) + np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
        item, j = self.items[entry], self.offsets[entry]
        doc = np.searchsorted(ends, i, side="right")
        bounds = np.array([budget(len(t)) for t in self.texts])
        step = EDITS + 1
        for shift in (0, 1):
            band = (i - j) // step + shift >> 1  # bands of two steps; the shifted ones overlap them by half
            order = np.lexsort((i, band, doc, item))
            self._bands(order, i, j, item, doc, band, bounds, joined, ends, out)
        return out

    def _bands(self, order, i, j, item, doc, band, bounds, joined, ends, out) -> None:  # noqa: ANN001
        i, j, item, doc, band = i[order], j[order], item[order], doc[order], band[order]
        w, e, least = bounds[item].T
        last = np.arange(len(i)) + least - 1
        fits = last < len(i)
        k = np.flatnonzero(fits)
        m = last[k]
        near = (item[k] == item[m]) & (doc[k] == doc[m]) & (band[k] == band[m]) & (i[m] - i[k] <= w[k] + e[k] - Q)
        for a, b in zip(k[near].tolist(), m[near].tolist(), strict=True):
            d, t = int(doc[a]), int(item[a])
            if t in out[d]:
                continue
            end = int(ends[d]) - 1
            begin = int(ends[d - 1]) if d else 0
            if self._aligned(self.texts[t], joined[begin:end], int(i[a]) - begin, int(i[b]) - begin, j[a : b + 1], int(w[a]), int(e[a])):
                out[d].add(t)

    def _aligned(self, item: bytes, text: bytes, first: int, last: int, js: np.ndarray, w: int, e: int) -> bool:
        """Whether a window of the item that may hold these hits occurs near them with at most e edits."""
        diagonals = (first - int(js[0]), last - int(js[-1]))
        low, high = max(0, int(js.max()) + Q - w - 2 * e), min(int(js.min()) + 2 * e, len(item) - w)
        if low > high:
            low, high = max(0, min(low, len(item) - w)), max(0, min(max(low, high), len(item) - w))
        windows = list(range(low, high + 1))
        if any(text.startswith(item[s : s + w], s + d) for d in set(diagonals) for s in windows if s + d >= 0):
            return True
        if not e:
            return False
        slack = 2 * e + abs(diagonals[0] - diagonals[1])
        # the lemma once more with short q-grams: a window within the budget keeps w + 1 - SHORT (e + 1) of them
        near = text[max(0, low + diagonals[0] - slack) : max(0, high + w + diagonals[0] + slack)]
        known = {near[k : k + SHORT] for k in range(len(near) - SHORT + 1)}
        held = np.cumsum([0, *(item[k : k + SHORT] in known for k in range(low, high + w - SHORT + 1))])
        kept = held[w - SHORT + 1 :] - held[: -(w - SHORT + 1)]
        likely = low + np.flatnonzero(kept >= w + 1 - SHORT * (e + 1))
        return len(likely) > 0 and bool((banded(item, text, likely, w, diagonals[0], slack) <= e).any())


def banded(item: bytes, text: bytes, starts: np.ndarray, w: int, diagonal: int, slack: int) -> np.ndarray:
    """For each window item[s : s + w], the least edits to any stretch of text on diagonals within slack of one."""
    width = 2 * slack + 1
    padded = np.full(len(text) + 2 * (w + width), 255, dtype=np.uint8)  # 255 is no byte of UTF-8
    padded[w + width : w + width + len(text)] = np.frombuffer(text, dtype=np.uint8)
    letters = np.frombuffer(item, dtype=np.uint8)
    base = starts + diagonal - slack + w + width
    cost = np.zeros((len(starts), width), dtype=np.int16)  # free start anywhere in the band
    steps = np.arange(width, dtype=np.int16)
    cells = np.arange(width)
    for r in range(w):
        at = np.clip(base[:, None] + r + cells[None, :], 0, len(padded) - 1)
        swap = cost + (padded[at] != letters[starts + r][:, None])
        drop = np.full_like(cost, 30_000)
        drop[:, :-1] = cost[:, 1:] + 1  # the item's letter has no partner
        best = np.minimum(swap, drop)
        # letters of the text without a partner: the least of best[c'] + (c - c') over c' <= c
        cost = np.minimum.accumulate(best - steps, axis=1) + steps
    return cost.min(axis=1)


def _indexes(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[int, int, Index]]:
    """(block, number of blocks, index) of the blocks of a benchmark; each is at most about block_bytes of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    for block in range(n_blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else benchmark
        index = Index.build([(r[0], r[1]) for r in part.select(F.col("item_id").cast("long"), "text").collect()])
        if index is not None:
            yield block, n_blocks, index


def _searched(rows: DataFrame, index: Index) -> DataFrame:
    """rows with item_ids: the items of one index found in the text (ascending, none: empty)."""
    names, at = list(rows.columns), rows.columns.index("text")
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(at)
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.large_binary())], dtype=np.int64)
            for start, length in slices(sizes):
                found = index.search([normal(x) for x in texts.slice(start, length).to_pylist()])
                ids = [sorted({index.ids[t] for t in new}) for new in found]
                part = batch.slice(start, length)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(names))), pa.array(ids, pa.list_(pa.int64()))], [*names, "item_ids"])

    return rows.mapInArrow(lean(judge), rows.withColumn("item_ids", F.array().cast("array<long>")).schema)


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with item_ids (array of the items found in the text, ascending) and contaminated."""
    rows = docs.drop("item_ids", "contaminated")
    none = F.array().cast("array<long>")
    out, hits = rows.withColumn("item_ids", none), None
    for _, n_blocks, index in _indexes(benchmark, block_bytes):
        if n_blocks == 1:
            out = _searched(rows, index)
            break
        # of texts with a hit: hashes and length, which tell texts apart, and the items
        found = _searched(rows.select("text"), index).filter(F.size("item_ids") > 0)
        found = found.select(*(c.alias(n) for n, c in _text_key().items()), F.explode("item_ids").alias("_item")).distinct()
        found = write_table(found, "contamination")
        hits = found if hits is None else hits.unionByName(found)
    if hits is not None:
        items = hits.distinct().groupBy(*_text_key()).agg(F.array_sort(F.collect_set("_item")).alias("item_ids"))
        keyed = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), *(c.alias(n) for n, c in _text_key().items()))
        out = keyed.join(items, [*_text_key()], "left").select("row.*", F.coalesce("item_ids", none).alias("item_ids"))
    return out.withColumn("contaminated", F.size("item_ids") > 0)


def _text_key() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"_text_hash": F.xxhash64(text), "_text_crc": F.crc32(text.cast("binary")), "_text_size": F.octet_length(text)}


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the benchmark items found in them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    return contamination(docs, benchmark).filter(~F.col("contaminated")).select(*docs.columns)
