"""Suffix-array dedup: bytes of a text that repeat a smaller document, found through common-prefix intervals.

A byte goes if it's covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Texts are
UTF-8 bytes, overlaps count, and strings are judged on the input. The text is never cut into all its suffixes:

1. Of texts that are equal only the one with the least id goes on; the others are wholly removed (or too short).
2. Anchors. In each window of LENGTH bytes the K-byte string with the least hash is its anchor (the leftmost of equals).
   A window that two documents share has the same anchor in both, so suffixes that start at anchors are enough. Anchor
   hashes, about one for 17 bytes, are dealt by value; those of at least two documents are sent back to their documents.
3. Enhanced suffix array. Suffixes at these anchors (LENGTH bytes, with what stands before them) are dealt by the
   anchor's hash and sorted, with the common prefix of neighbours. A stack scan over the prefixes gives the intervals of
   the common-prefix tree, each with its depth and its parent's. An interval's strings of LENGTH bytes begin LENGTH - r
   bytes before the anchor for each r above the parent's depth and up to its own: if the bytes to the left agree across
   the interval, it's one repeat group as it stands; if they are diverse, it falls into a group for each left extension.
   Every group holds all its occurrences, not just neighbours, and all but those of its least document are marked.
4. Marks go back to their documents, where covered bytes are merged and cut.

Buckets follow the bytes of the table, about ``BUCKET_BYTES`` of text each. Hot strings: what occurs in many documents
of one slice of texts is combined there. Of an anchor hash only two documents go to its bucket, and of equal surroundings
only those of the least document; the rest are flagged or marked on the spot. Hot ids: texts are dealt by id and hash. Slices hold at most ``SLICE`` bytes or one text; very long texts are read in overlapping pieces.

Defined cases: a null text counts as empty; texts shorter than LENGTH stay; rows with equal doc_id and equal text are
one document, so both rows get the same result, and rows with equal doc_id never remove each other's bytes; a null
doc_id counts as greater than any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import LONG_MAX, table, text_or_empty
from pulsegrid.llm.repetition import slices

LENGTH = 50
K = 20
#: Places an anchor can have in a window of LENGTH bytes.
PLACES = LENGTH - K + 1
SLICE = 2 << 20
PIECE = 4 << 20
#: Text bytes for each bucket of anchors.
BUCKET_BYTES = 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- anchors ---------------------------------------------------------------------------------------------------------


def hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes at each place."""
    two = data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    n = len(data) - K + 1
    out = eight[:n] * _STEP
    out ^= out >> np.uint64(29)
    out += eight[8 : 8 + n]
    out *= _MIX
    out ^= out >> np.uint64(32)
    out += four[16 : 16 + n]
    out *= _STEP
    return out ^ (out >> np.uint64(31))


def anchors_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(places, hashes, low, high) of the anchors in joined texts; ends: where each text ends.

    The windows whose anchor is at a place begin between high and low bytes before it.
    """
    none = tuple(np.empty(0, dtype=t) for t in (np.int64, np.uint64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    own = hashes(data)
    n = len(own)
    # the hash's high bits order the strings; the place in the low bits makes the leftmost of equals the least
    order = own & ~np.uint64((1 << 24) - 1) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([order, np.full(-n % PLACES, _LAST)]).reshape(-1, PLACES)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - PLACES + 1
    least = np.minimum(behind[:m], ahead[PLACES - 1 : PLACES - 1 + m])
    whole = np.ones(m, dtype=bool)
    for back in range(1, LENGTH):  # windows that run over a text's end
        at = ends[:-1] - back
        whole[at[(at >= 0) & (at < m)]] = False
    window = np.flatnonzero(whole)
    if not len(window):
        return none
    place = (least[window] & np.uint64((1 << 24) - 1)).astype(np.int64)  # never falls from one window to the next
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    place = place[first]
    return place, own[place], place - window[last], place - window[first]


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(number of the text, place in it, hash, low, high) of all anchors."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        found: dict[int, tuple] = {}
        for start in range(0, len(texts[0]) - LENGTH + 1, PIECE - LENGTH + 1):
            _, place, own, low, high = anchors([texts[0][start : start + PIECE]])
            for p, h, a, b in zip((place + start).tolist(), own.tolist(), low.tolist(), high.tolist(), strict=True):
                _, a2, b2 = found.get(p, (h, a, b))
                found[p] = (h, min(a, a2), max(b, b2))
        place = np.array(sorted(found), dtype=np.int64)
        own, low, high = (np.array([found[q][i] for q in place.tolist()], dtype=t) for i, t in enumerate((np.uint64, np.int64, np.int64)))
        return np.zeros(len(place), dtype=np.int64), place, own, low, high
    ends = np.cumsum([len(t) for t in texts])
    place, own, low, high = anchors_of(np.frombuffer(b"".join(texts), dtype=np.uint8), ends)
    text = np.searchsorted(ends, place, side="right")
    return text, place - np.concatenate([[0], ends])[text], own, low, high


# ---- the enhanced suffix array ---------------------------------------------------------------------------------------


def suffix_array(right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of LENGTH bytes, and the common prefix of each with the row before it in that order."""
    words = np.zeros((len(right), -(-LENGTH // 8) * 8), dtype=np.uint8)
    words[:, :LENGTH] = right
    words = words.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    differ = np.ones((len(right), LENGTH + 1), dtype=bool)
    differ[1:, :LENGTH] = right[order[1:]] != right[order[:-1]]
    return order, differ.argmax(axis=1)


def intervals(prefix: np.ndarray, least: int) -> np.ndarray:
    """The intervals (first row, end, depth, parent's depth) of the common-prefix tree that are at least ``least`` deep.

    A stack scan: an interval opens where the prefix with the row before grows, and is complete where it falls below.
    """
    out: list[tuple[int, int, int, int]] = []
    stack = [(0, 0)]
    deep = np.where(prefix < least, 0, prefix)
    for row, depth in enumerate([*deep[1:].tolist(), 0], start=1):
        first = row - 1
        while stack[-1][0] > depth:
            top, first = stack.pop()
            out.append((first, row, top, max(depth, stack[-1][0])))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def mark(doc: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """For each anchor's surroundings, bit o is set if the string that begins o bytes before it is in a smaller document.

    left: PLACES - 1 bytes, the nearest first; right: LENGTH bytes from the anchor; n_left, n_right: how many are real.
    """
    marks = np.zeros(len(doc), dtype=np.int64)
    if len(doc) < 2:
        return marks
    order, prefix = suffix_array(right)
    doc, left, n_left, n_right = doc[order], left[order], n_left[order], n_right[order]
    # how far left neighbours in the order agree: an interval whose neighbours all do has no diversity so far
    differ = np.ones((len(doc), PLACES), dtype=bool)
    differ[1:, : PLACES - 1] = left[1:] != left[:-1]
    agree = differ.argmax(axis=1)
    first, end, depth, above = intervals(prefix, LENGTH - PLACES + 1).T
    extension = np.zeros(len(doc), dtype=np.uint64)
    found = np.zeros(len(doc), dtype=np.int64)
    for o in range(PLACES):
        if o:
            extension = (extension + left[:, o - 1] + np.uint64(1)) * _STEP
            extension ^= extension >> np.uint64(32)
        own = np.flatnonzero((depth >= LENGTH - o) & (above < LENGTH - o))  # intervals whose strings begin o bytes before
        if not len(own):
            continue
        size = end[own] - first[own]
        owner = np.repeat(np.arange(len(own)), size)
        rows = np.arange(len(owner)) + np.repeat(first[own] - (np.cumsum(size) - size), size)
        real = (n_left[rows] >= o) & (n_right[rows] >= LENGTH - o)
        interval = np.zeros(len(doc), dtype=np.int64)
        interval[rows] = owner
        rows = rows[real]
        # an interval is diverse if some neighbours in it differ in the o bytes to the left
        differs = np.concatenate([[0], np.cumsum(agree < o)])
        diverse = differs[end[own]] > differs[first[own] + 1]
        split = diverse[interval[rows]]
        for part, divided in ((rows[~split], False), (rows[split], True)):
            if not len(part):
                continue
            group = interval[part]
            change = np.ones(len(part), dtype=bool)
            if divided:
                by = np.lexsort((extension[part], group))
                part, group = part[by], group[by]
                change[1:] = (group[1:] != group[:-1]) | (extension[part[1:]] != extension[part[:-1]])
            else:
                change[1:] = group[1:] != group[:-1]
            at = np.flatnonzero(change)
            least = np.repeat(np.minimum.reduceat(doc[part], at), np.diff(np.append(at, len(part))))
            found[part[doc[part] > least]] |= 1 << o
    marks[order] = found
    return marks


def surroundings(texts: list[bytes], text: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """left, right, n_left, n_right of anchors, as ``mark`` takes them: no more than their own windows hold."""
    pad = b"\0" * LENGTH
    joined = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + LENGTH) - sizes
    at = begins[text] + place
    n_left, n_right = high.astype(np.uint8), (LENGTH - low).astype(np.uint8)
    left = joined[at[:, None] - 1 - np.arange(PLACES - 1)]
    right = joined[at[:, None] + np.arange(LENGTH)]
    left[np.arange(PLACES - 1) >= n_left[:, None]] = 0
    right[np.arange(LENGTH) >= n_right[:, None]] = 0
    return left, right, n_left, n_right


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """doc, text hash and bytes of runs of rows; the first three columns of the batch are these."""
    texts = batch.column(2).cast(pa.large_binary())
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in texts], dtype=np.int64)
    doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for start, length in slices(sizes, SLICE):
        yield doc[start : start + length], th[start : start + length], [x or b"" for x in texts.slice(start, length).to_pylist()]


# ---- the steps -------------------------------------------------------------------------------------------------------

_SENT = "bucket int, docs binary, hashes binary, more binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one type, squeezed one after the other (each by differences of neighbours, which ids and places favour)."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(x, prepend=x.dtype.type(0)) for x in arrays]).tobytes())


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind).reshape(n, -1), axis=1, dtype=kind)


def _short(th: np.ndarray) -> np.ndarray:
    """The part of a text's hash that leads an answer to it; texts of one id that share it get one another's answers, too."""
    return th & np.int64(0xFFFFFFFF)


def _ask(n_buckets: int):  # noqa: ANN202
    """Send anchor hashes to their buckets, with the documents that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())  # texts that equal a smaller document don't ask
            for doc, th, texts in _sliced(batch):
                text, _, own, _, _ = anchors(texts)
                if not len(own):
                    continue
                order = np.lexsort((text, doc[text], own))
                own, text = own[order], text[order]
                fresh = np.ones(len(own), dtype=bool)  # a text asks once for a hash
                fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
                own, text = own[fresh], text[fresh]
                at = np.flatnonzero(np.diff(own, prepend=~own[:1]))
                count = np.diff(np.append(at, len(own)))
                rank = np.arange(len(own)) - np.repeat(at, count)
                # of a hash that five or more texts of the slice have, two ask (of the least and the greatest id) and the
                # others take it as shared, which costs something but changes nothing if all have the same id
                known = np.repeat(count > 4, count) & (rank != 0) & (rank != np.repeat(count - 1, count))
                bucket = (own % np.uint64(n_buckets)).astype(np.int64)
                bucket[known] = -1 - (bucket[known] + int(doc[0])) % n_buckets
                rows = list(_by_bucket(bucket))
                texts_of = [np.unique(text[i], return_inverse=True) for _, i in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int32()),
                        pa.array([_pack(doc[u], _short(th[u])) for u, _ in texts_of], pa.binary()),
                        pa.array([own[i].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for _, i in rows], pa.binary()),  # 48 bits
                        pa.array([v.astype(np.uint16 if len(u) < 65_536 else np.uint32).tobytes() for u, v in texts_of], pa.binary()),
                    ],
                    ["bucket", "docs", "hashes", "more"],
                )

    return run


def _read(docs: bytes, hashes_: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = np.zeros((len(hashes_) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(hashes_, dtype=np.uint8).reshape(-1, 6)
    number = np.frombuffer(more, dtype=np.uint16 if len(more) == 2 * len(wide) else np.uint32)
    doc, short = _unpack(docs, np.int64, 2)
    return doc[number], short[number], wide.view(np.uint64).ravel()


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(starts, stops) of runs of equal keys in sorted rows."""
    change = np.ones(len(keys[0]), dtype=bool)
    change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(change)
    return at, [*at[1:].tolist(), len(change)] if len(at) else []


def _answer(key: tuple, group: pa.Table) -> pa.Table:
    """Hashes of a bucket that at least two documents have, for each text of these documents."""
    parts = [_read(*x) for x in zip(*(group.column(c).to_pylist() for c in ("docs", "hashes", "more")), strict=True)]
    doc, short, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    if key[0].as_py() >= 0:
        order = np.lexsort((doc, own))
        doc, short, own = doc[order], short[order], own[order]
        at, stops = _runs(own)
        several = np.repeat(doc[at] != doc[np.array(stops) - 1], np.array(stops) - at)
        doc, short, own = doc[several], short[several], own[several]
    order = np.lexsort((short, doc))
    doc, short, own = doc[order], short[order], own[order]
    at, stops = _runs(doc, short)
    packed = [own[a:b].view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for a, b in zip(at.tolist(), stops, strict=True)]
    return pa.table({"doc": pa.array(doc[at], pa.int64()), "short": pa.array(short[at], pa.int64()), "own": pa.array(packed, pa.binary())})


def _gather(n_buckets: int):  # noqa: ANN202
    """Send the surroundings of shared anchors to their buckets; of equal ones in a slice, those of the least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            asked, seen = batch.column(4).to_pylist(), 0
            for doc, th, texts in _sliced(batch):
                flags = asked[seen : seen + len(texts)]
                seen += len(texts)
                text, place, own, low, high = anchors(texts)
                short = own & ~np.uint64(0xFFFF)
                starts = np.searchsorted(text, np.arange(len(texts) + 1))
                shared = np.zeros(len(own), dtype=bool)
                for t, wanted in enumerate(flags):
                    if wanted:
                        wide = np.zeros((len(raw := b"".join(wanted)) // 6, 8), dtype=np.uint8)
                        wide[:, 2:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
                        shared[starts[t] : starts[t + 1]] = np.isin(short[starts[t] : starts[t + 1]], wide.view(np.uint64).ravel())
                text, place, own, low, high = text[shared], place[shared], own[shared], low[shared], high[shared]
                if not len(own):
                    continue
                left, right, n_left, n_right = surroundings(texts, text, place, low, high)
                lines = np.ascontiguousarray(np.hstack([left, right, n_left[:, None], n_right[:, None]]))
                _, same = np.unique(lines.view(f"V{lines.shape[1]}").ravel(), return_inverse=True)
                order = np.lexsort((doc[text], same))
                first = np.ones(len(order), dtype=bool)
                first[1:] = same[order[1:]] != same[order[:-1]]
                owner = doc[text[order]]
                least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
                again = np.zeros(len(order), dtype=bool)
                again[order] = owner > least  # as in a smaller document of this slice
                bucket = (own % np.uint64(n_buckets)).astype(np.int64)
                bucket[again] = -1 - (bucket[again] + int(doc[0])) % n_buckets
                rows = list(_by_bucket(bucket))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in rows], pa.int32()),
                        pa.array([_pack(doc[text[i]], place[i]) for _, i in rows], pa.binary()),
                        pa.array([squeeze.compress(lines[i][:, -2:].tobytes() if b < 0 else lines[i].tobytes()) for b, i in rows], pa.binary()),
                        pa.array([_pack(th[text[i]]) for _, i in rows], pa.binary()),
                    ],
                    ["bucket", "docs", "hashes", "more"],
                )

    return run


def _judge(key: tuple, group: pa.Table) -> pa.Table:
    """Marks of a bucket's anchors: for each document, places and bit masks of offsets."""
    spread = zstandard.ZstdDecompressor()
    doc, place = np.concatenate([_unpack(x, np.int64, 2) for x in group.column("docs").to_pylist()], axis=1)
    th = np.concatenate([_unpack(x, np.int64, 1)[0] for x in group.column("more").to_pylist()])
    raw = [np.frombuffer(spread.decompress(x), dtype=np.uint8) for x in group.column("hashes").to_pylist()]
    if key[0].as_py() >= 0:
        lines = np.concatenate([x.reshape(-1, PLACES - 1 + LENGTH + 2) for x in raw])
        left, right = lines[:, : PLACES - 1], lines[:, PLACES - 1 : -2]
        masks = mark(doc, left, right, lines[:, -2], lines[:, -1])
    else:  # wholly as in a smaller document: every string that fits
        sizes = np.concatenate([x.reshape(-1, 2) for x in raw]).astype(np.int64)
        offsets = np.arange(PLACES)
        fits = (sizes[:, :1] >= offsets) & (sizes[:, 1:] >= LENGTH - offsets)
        masks = (fits * (1 << offsets)).sum(axis=1)
    some = masks > 0
    doc, th, place, masks = doc[some], th[some], place[some], masks[some]
    order = np.lexsort((place, th, doc))
    doc, th, place, masks = doc[order], th[order], place[order], masks[order]
    at, stops = _runs(doc, th)
    packed = [_pack(place[a:b], masks[a:b]) for a, b in zip(at.tolist(), stops, strict=True)]
    return pa.table({"doc": pa.array(doc[at], pa.int64()), "th": pa.array(th[at], pa.int64()), "own": pa.array(packed, pa.binary())})


def covered(size: int, marks: list[bytes]) -> np.ndarray:
    """Whether each byte of a text is covered by a marked string."""
    place, masks = np.concatenate([_unpack(x, np.int64, 2) for x in marks], axis=1)
    change = np.zeros(size + 1, dtype=np.int64)
    for o in range(PLACES):
        begin = place[masks >> o & 1 == 1] - o
        np.add.at(change, begin, 1)
        np.add.at(change, begin + LENGTH, -1)
    return np.cumsum(change)[:size] > 0


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ths, texts, alone, marks, ids = (batch.column(i) for i in (1, 2, 3, 4, 5))
            out: list[tuple] = []
            for th, text, first, found in zip(ths.to_pylist(), texts.cast(pa.large_binary()), alone, marks.to_pylist(), strict=True):
                data = text.as_py()
                own = [x["own"] for x in found or () if x["th"] == th]
                if not first.is_valid and len(data) >= LENGTH:  # equals a smaller document
                    gone = np.ones(len(data), dtype=bool)
                elif first.is_valid and own:
                    gone = covered(len(data), own)
                else:
                    gone = None
                if gone is None:
                    kept, removed, spans = data, 0, 0
                else:
                    kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, spans, digest, kept = zip(*out, strict=True) if out else ([],) * 5
            columns = [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes kept."""
    text = text_or_empty()
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MAX))
    short = lambda th: F.col(th).bitwiseAND(F.lit(0xFFFFFFFF)).alias("short")
    least = docs.groupBy(F.sha2(text, 256).alias("sha"), F.xxhash64(text).alias("th")).agg(F.min(doc).alias("doc"))
    least = least.select("doc", short("th"), F.col("th").alias("first_th"), F.lit(True).alias("alone"))
    # One exchange of the texts, by document and part of the text's hash, serves all three steps that read them: a
    # repeated id, or none, is no hot key. The whole hash is compared in a form that doesn't ask for another exchange.
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).select("*", short("th")).repartition("doc", "short")
    same = (rows["doc"] == least["doc"]) & (rows["short"] == least["short"]) & (rows["th"].bitwiseXOR(least["first_th"]) == 0)
    rows = rows.join(least, same, "left").select(rows["doc"], rows["short"], "th", "text", "alone")
    asked = rows.select("doc", "th", "text", "alone").mapInArrow(_ask(n_buckets), _SENT)
    shared = asked.groupBy("bucket").applyInArrow(_answer, "doc long, short long, own binary").groupBy("doc", "short").agg(F.collect_list("own").alias("own"))
    sent = rows.join(shared, ["doc", "short"]).select("doc", "th", "text", "alone", "own").mapInArrow(_gather(n_buckets), _SENT)
    marks = sent.groupBy("bucket").applyInArrow(_judge, "doc long, th long, own binary").select("*", short("th")).groupBy("doc", "short").agg(F.collect_list(F.struct("th", "own")).alias("own"))
    judged = rows.join(marks, ["doc", "short"], "left").select("doc", "th", "text", "alone", "own", F.nullif("doc", F.lit(LONG_MAX)).alias("doc_id"))
    return judged.mapInArrow(_cut(with_text), _CUT + (", kept binary" if with_text else ""))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many bytes go, in how many runs, and the digest of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
