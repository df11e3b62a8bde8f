"""Fill-in-middle transformation: cuts come from a boundary set kept in array, bitmap and run containers.

The places where a text may be cut (between code points, before words, or before lines) are byte offsets. For a slice
of joined texts they form one set, kept like a compressed bitmap: the offsets of each 2^16 bytes lie in the smallest of
three containers (a sorted array, a bitmap with counts of its blocks, or runs), and the containers' cardinalities are
summed up. ``rank`` of a text's start and end gives its number of units; ``select`` of a start's rank plus a number of
units gives the offset of a cut: a search among the containers, then a select inside one. Both cuts of all texts are
selected at once. Offsets are bytes, so the parts of a text are slices of its bytes and nothing is decoded.

Texts are taken one by one: no shuffle; a task holds one Arrow batch, dealt into slices of at most ``SLICE_BYTES`` (or
one text).

Defined cases: a null text counts as empty; an empty text is plain, with 0 units; a null key is hashed as an empty
string; a text that holds a marker is plain, so that every output can be undone; very long texts are cut as a whole;
rows with equal keys or texts each keep their row, and equal keys with equal texts give equal outputs; an empty table
gives an empty result; extra columns pass through unless they carry the name of a column made here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lean, table
from pulsegrid.llm.repetition import slices

SLICE_BYTES = 2 << 20
#: Offsets in one container, and bits in one counted block of a bitmap.
SPAN = 1 << 16
BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = {"text": "string", "form": "string", "n": "long", "prefix_units": "long", "middle_units": "long"}


class Array:
    """Members as a sorted array."""

    def __init__(self, member: np.ndarray):
        self.at = np.flatnonzero(member).astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.at[k].astype(np.int64)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, x)


class Bitmap:
    """Members as bits, with the number of members before each block."""

    def __init__(self, member: np.ndarray):
        whole = np.zeros(SPAN, dtype=bool)
        whole[: len(member)] = member
        self.bits = np.packbits(whole.reshape(-1, BLOCK), axis=1)
        self.before = np.concatenate([[0], np.cumsum(whole.reshape(-1, BLOCK).sum(axis=1))])

    def _block(self, b: np.ndarray) -> np.ndarray:
        return np.cumsum(np.unpackbits(self.bits[b], axis=1), axis=1, dtype=np.int16)

    def select(self, k: np.ndarray) -> np.ndarray:
        b = np.searchsorted(self.before, k, side="right") - 1
        return b * BLOCK + (self._block(b) < (k - self.before[b] + 1)[:, None]).sum(axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        b, inside = x // BLOCK, x % BLOCK
        return self.before[b] + np.where(inside > 0, self._block(b)[np.arange(len(x)), inside - 1], 0)


class Runs:
    """Members as runs of neighbours, with the number of members before each run."""

    def __init__(self, member: np.ndarray):
        edges = np.flatnonzero(np.diff(member, prepend=False, append=False)).reshape(-1, 2)
        self.first = edges[:, 0]
        self.before = np.concatenate([[0], np.cumsum(edges[:, 1] - edges[:, 0])])

    def select(self, k: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.before, k, side="right") - 1
        return self.first[r] + k - self.before[r]

    def rank(self, x: np.ndarray) -> np.ndarray:
        r = np.searchsorted(self.first, x, side="right") - 1
        held = self.before[np.maximum(r, 0)] + np.minimum(x - self.first[np.maximum(r, 0)], np.diff(self.before)[np.maximum(r, 0)])
        return np.where(r < 0, 0, held)


def container(member: np.ndarray) -> Array | Bitmap | Runs:
    """The smallest container of up to SPAN flags: two bytes a member, a bit an offset, or four bytes a run."""
    runs = int(np.count_nonzero(member[1:] & ~member[:-1])) + bool(len(member) and member[0])
    size = {Array: 2 * int(np.count_nonzero(member)), Bitmap: SPAN // 8, Runs: 4 * runs}
    kind = min(size, key=size.get) if size[Array] else Array
    return kind(member)


class BoundarySet:
    """A set of offsets with rank and select."""

    def __init__(self, member: np.ndarray):
        parts = [member[i : i + SPAN] for i in range(0, len(member), SPAN)]
        self.containers = [container(p) for p in parts]
        self.before = np.concatenate([[0], np.cumsum([np.count_nonzero(p) for p in parts], dtype=np.int64)]).astype(np.int64)

    def _each(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for c in np.unique(at).tolist():
            yield c, np.flatnonzero(at == c)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Offset of the member of each rank."""
        at, out = np.searchsorted(self.before, k, side="right") - 1, np.empty(len(k), dtype=np.int64)
        for c, own in self._each(at):
            out[own] = c * SPAN + self.containers[c].select(k[own] - self.before[c])
        return out

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Number of members below each offset."""
        at, out = x // SPAN, np.empty(len(x), dtype=np.int64)
        for c, own in self._each(at):
            out[own] = self.before[c] + (self.containers[c].rank(x[own] - c * SPAN) if c < len(self.containers) else 0)
        return out


def members(data: np.ndarray, ends: np.ndarray, unit: str) -> np.ndarray:
    """Flags of the offsets (one more than there are bytes) at which a unit of joined texts begins or a text ends."""
    out = np.zeros(len(data) + 1, dtype=bool)
    if unit == "characters":
        out[:-1] = (data & 0xC0) != 0x80
    elif unit == "words":
        space = (data == 32) | ((data >= 9) & (data <= 13))
        out[1:-1] = space[:-1] & ~space[1:]
    elif unit == "lines":
        out[1:-1] = data[:-1] == 10
    else:
        raise ValueError(f"unknown unit {unit}")
    out[ends] = True
    out[0] = True
    return out


@dataclass(frozen=True)
class Markers:
    """Strings before the parts. None may overlap another, so that the parts of an output can't be read in two ways."""

    prefix: str = PREFIX
    suffix: str = SUFFIX
    middle: str = MIDDLE

    def __post_init__(self) -> None:
        names = (self.prefix, self.suffix, self.middle)
        if not all(names) or any(a in b for a, b in permutations(names, 2)):
            raise ValueError("markers must be neither empty nor part of one another")
        if any(a[-k:] == b[:k] for a in names for b in names for k in range(1, min(len(a), len(b)))):
            raise ValueError("markers must not overlap")


def draws(key: str, seed: int) -> tuple[int, ...]:
    """Four unsigned 32-bit numbers for a key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def fill_middle(docs: DataFrame, unit: str = "characters", plain_percent: int = 10, spm_percent: int = 20, seed: int = 1, key: str = "doc_id", markers: Markers = Markers()) -> DataFrame:
    """docs with text rearranged, form (plain, psm, spm), n (units), prefix_units and middle_units (null if plain).

    The key and the seed decide the form and both cuts, so the order of rows and partitions doesn't matter.
    """
    made = [c for c in MADE if c != "text"]
    kept = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), "text")
    p, s, m = (x.encode() for x in (markers.prefix, markers.suffix, markers.middle))

    def one(text: bytes, first: int, second: int, spm: bool) -> bytes:
        pre, mid, rest = text[:first], text[first:second], text[second:]
        return b"".join((s, rest, p, pre, m, mid) if spm else (p, pre, s, rest, m, mid))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(kept) + 1).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, length in slices(sizes, SLICE_BYTES):
                own = texts.slice(start, length).to_pylist()
                data, ends = b"".join(own), np.cumsum(sizes[start : start + length])
                begins = ends - sizes[start : start + length]
                borders = BoundarySet(members(np.frombuffer(data, dtype=np.uint8), ends, unit))
                low = borders.rank(begins)
                n = borders.rank(ends) - low
                drawn = np.array([draws(k, seed) for k in batch.column(len(kept)).slice(start, length).to_pylist()], dtype=np.int64).reshape(-1, 4)
                cuts = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
                at = np.stack([borders.select(low + cuts[:, j]) for j in (0, 1)], axis=1) - begins[:, None]
                marked = any(x in data for x in (p, s, m))
                plain = (n == 0) | (drawn[:, 2] % 100 >= 100 - plain_percent)
                if marked:
                    plain |= np.array([p in t or s in t or m in t for t in own])
                spm = drawn[:, 3] % 100 < spm_percent
                out = [t if is_plain else one(t, a, b, turned) for t, is_plain, (a, b), turned in zip(own, plain.tolist(), at.tolist(), spm.tolist(), strict=True)]
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                columns = [pa.array(form.tolist(), pa.string()), pa.array(n, pa.int64()), pa.array(cuts[:, 0], pa.int64(), mask=plain), pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, length) for i in range(len(kept))), pa.array(out, pa.binary()).cast(pa.string()), *columns], [*(f"c{i}" for i in range(len(kept))), "text", *made])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"{c} {t}" for c, t in MADE.items())])
    return rows.mapInArrow(lean(run), schema).toDF(*kept, *MADE)


def restored(text: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text before the transformation, read from an output and its form: each marker occurs once in it."""
    p, s, m = (F.lit(x) for x in (markers.prefix, markers.suffix, markers.middle))
    part = lambda c, by, i: F.split_part(c, by, F.lit(i))
    psm = F.concat(part(part(text, s, 1), p, 2), part(text, m, 2), part(part(text, s, 2), m, 1))
    spm = F.concat(part(part(text, p, 2), m, 1), part(text, m, 2), part(part(text, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: form, cuts, and digests of the output and of the text that is rebuilt from it."""
    rows = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (
  select *, length(t) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d
),
cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
  from drawn
),
parts as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from parts
"""
