"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text may be cut between its two
bytes with certainty. The table of such pairs is read from the vocabulary. The pre-tokenizer has to leave such a cut
whole: it mustn't read either side differently once they are apart. Which cuts it leaves whole follows from the kinds
of the two characters (see ``Encoder._table``); all that pass are made: between words, inside words, at line ends and
between punctuation. Each fragment between cuts is encoded by itself, and the ids are concatenated.

Cuts are found for a slice of texts at once with numpy. Fragments repeat, so the slice's fragments are numbered by
value, each distinct one is encoded once by the tokenizers library, and their ids are gathered by number; a bounded
table of fragments (two generations, the older of which goes when the younger is full) outlives the slice. Decoding
joins the bytes of the ids.

Texts are taken one by one: no shuffle; a task holds one Arrow batch, dealt into slices of at most ``SLICE_BYTES`` (or
one text).

Defined cases: a null text counts as empty; an empty text has no ids, and the digests of empty strings; strings of
special tokens inside a text become their ids, as the library does by default; a text without any cut is one fragment;
very long texts are encoded whole, and fragments of over ``LONGEST`` bytes aren't kept in the table; rows with equal ids
or texts each keep their row; an empty table gives an empty result; extra columns pass through unless they carry the
name of a column made here.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import lean, table
from pulsegrid.llm.repetition import slices

#: Bytes of the longest fragment that a worker keeps, and the fragments of one generation of its table.
LONGEST = 64
MOST_KEPT = 60_000
SLICE_BYTES = 2 << 20
#: Fragments in one call of the library.
AT_ONCE = 2000
#: Bytes whose pairs are looked up at once.
_PART = 1 << 20

# What the pre-tokenizer's pattern names, and white space beyond ASCII.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_of_symbol() -> dict[str, int]:
    """The printable symbols that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes with one byte-level vocabulary (the JSON of the tokenizers library)."""

    def __init__(self, vocabulary: str, most_kept: int = MOST_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are shared by tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        parts = json.loads(vocabulary)
        before = parts["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or parts["normalizer"]:
            raise ValueError("the vocabulary is not byte-level with the usual pattern")
        symbols = byte_of_symbol()
        tokens: dict[int, bytes] = {i: bytes(symbols[c] for c in t) for t, i in parts["model"]["vocab"].items()}
        self.forced = self._forced(list(tokens.values()))
        self.special = {t["content"].encode(): t["id"] for t in parts["added_tokens"]}
        tokens |= {i: s for s, i in self.special.items()}
        self.at_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        every = range(max(tokens) + 1)
        self.bytes = pa.array([tokens.get(i, b"") for i in every], pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in every], pa.large_binary())
        self.cuts = self._table(self.forced)
        self.most_kept = most_kept
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _forced(tokens: list[bytes]) -> np.ndarray:
        """[a, b] is set if the byte a stands before b inside no token."""
        forced = np.ones((256, 256), dtype=bool)
        for token in [*tokens, *(x.encode() for x in _CONTRACTIONS)]:
            own = np.frombuffer(token, dtype=np.uint8)
            forced[own[:-1], own[1:]] = False
        return forced

    @staticmethod
    def _table(forced: np.ndarray) -> np.ndarray:
        """Forced pairs (last byte of a character, first byte of the next) that the pre-tokenizer leaves whole.

        Its pattern takes letters, digits or other signs in runs (with one space before), contractions, and white space.
        A run that is cut falls into runs of the same kind; a run's end, and white space after another character, end a
        piece anyway. Only two things look further: white space looks ahead (so no cut follows a space, and one follows
        another white-space character only where ``find`` sees that it stands alone), and an apostrophe after other
        signs would begin a contraction if it stood first.
        """
        code = np.arange(256)
        space = np.isin(code, [9, 10, 11, 12, 13, 32])
        word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
        odd = (code >= 28) & (code <= 31)  # engines differ on whether these are white space
        begins = (code < 128) | (code >= 192)
        good = forced & begins[None, :] & ~odd[:, None] & ~odd[None, :]
        good[32] = False
        good[space] &= ((code < 128) & ~space)[None, :]
        good[~word, ord("'")] = False
        return good.ravel()

    def find(self, data: np.ndarray) -> np.ndarray:
        """Places before which the bytes may be cut."""
        found = []
        for start in range(0, max(0, len(data) - 1), _PART):
            part = data[start : start + _PART + 1]
            at = np.flatnonzero(self.cuts[part[:-1].astype(np.uint16) << 8 | part[1:]]) + start + 1
            found.append(at[self._alone(data, at)])
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    @staticmethod
    def _alone(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether a cut may stand at each place as far as white space before it goes: none, or one ASCII character of it after another one."""
        good = np.ones(len(at), dtype=bool)
        last = data[at - 1]
        white = np.flatnonzero(last <= 13)
        second = data[np.maximum(at[white] - 2, 0)]
        good[white] = (at[white] > 1) & (second > 32) & (second < 128)
        wide = np.flatnonzero(last >= 128)
        code = last[wide].astype(np.int64)
        for back in (2, 3):  # the last three bytes as one number
            code |= np.where(at[wide] >= back, data[np.maximum(at[wide] - back, 0)], 0).astype(np.int64) << 8 * (back - 1)
        good[wide] = ~(np.isin(code, _WIDE_CODES) | np.isin(code & 0xFFFF, _WIDE_CODES))
        return good

    def fragments(self, text: str) -> list[str]:
        """Pieces of a text between certain cuts."""
        data = text.encode()
        ends = [0, *self.find(np.frombuffer(data, dtype=np.uint8)).tolist(), len(data)]
        return [data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)] if data else []

    def ids_of(self, fragments: list[bytes]) -> list[bytes]:
        """ids (packed, four bytes each) of distinct fragments, each encoded by itself."""
        young, old = self.young, self.old
        out: list[bytes | None] = [young.get(f) or old.get(f) for f in fragments]
        new = [k for k, x in enumerate(out) if x is None]
        for start in range(0, len(new), AT_ONCE):
            part = new[start : start + AT_ONCE]
            for k, x in zip(part, self.library.encode_batch([fragments[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(x.ids, dtype="<u4").tobytes()
        fresh = {f: x for f, x in zip(fragments, out, strict=True) if len(f) <= LONGEST}
        if len(young) + len(fresh) > self.most_kept:
            self.old, self.young = young, fresh
        else:
            young.update(fresh)
        return out  # type: ignore[return-value]

    def encode_joined(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where the ids of each text end) of joined texts in UTF-8; ends: where each text ends."""
        if not len(data):
            return np.empty(0, dtype="<u4"), np.zeros(len(ends), dtype=np.int64)
        is_cut = np.zeros(len(data) + 1, dtype=bool)
        is_cut[self.find(data)] = True
        if self.at_special is not None:
            whole = data.tobytes()
            if any(s in whole for s in self.special):
                begins = np.concatenate([[0], ends[:-1]])
                for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                    for m in self.at_special.finditer(whole, a, b):
                        is_cut[m.start() : m.end()] = False
                        is_cut[[m.start(), m.end()]] = True
        is_cut[ends] = True
        is_cut[[0, len(data)]] = True
        at = np.flatnonzero(is_cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        packed = pa.array(self.ids_of(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        stops = np.frombuffer(packed.buffers()[1], dtype=np.int64)[: len(packed) + 1] // 4
        ids = np.frombuffer(packed.buffers()[2], dtype="<u4")[: stops[-1]]
        return ids, stops[np.searchsorted(at, ends)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of each text, as the library's own call gives them."""
        raw = [t.encode() for t in texts]
        ids, stops = self.encode_joined(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64))
        return np.split(ids, stops[:-1]) if texts else []

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included."""
        return b"".join(self.bytes.take(pa.array(ids.astype(np.int64))).to_pylist())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_WIDE_CODES = [int.from_bytes(c.encode(), "big") for c in _WIDE_SPACES]
_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary; its table of fragments lives as long as the worker."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def gathered(values: pa.Array, ids: np.ndarray, stops: np.ndarray) -> Iterator[memoryview]:
    """For each run of ids (stops: where it ends), the values of its ids, joined."""
    taken = values.take(pa.array(ids.astype(np.int64)))
    place = np.frombuffer(taken.buffers()[1], dtype=np.int64)
    joined = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")
    start = 0
    for stop in (place[stops] if len(ids) else np.zeros(len(stops), dtype=np.int64)).tolist():
        yield joined[start:stop]
        start = stop


def vocabulary_of(spark: SparkSession, path: str | None = None) -> str:
    """The vocabulary's JSON. Its size doesn't depend on the corpus."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """docs without text, with ids (array of int), n_tokens, ids_sha256, decoded_sha256."""
    return _mapped(docs, vocabulary_path, True)


def encode_digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """The same without the ids."""
    return _mapped(docs, vocabulary_path, False)


def _mapped(docs: DataFrame, vocabulary_path: str | None, with_ids: bool) -> DataFrame:
    made = {"ids": "array<int>"} if with_ids else {}
    made |= {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    kept = [c for c in docs.columns if c not in made and c != "text"]
    rows = docs.select(*kept, "text")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(docs.sparkSession, vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(kept)).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, length in slices(sizes, SLICE_BYTES):
                own = texts.slice(start, length)
                place = np.frombuffer(own.buffers()[1], dtype=np.int64)[start + texts.offset :][: length + 1]
                data = np.frombuffer(own.buffers()[2] or b"", dtype=np.uint8)[place[0] : place[-1]]
                ids, stops = bpe.encode_joined(data, place[1:] - place[0])
                numbers = [hashlib.sha256(x[:-1]).hexdigest() for x in gathered(bpe.decimal, ids, stops)]
                decoded = [hashlib.sha256(str(x, "utf-8", "replace").encode()).hexdigest() for x in gathered(bpe.bytes, ids, stops)]
                columns = [pa.array(np.diff(stops, prepend=0), pa.int64()), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.insert(0, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, length) for i in range(len(kept))), *columns], [*kept, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), *(f"{c} {t}" for c, t in made.items())])
    return rows.mapInArrow(lean(run), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: number and digest of their ids, and the digest of the decoded text."""
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
