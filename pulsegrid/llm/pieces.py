"""SentencePiece encoding and decoding of merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text becomes its normalized form (a leading space sign, spaces as space signs); its characters are the first symbols.
The agenda holds the adjacent pairs that join to a piece of the vocabulary, by score, then by place. The best pair is
joined, pairs that lost a symbol fall out, pairs with the new symbol come in, until the agenda is empty. Symbols that
aren't pieces become the pieces of their bytes.

Two things keep this fast without changing a result. Byte pairs that occur inside no piece can never be joined, so the
text is cut there, and each fragment has an agenda of its own. Fragments repeat, so the fragments of a slice of texts are
numbered by value and each distinct one is worked out once; a bounded table of them (two generations, the older of which
goes when the younger is full) outlives the slice. The short fragments of a slice share one agenda in arrays, from which
each round takes the best pair of every fragment; a long fragment has a heap, so that its time stays within n log n.

``check=True`` encodes and decodes each Arrow batch with the sentencepiece library too and says whether both agree.

Texts are taken one by one: no shuffle; a task holds one Arrow batch, dealt into slices of at most ``SLICE_BYTES`` (or
one text).

Defined cases: a null text counts as empty; an empty text has the begin and end ids only, and decodes to an empty text;
strings of control pieces inside a text are ordinary text; a space sign in a text is a space, as in the library; very
long texts are encoded whole, and fragments of over ``LONGEST`` bytes aren't kept in the table; rows with equal ids or
texts each keep their row; an empty table gives an empty result; extra columns pass through unless they carry the name of
a column made here.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe import gathered
from pulsegrid.llm.common import lean, table
from pulsegrid.llm.repetition import slices

#: Bytes of the longest fragment that a worker keeps, and the fragments of one generation of its table.
LONGEST = 64
MOST_KEPT = 200_000
#: Characters of the longest fragment that shares the agenda in arrays, and fragments that share one.
SHORT = 48
AT_ONCE = 20_000
#: Rank of a pair that joins to no piece.
NONE = 1 << 30
SLICE_BYTES = 2 << 20
SPACE = "▁".encode()

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceEncoder:
    """Encodes and decodes with one merge-type vocabulary (a sentencepiece model file's bytes)."""

    def __init__(self, model: bytes, most_kept: int = MOST_KEPT):
        from sentencepiece import sentencepiece_model_pb2 as format_of

        held = format_of.ModelProto()
        held.ParseFromString(model)
        of, norm, made = format_of.ModelProto.SentencePiece, held.normalizer_spec, held.trainer_spec
        kinds = {p.type for p in held.pieces}
        if made.model_type != format_of.TrainerSpec.BPE or kinds & {of.USER_DEFINED, of.UNUSED} or made.treat_whitespace_as_suffix:
            raise ValueError("not a plain merge-type vocabulary")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or held.HasField("denormalizer_spec") and held.denormalizer_spec.precompiled_charsmap:
            raise ValueError("the vocabulary normalizes texts")
        self.model = model
        self.bos, self.eos = made.bos_id, made.eos_id
        plain = lambda p: p.piece.encode().replace(SPACE, b" ")
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(held.pieces) if p.type == of.BYTE}
        self.id_of = {plain(p).decode(): i for i, p in enumerate(held.pieces) if p.type == of.NORMAL}
        self.score = {t: held.pieces[i].score for t, i in self.id_of.items()}
        self.byte_ids = [byte.get(b, made.unk_id) for b in range(256)]
        self.whole_unknown = not made.byte_fallback
        self.unknown = made.unk_id
        # working bytes of each id: the space sign is a space
        shown = {of.NORMAL: plain, of.BYTE: lambda p: bytes([int(p.piece[1:-1], 16)]), of.UNKNOWN: lambda p: made.unk_surface.encode(), of.CONTROL: lambda p: b""}
        self.bytes = pa.array([shown[p.type](p) for p in held.pieces], pa.large_binary())
        self.leads = np.array([p.type == of.NORMAL and p.piece.startswith("▁") for p in held.pieces])
        self.silent = np.array([p.type == of.CONTROL for p in held.pieces])
        self.cuts = self._forced()
        self._number_symbols()
        self.most_kept = most_kept
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _forced(self) -> np.ndarray:
        """[a, b] is set if b begins a character and the byte a stands before b inside no piece."""
        forced = np.zeros((256, 256), dtype=bool)
        forced[:, (np.arange(256) < 128) | (np.arange(256) >= 192)] = True
        for piece in self.id_of:
            own = np.frombuffer(piece.encode(), dtype=np.uint8)
            forced[own[:-1], own[1:]] = False
        return forced.ravel()

    def _number_symbols(self) -> None:
        """Symbols of the shared agenda are ids; characters that aren't pieces get numbers above them as they come.

        Each way to join two pieces to a piece is a pair of ids, with the rank of its score (higher scores first).
        """
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = [
            (self.id_of[t[:i]] << 32 | self.id_of[t[i:]], order[self.score[t]], new)
            for t, new in self.id_of.items()
            for i in range(1, len(t))
            if t[:i] in self.id_of and t[i:] in self.id_of
        ]
        pairs.sort()
        found = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.pair, self.rank, self.joined = found[:, 0].copy(), found[:, 1].astype(np.int32), found[:, 2].astype(np.int32)

    def _ids_of_symbol(self, symbol: str) -> list[int]:
        known = self.id_of.get(symbol)
        if known is not None:
            return [known]
        return [self.unknown] if self.whole_unknown else [self.byte_ids[b] for b in symbol.encode()]

    def agenda(self, text: str) -> list[str]:
        """Symbols of a fragment: its own agenda, in a heap."""
        symbol: list[str | None] = list(text)
        n, score = len(symbol), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = symbol[left] + symbol[right]
                if both in score:
                    heapq.heappush(heap, (-score[both], left, right, len(both)))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, size = heapq.heappop(heap)
            if symbol[left] is None or symbol[right] is None or len(symbol[left]) + len(symbol[right]) != size:
                continue  # one of the two was joined with another one
            symbol[left] += symbol[right]
            symbol[right] = None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbol if s is not None]

    def shared_agenda(self, texts: list[str]) -> list[bytes]:
        """ids (packed, four bytes each) of short fragments: each round joins the best pair of every fragment."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        chars, which = np.unique(code, return_inverse=True)
        names = [chr(c) for c in chars.tolist()]
        top = len(self.bytes)
        symbol = np.array([self.id_of.get(c, top + i) for i, c in enumerate(names)], dtype=np.int64)[which]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # what the agenda holds of the pair that begins at each symbol: its rank (NONE: it joins to no piece) and the piece
        rank, new = np.full(len(symbol), NONE, dtype=np.int64), np.zeros(len(symbol), dtype=np.int64)

        def offer(left: np.ndarray) -> None:
            key = symbol[left] << 32 | symbol[left + 1]
            at = np.searchsorted(self.pair, key)
            at[at == len(self.pair)] = 0
            rank[left] = np.where(self.pair[at] == key, self.rank[at], NONE)
            new[left] = self.joined[at]

        offer(np.flatnonzero(owner[:-1] == owner[1:]))
        while len(symbol):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)  # best score, then first place, of each fragment
            going = best >> 32 < NONE
            stay = np.repeat(going, np.diff(np.append(starts, len(owner))))
            if not going.all():
                done.append((owner[~stay], symbol[~stay]))
            best = best[going] & 0xFFFFFFFF
            symbol[best] = new[best]
            rank[best] = NONE
            stay[best + 1] = False
            place = np.cumsum(stay)[best] - 1
            symbol, owner, rank, new = symbol[stay], owner[stay], rank[stay], new[stay]
            # pairs with the new symbol come in
            offer(place[(place + 1 < len(owner)) & (owner[np.minimum(place + 1, len(owner) - 1)] == owner[place])] if len(place) else place)
            offer(place[(place > 0) & (owner[place - 1] == owner[place])] - 1)
        owner = np.concatenate([o for o, _ in done]) if done else np.empty(0, dtype=np.int64)
        symbol = np.concatenate([s for _, s in done]) if done else np.empty(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        owner, symbol = owner[order], symbol[order]
        odd = np.flatnonzero(symbol >= top)
        if len(odd):  # characters that aren't pieces
            parts = {int(s): np.array(self._ids_of_symbol(names[int(s) - top]), dtype=np.int64) for s in np.unique(symbol[odd])}
            count = np.ones(len(symbol), dtype=np.int64)
            count[odd] = [len(parts[s]) for s in symbol[odd].tolist()]
            place = np.cumsum(count) - count
            out = np.repeat(symbol, count)
            for i in odd.tolist():
                own = parts[int(symbol[i])]
                out[place[i] : place[i] + len(own)] = own
            symbol, owner = out, np.repeat(owner, count)
        packed = symbol.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(texts)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids_of(self, fragments: list[bytes]) -> list[bytes]:
        """ids (packed) of distinct fragments."""
        young, old = self.young, self.old
        out: list[bytes | None] = [young.get(f) or old.get(f) for f in fragments]
        new = [(k, fragments[k].decode()) for k, x in enumerate(out) if x is None]
        short = [(k, t) for k, t in new if len(t) <= SHORT]
        for start in range(0, len(short), AT_ONCE):
            part = short[start : start + AT_ONCE]
            for (k, _), x in zip(part, self.shared_agenda([t for _, t in part]), strict=True):
                out[k] = x
        for k, t in new:
            if len(t) > SHORT:
                out[k] = np.array([i for s in self.agenda(t) for i in self._ids_of_symbol(s)], dtype="<u4").tobytes()
        fresh = {f: x for f, x in zip(fragments, out, strict=True) if len(f) <= LONGEST}
        if len(young) + len(fresh) > self.most_kept:
            self.old, self.young = young, fresh
        else:
            young.update(fresh)
        return out  # type: ignore[return-value]

    def encode_joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where the ids of each text end), without begin and end ids."""
        own = [b" " + t.replace(SPACE, b" ") if t else b"" for t in texts]
        ends = np.cumsum([len(t) for t in own], dtype=np.int64)
        data = np.frombuffer(b"".join(own), dtype=np.uint8)
        if not len(data):
            return np.empty(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        is_cut = np.zeros(len(data) + 1, dtype=bool)
        is_cut[1:-1] = self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        is_cut[ends] = True
        is_cut[0] = True
        at = np.flatnonzero(is_cut)
        found = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        packed = pa.array(self.ids_of(found.dictionary.to_pylist()), pa.large_binary()).take(found.indices)
        stops = np.frombuffer(packed.buffers()[1], dtype=np.int64)[: len(packed) + 1] // 4
        return np.frombuffer(packed.buffers()[2], dtype="<u4")[: stops[-1]], stops[np.searchsorted(at, ends)]

    def encode(self, text: str) -> list[int]:
        """ids of a text with begin and end ids."""
        return [self.bos, *self.encode_joined([text.encode()])[0].tolist(), self.eos]

    def decoded(self, data: bytes, ids: np.ndarray) -> str:
        """The text of joined bytes of ids: without the leading space, broken bytes as the library shows them."""
        told = ids[~self.silent[ids]] if len(ids) else ids
        return str(data[1:] if len(told) and self.leads[told[0]] else data, "utf-8", "each-byte")

    def decode(self, ids: list[int]) -> str:
        own = np.array(ids, dtype=np.int64)
        return self.decoded(b"".join(self.bytes.take(pa.array(own)).to_pylist()), own)


_encoders: dict[str, PieceEncoder] = {}


def encoder(model: bytes) -> PieceEncoder:
    """The worker's encoder for a vocabulary; its table of fragments lives as long as the worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = PieceEncoder(model)
    return _encoders[key]


def model_of(path: str | None = None) -> bytes:
    """The model file. Its size doesn't depend on the corpus."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def agreement(model: bytes, texts: list[str], ids: list[bytes], decoded: list[bytes]) -> list[bool]:
    """Whether the library gives the same packed ids and digests of decoded texts."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_proto=model)
    theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    same = lambda x, own, text: np.array(x, dtype="<u4").tobytes() == own and hashlib.sha256(library.decode(x).encode()).digest() == text
    return [same(x, a, b) for x, a, b in zip(theirs, ids, decoded, strict=True)]


def encode_pieces(docs: DataFrame, model_path: str | None = None, with_ids: bool = True, check: bool = False) -> DataFrame:
    """docs without text, with ids (array of int, begin and end ids too), n_tokens, ids_sha256, decoded_sha256, and agrees if checked."""
    made = ({"ids": "array<int>"} if with_ids else {}) | {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"agrees": "boolean"} if check else {})
    kept = [c for c in docs.columns if c not in made and c != "text"]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model_of(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(shared.value)
        first, last = (np.array([x], dtype="<u4").tobytes() for x in (by.bos, by.eos))
        for batch in batches:
            texts = pc.fill_null(batch.column(len(kept)).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, length in slices(sizes, SLICE_BYTES):
                own = texts.slice(start, length).to_pylist()
                ids, stops = by.encode_joined(own)
                begins = [0, *stops.tolist()]
                packed = [first + ids[a:b].tobytes() + last for a, b in zip(begins, begins[1:], strict=False)]
                said = [hashlib.sha256(by.decoded(bytes(x), ids[a:b]).encode()) for x, a, b in zip(gathered(by.bytes, ids, stops), begins, begins[1:], strict=False)]
                columns = {
                    "n_tokens": pa.array([len(x) // 4 for x in packed], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    "decoded_sha256": pa.array([x.hexdigest() for x in said], pa.string()),
                }
                if with_ids:
                    every = np.frombuffer(b"".join(packed), dtype="<i4")
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)), pa.array(every))
                if check:
                    columns["agrees"] = pa.array(agreement(by.model, [t.decode() for t in own], packed, [x.digest() for x in said]), pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, length) for i in range(len(kept))), *(columns[c] for c in made)], [*(f"c{i}" for i in range(len(kept))), *made])

    schema = ", ".join([*(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), *(f"{c} {t}" for c, t in made.items())])
    return rows.mapInArrow(lean(run), schema).toDF(*kept, *made)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: number and digest of their ids, the digest of the decoded text, and whether the library agrees."""
    return encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False, check=True)
