"""SentencePiece by agenda, against the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import pieces

TEXTS = [None, "", " ", "   ", "\n", "▁", "one", "a  b\x00c▁d", "<s> </s> <unk> <0x41>", "日本語 한국어 עברית", "👩‍👩‍👧 é́́", "word " * 5000, "x" * 3000, "ab" * 2000, "日" * 2000, " " * 999, "\t\r\n  　 "]


@pytest.fixture(scope="module")
def library():  # noqa: ANN201
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=pieces.model_of())


@pytest.fixture(scope="module")
def own() -> pieces.PieceEncoder:
    return pieces.PieceEncoder(pieces.model_of(), most_kept=500)


def test_ids_and_texts_equal_the_library(library, own) -> None:  # noqa: ANN001
    rng = random.Random(1)
    parts = ["the ", "  ", "▁", "é", "日", "ing", "s", ".", "\n", "\x00", "😀", "a", "b", "t", "h", "e", "<s>", " ", "    ", "1", "0", "\x7f", " ", "​"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(5000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert own.decode(ids) == library.decode(ids)


def test_both_agendas_agree(own) -> None:  # noqa: ANN001
    rng = random.Random(2)
    texts = ["".join(rng.choice(" aeinthsor日é") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    heap = [np.array([i for s in own.agenda(t) for i in own._ids_of_symbol(s)], dtype="<u4").tobytes() for t in texts]
    assert own.shared_agenda(texts) == heap


def test_any_ids_decode_like_the_library(library, own) -> None:  # noqa: ANN001
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.randrange(600) if rng.random() < 0.7 else rng.randrange(32_000) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids)


def test_cuts_are_used_and_harmless(own) -> None:  # noqa: ANN001
    forced = own.cuts.reshape(256, 256)
    assert 0.3 < forced.mean() < 0.9
    for piece in list(own.id_of)[:5000]:
        data = piece.encode()
        assert not any(forced[a, b] for a, b in zip(data, data[1:], strict=False))
    assert forced[ord("e"), ord(" ")] and not forced[ord("t"), ord("h")]


def test_query_equals_the_library(spark, library) -> None:  # noqa: ANN001
    sf_dir = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pieces.op13_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.agrees for r in rows)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_defined_cases(spark, library) -> None:  # noqa: ANN001
    data = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(6, "one", "clash")]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids string").withColumns({"odd name": F.lit(1), "before": F.col("text")}).repartition(3)
    rows = pieces.encode_pieces(docs, check=True).collect()
    assert len(rows) == len(data) and all(r.agrees for r in rows)
    for r in rows:
        assert r.ids == library.encode(r.before or "", add_bos=True, add_eos=True)
    none = pieces.encode_pieces(docs.limit(0))
    assert none.columns == ["doc_id", "odd name", "before", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and none.count() == 0


def test_other_vocabularies_are_refused() -> None:
    from sentencepiece import sentencepiece_model_pb2 as format_of

    held = format_of.ModelProto()
    held.ParseFromString(pieces.model_of())
    held.trainer_spec.model_type = format_of.TrainerSpec.UNIGRAM
    with pytest.raises(ValueError, match="merge-type"):
        pieces.PieceEncoder(held.SerializeToString())
