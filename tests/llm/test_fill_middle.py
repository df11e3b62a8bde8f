"""The boundary set against a list of offsets, and fill-in-middle against a plain function."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import fill_middle as fim

TEXTS = [None, "", "a", "añb日本c😀", "<P> stays", "ends with <S", "<", "line one\nline two\r\n\nlast", "é" * 70_000 + "x" * 70_000, " lead", "é‍ combined", "a" * 200_000]


def expected(key: str, text: str, plain: int = 10, spm: int = 20) -> tuple:
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - plain:
        return text, "plain", len(text), None, None
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    return (f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"), form, len(text), a, b - a


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed", "none", "all"])
def test_boundary_set(kind: str) -> None:
    rng = np.random.default_rng(3)
    size = 3 * fim.SPAN + 77
    member = {
        "sparse": rng.random(size) < 0.001, "dense": rng.random(size) < 0.5, "runs": np.repeat(rng.random(size // 500 + 1) < 0.5, 500)[:size],
        "none": np.zeros(size, dtype=bool), "all": np.ones(size, dtype=bool),
    }.get(kind)
    if member is None:
        member = np.concatenate([rng.random(fim.SPAN) < 0.001, rng.random(fim.SPAN) < 0.7, np.ones(fim.SPAN, dtype=bool), np.zeros(77, dtype=bool)])
    found = fim.BoundarySet(member)
    at = np.flatnonzero(member)
    assert (found.select(np.arange(len(at))) == at).all()
    asked = np.concatenate([rng.integers(0, size, 5000), [0, size - 1, fim.SPAN, 2 * fim.SPAN - 1]])
    assert (found.rank(asked) == np.searchsorted(at, asked)).all()
    if kind == "mixed":
        assert [type(c) for c in found.containers] == [fim.Array, fim.Bitmap, fim.Runs, fim.Array]


def test_against_a_plain_function(spark) -> None:  # noqa: ANN001
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab é日\n😀<PSM>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    rows = [(i if i != 7 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    got = {(r.doc_id, r.before): r for r in fim.fill_middle(docs.withColumn("before", F.col("text"))).withColumn("back", fim.restored(F.col("text"), F.col("form"))).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i, text]
        assert (r.text, r.form, r.n, r.prefix_units, r.middle_units) == expected("" if i is None else str(i), text or "")
        assert r.back == (text or "")
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_whole_words_and_lines(spark) -> None:  # noqa: ANN001
    docs = spark.createDataFrame([(i, f"one two\nthree  four{i}\nfive ") for i in range(200)], "doc_id long, text string")
    for unit, n in (("words", 5), ("lines", 3)):
        rows = fim.fill_middle(docs, unit, plain_percent=0, spm_percent=50).withColumn("back", fim.restored(F.col("text"), F.col("form"))).collect()
        assert all(r.n == n and r.back == f"one two\nthree  four{r.doc_id}\nfive " for r in rows)
        for r in rows:
            middle = r.text.split("<M>")[1]
            assert not middle or middle[-1] in " \n"
    with pytest.raises(Exception, match="unknown unit"):
        fim.fill_middle(docs, "pages").collect()


def test_defined_cases(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], "doc_id long, text string, `odd name` int")
    out = fim.fill_middle(empty)
    assert out.columns == ["doc_id", "odd name", "text", "form", "n", "prefix_units", "middle_units"] and out.count() == 0
    twice = spark.createDataFrame([(5, "the same text"), (5, "the same text")], "doc_id long, text string")
    a, b = fim.fill_middle(twice).collect()
    assert a == b
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("abc", "b", "x")):
        with pytest.raises(ValueError, match="markers"):
            fim.Markers(*bad)


def test_query(spark, sf_dir) -> None:  # noqa: ANN001
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = fim.op12_fill_middle(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        out, form, n, a, b = expected(str(r.doc_id), texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, digest(out), digest(texts[r.doc_id]))
