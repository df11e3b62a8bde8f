"""Periodic runs against brute force, and against the dynamic program taken word by word."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period): for each period, the stretches that it holds in; those with a smaller period go."""
    n, found = len(words), {}
    for p in range(1, n):
        i = p
        while i < n:
            if words[i] == words[i - p]:
                begin = i - p
                while i < n and words[i] == words[i - p]:
                    i += 1
                if i - begin >= max(least, 2 * p):
                    found.setdefault((begin, i - begin), p)
            else:
                i += 1
    return sorted((s, n, p) for (s, n), p in found.items())


def word_by_word(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """The online program: earlier occurrences of each word increment the match lengths of their lags."""
    places: dict = {}
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}

    def end(at: int, lag: int, length: int) -> None:
        if length + lag >= max(least, 2 * lag):
            key = (at - length - lag, length + lag)
            found[key] = min(lag, found.get(key, lag))

    for i, w in enumerate([*words, object()]):
        now = {i - j: active.get(i - j, 0) + 1 for j in places.get(w, [])}
        for lag, length in active.items():
            if lag not in now:
                end(i, lag, length)
        active = now
        places.setdefault(w, []).append(i)
    return sorted((s, n, p) for (s, n), p in found.items())


def codes(words: list) -> np.ndarray:
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def test_runs_equal_brute_force() -> None:
    rng = random.Random(2)
    shapes = [["a"] * 100, ["a", "b"] * 60, [], ["a"], ["a"] * 12, ["a"] * 11, list("abababa") * 2, list("abababa") * 5 + list("abab"), list("aab" * 7 + "aac" * 9)]
    for _ in range(600):
        kind = rng.random()
        size = rng.randint(0, 160)
        if kind < 0.3:
            words = [rng.choice("ab") for _ in range(size)]
        elif kind < 0.5:
            words = [rng.choice("aaaaaaab") for _ in range(size)]
        elif kind < 0.7:  # runs inside runs
            part = [rng.choice("abc") for _ in range(rng.randint(1, 9))] * rng.randint(1, 5)
            words = (part + [rng.choice("abc") for _ in range(rng.randint(0, 4))]) * rng.randint(1, 6)
        elif kind < 0.85:  # words of a Fibonacci string, rich in runs
            a, b = "a", "ab"
            while len(b) < size:
                a, b = b, b + a
            words = list(b[:size])
        else:
            words = [str(rng.randint(0, 1000)) for _ in range(size)]
            cut = rng.randint(0, size)
            words += words[cut:] * rng.randint(0, 3)
        shapes.append(words)
    for words in shapes:
        for least in (12, 3):
            want = by_definition(words, least)
            assert [tuple(r) for r in periodic.runs_of(codes(words), least).tolist()] == want
            if least == 12:
                assert word_by_word(words) == want


def test_long_periods_and_many_texts_at_once() -> None:
    rng = random.Random(4)
    texts = []
    for size in (500, 3000, 1000):
        block = [str(rng.randint(0, 50)) for _ in range(size // 4)]
        texts.append([str(rng.randint(0, 50)) for _ in range(100)] + block + block + block[: size // 9])
    joined = np.concatenate([codes(t) * len(texts) + i for i, t in enumerate(texts)])
    want, begin = [], 0
    for t in texts:
        want += [(s + begin, n, p) for s, n, p in word_by_word(t)]
        begin += len(t)
    assert [tuple(r) for r in periodic.runs_of(joined).tolist()] == sorted(want) and len(want) >= 3


def test_growth_is_near_linear() -> None:
    took = []
    for n in (100_000, 400_000):
        words = np.concatenate([np.zeros(n // 2, dtype=np.int64), np.tile(np.arange(1, 1 + 37), n // 74), np.random.default_rng(1).integers(40, 42, n // 4)])
        began = time.time()
        runs = periodic.runs_of(words)
        took.append(time.time() - began)
        assert [0, n // 2, 1] in runs.tolist() and any(p == 37 and s == n // 2 for s, _, p in runs.tolist())
    assert took[1] < 10 * max(took[0], 0.3)


def slow_row(key, text: str | None, plant: bool) -> tuple:  # noqa: ANN001
    words = WORD.findall(text or "")
    n = len(words)
    if plant and key is not None:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = by_definition(words) if n < 3000 else word_by_word(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *shown, digest("".join(f"{s},{length},{p}\n" for s, length, p in runs)), digest(collapsed), runs, collapsed


def test_query_equals_brute_force(spark, sf_dir) -> None:  # noqa: ANN001
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = periodic.op11_periodic_runs(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        assert tuple(r)[1:] == slow_row(r.doc_id, texts[r.doc_id], True)[:7], r.doc_id


def test_defined_cases(spark) -> None:  # noqa: ANN001
    rng = random.Random(9)
    texts = [None, "", " \n ", "one", "a b\x0bc d e", "x " * 50, "é日 z\t" * 30, "x\n" * 20_000, *(" ".join(rng.choice("pq") for _ in range(80)) for _ in range(100))]
    data = [(i if i != 5 else None, t, "clash") for i, t in enumerate(texts)] + [(3, "one", "clash")]
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string").withColumns({"odd name": F.lit(1), "before": F.col("text")}).repartition(3)
    rows = periodic.collapse_runs(docs).collect()
    assert len(rows) == len(data)
    for r in rows:
        want = slow_row(r.doc_id, r.before, False) if r.before != texts[7] else None
        if want:
            assert ([tuple(x) for x in r.runs], r.text) == want[-2:]
        else:
            assert [tuple(x) for x in r.runs] == [(0, 20_000, 1)] and r.text == "x"
    none = periodic.collapse_runs(docs.limit(0))
    assert none.columns == ["doc_id", "odd name", "before", "text", "runs"] and none.count() == 0
