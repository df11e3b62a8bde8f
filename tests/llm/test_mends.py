"""Names that clash, very long texts, what is left behind, and links inside parts."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import common, decontamination, fill_middle, line_dedup, periodic, pieces, similarity, simhash


def test_keep_one_leaves_columns_as_they_are(spark) -> None:  # noqa: ANN001
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", 7, "x"), (2, text + " more", "b", 8, "y"), (None, "other words", "c", 9, "z"), (None, "other words", "c", 9, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _doc string, _hash long, `odd. name` string").withColumns({"row": F.lit(1), "group": F.lit(2), "node": F.lit(3), "m": F.lit(4)})
    kept = similarity.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, frame.filter("doc_id = 1 or doc_id is null").dropDuplicates().collect()))
    assert simhash.near_duplicates(frame).count() == 4


def test_forest_equals_all_pairs() -> None:
    rng = random.Random(11)
    for _ in range(60):
        pool = list(range(rng.randint(5, 60)))
        sets = [np.array(sorted(rng.sample(pool, rng.randint(1, len(pool)))), dtype=np.uint64) for _ in range(rng.randint(2, 30))]
        sets += [np.array(sorted(set(s.tolist()) - {rng.choice(s.tolist())}) or [1], dtype=np.uint64) for s in sets[:10]]
        label = np.array([rng.randint(0, len(sets)) for _ in sets])
        left = np.array(sorted(rng.sample(range(len(sets)), rng.randint(1, len(sets)))))
        right = np.array(sorted(rng.sample(range(len(sets)), rng.randint(1, len(sets)))))
        joined = label.tolist()
        for i in left.tolist():
            for j in right.tolist():
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if joined[i] != joined[j] and len(a & b) >= 0.8 * len(a | b):
                    joined = [joined[i] if x == joined[j] else x for x in joined]
        got = label.tolist()
        for i, j in similarity.forest(label, left, right, sets, 0.8):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert len(a & b) >= 0.8 * len(a | b) and got[i] != got[j]
            got = [got[i] if x == got[j] else x for x in got]
        pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
        assert pairs(got) == pairs(joined)


def test_line_dedup_of_very_long_texts(spark) -> None:  # noqa: ANN001
    lines = [f"line {i}" for i in range(60_000)]
    rows = [(1, "\n".join(lines[:100])), (2, "\n".join(lines)), (3, "x" * 2_000_000)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].n_removed == 100 and got[2].text == "\n".join(lines[100:]) and got[3].text == "x" * 2_000_000 and got[1].n_removed == 0


def test_what_a_stage_writes_goes_with_it(spark, tmp_path) -> None:  # noqa: ANN001
    shared = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir()) if shared.exists() else set()
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(30))) for i in range(20)], "doc_id long, text string")
    with common.scratch(spark):
        similarity.keep_one(docs).write.parquet(f"{tmp_path}/kept")
        during = set(shared.iterdir())
    assert len(during - before) >= 1 and spark.read.parquet(f"{tmp_path}/kept").count() >= 1
    left = {p.name for p in set(shared.iterdir()) - before}
    assert not any(n.startswith(("scratch", "sketches", "shingle")) for n in left)
    assert common.cut(docs).count() == 20  # checkpoints still have a folder


def test_columns_of_any_name_pass(spark) -> None:  # noqa: ANN001
    frame = spark.createDataFrame([(1, "some words here", 5, 6, 7), (None, None, 5, 6, 7)], "doc_id long, text string, `a.b c` long, _key long, _text_hash long")
    bench = spark.createDataFrame([(1, "some words here"), (2, "other words that are long enough to be an item")], "item_id long, text string")
    for out in (fill_middle.fill_middle(frame), periodic.collapse_runs(frame), pieces.encode_pieces(frame), decontamination.contamination(frame, bench, block_bytes=20)):
        assert [(r["a.b c"], r["_key"], r["_text_hash"]) for r in out.collect()] == [(5, 6, 7)] * 2
    assert [r.item_ids for r in decontamination.contamination(frame, bench, block_bytes=20).orderBy("doc_id").collect()] == [[], [1]]
