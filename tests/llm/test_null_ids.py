"""Many rows without an id, or with one id: no hot key."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from pulsegrid.llm import suffix_dedup


def test_suffix_dedup_of_many_null_ids(spark) -> None:  # noqa: ANN001
    """Rows without an id take little longer than rows with ids of their own, and never remove each other's bytes."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(20)) for _ in range(40)]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.1 else word() for _ in range(60)) for _ in range(5000)]
    took = {}
    for kind in ("own", "null", "one", "own"):  # the first run warms up
        ids = {"own": lambda i: i + 1, "null": lambda _: None, "one": lambda _: 7}[kind]
        rows = spark.createDataFrame([(ids(i), t) for i, t in enumerate(texts)] + [(0, passages[0] + " " + passages[1])], "doc_id long, text string").repartition(4)
        began = time.time()
        out = suffix_dedup.remove_repeats(rows).groupBy(F.col("doc_id").isNull().alias("none")).agg(F.count("*").alias("n"), F.sum("n_removed").alias("gone")).collect()
        took[kind] = time.time() - began
        assert sum(r.n for r in out) == len(texts) + 1
        if kind != "own":  # only what the row with id 0 holds goes
            want = 0
            for t in texts:
                data, hit = t.encode(), bytearray(len(t.encode()))
                source = (passages[0] + " " + passages[1]).encode()
                known = {source[k : k + 50] for k in range(len(source) - 49)}
                for k in range(len(data) - 49):
                    if data[k : k + 50] in known:
                        hit[k : k + 50] = b"\1" * 50
                want += sum(hit)
            assert sum(r.gone for r in out) == want
    assert took["null"] < 1.5 * took["own"] + 2 and took["one"] < 1.5 * took["own"] + 2, took
