"""Operators that compare documents: suffix dedup, line dedup, SimHash, sharding, chat, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import chat, line_dedup, queries, sharding, simhash, similarity, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, **more):  # noqa: ANN001, ANN201
    rows = [(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t or "")) for i, t in rows]
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3)


def corpus(seed: int, n: int = 60) -> list[tuple[int, str | None]]:
    """Texts that share passages, lines and whole copies."""
    rng = random.Random(seed)
    say = lambda k: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(k))
    pool = [say(rng.randint(3, 25)) for _ in range(12)]
    out: list[tuple[int, str | None]] = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and out:
            out.append((i, rng.choice(out)[1]))
        elif kind < 0.2:
            out.append((i, rng.choice([None, "", "a", "\n\n\n"])))
        else:
            out.append((i, rng.choice(["\n", " "]).join(rng.choice(pool) if rng.random() < 0.5 else say(rng.randint(1, 12)) for _ in range(rng.randint(1, 14)))))
    return out


# ---- suffix dedup ----------------------------------------------------------------------------------------------------


def slow_removal(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    key = lambda d: 2**63 if d is None else d
    least: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(key(d), least.get(b[k : k + 50], 2**63))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < key(d):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_equals_brute_force(spark, seed, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rows = corpus(seed)
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, rows[8][1]), (rows[9][0], rows[9][1])]  # equal ids, null ids, a repeated row
    rows += [(100 + i, "shared words that many have, and so this is a hot passage of text " + "x" * i) for i in range(12)]
    got = suffix_dedup.remove_repeats(docs(spark, rows, n_bytes="clash", alone="clash")).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_removal(rows)


def test_suffix_dedup_of_long_texts_and_none(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(9)
    long = "".join(rng.choices("ab c\0", k=4000))
    rows = [(0, long[1000:2500]), (1, long), (2, long[:60] + "zz" + long[3000:])]
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()), key=str) == slow_removal(rows)
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs(spark, [(1, "abc"), (2, None)]), with_text=True).collect()}
    assert {k: bytes(v) for k, v in kept.items()} == {1: b"abc", 2: b""}


def test_marks_need_left_extension() -> None:
    """Equal right sides with diverse left sides fall into groups; only the group of a smaller document is marked."""
    right = np.tile(np.frombuffer(b"r" * 50, dtype=np.uint8), (3, 1))
    left = np.array([[1] * 30, [1] * 30, [2] * 30], dtype=np.uint8)
    full = np.array([30] * 3), np.array([50] * 3)
    masks = suffix_dedup.mark(np.array([5, 6, 7]), left, right, *full).tolist()
    assert masks == [0, (1 << 31) - 1, 1]


def test_intervals_equal_all_pairs_of_rows() -> None:
    """Every maximal run of rows with a common prefix, by definition."""
    rng = random.Random(15)
    for _ in range(200):
        n = rng.randint(2, 14)
        prefix = np.array([0] + [rng.choice([0, 3, 20, 21, 25, 50]) for _ in range(n - 1)])
        want = set()
        for a in range(n):
            for b in range(a + 2, n + 1):
                depth = int(prefix[a + 1 : b].min())
                before, after = int(prefix[a]), int(prefix[b]) if b < n else 0
                if depth >= 20 and before < depth and after < depth:
                    above = max(before, after)
                    want.add((a, b, depth, above if above >= 20 else 0))
        assert set(map(tuple, suffix_dedup.intervals(prefix, 20).tolist())) == want


def test_suffix_dedup_with_many_buckets(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 500)
    rows = corpus(16)
    assert sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()), key=str) == slow_removal(rows)


# ---- line dedup ------------------------------------------------------------------------------------------------------


def duck(sql: str, **tables) -> list[tuple]:  # noqa: ANN003
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return sorted(con.sql(sql).fetchall(), key=str)


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup_equals_sql(spark, seed) -> None:  # noqa: ANN001
    rows = [(i, t) for i, t in corpus(seed, 80) if t is not None]
    frame = docs(spark, rows)
    got = line_dedup.dedup_lines(frame).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == duck(line_dedup.OP7_SQL, documents=frame.toPandas())
    assert sum(r["n_removed"] for r in got) > 0


def test_line_dedup_of_odd_rows(spark) -> None:  # noqa: ANN001
    rows = [(0, None), (1, ""), (2, "a\nb\nc\nd"), (3, "x\na\nb\nc\nd\ny"), (3, "x\na\nb\nc\nd\ny"), (4, "\n\n\n\n"), (5, "\n\n\n\n"), (None, "a\nb\nc"), (6, "q\n" * 6)]
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs(spark, rows, n_lines="clash", pos="kept", w="kept")).collect()), key=str)
    want = [(0, None, 0), (1, "", 0), (2, "a\nb\nc\nd", 0), (3, "x\ny", 4), (3, "x\ny", 4), (4, "\n\n\n\n", 0), (5, "\n\n\n\n", 0), (6, "q", 6), (None, "", 3)]
    assert [g for g in got if g[0] != 6] == sorted((w for w in want if w[0] != 6), key=str)
    (six,) = [g for g in got if g[0] == 6]
    assert six[2] == 5 and six[1] in ("q\n", "q")
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# ---- SimHash ---------------------------------------------------------------------------------------------------------


def slow_print(text: str | None) -> int:
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in simhash.WORD.findall((text or "").encode())]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: list[int], radius: int) -> list[int]:
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return group


def test_fingerprints() -> None:
    for _, t in [*corpus(6), (0, "A"), (0, "Ab cD"), (0, "É É É"), (0, "w " * 70_000)]:
        assert simhash.fingerprint((t or "").encode()) == (slow_print(t) if len(t or "") < 50_000 else slow_print("w w w"))


@pytest.mark.parametrize("shard_rows", [8, 1000])
def test_components_equal_brute_force(spark, shard_rows) -> None:  # noqa: ANN001
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(20)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(frame, 2, shard_rows, 300)).collect()}
    got = [label.get(p, p) for p in signed]
    want = slow_components(prints, 2)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_hot_ball_is_dealt_into_parts(spark) -> None:  # noqa: ANN001
    """Near copies in one ball, far more than a shard holds: one component, and no more edges than rows in a part."""
    prints = [(1 << a) | (1 << b) for a in range(64) for b in range(a)][:1500]
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    edges = simhash.links(frame, 2, 10, 100)
    assert {r["label"] for r in simhash.components(edges).collect()} == {min(p - (1 << 64) if p >> 63 else p for p in prints)}


def test_near_duplicates_of_odd_rows(spark) -> None:  # noqa: ANN001
    rows = [*corpus(8), (None, "solo words here only"), (2, "another text for id two"), (5, None)]
    frame = docs(spark, rows, fp="clash", component_id="clash")
    got = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    prints = [slow_print(t) for _, t in rows]
    group = slow_components(prints, 2)
    least = {g: min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in set(group)}
    assert got == Counter((d, p, least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_group_stays(spark) -> None:  # noqa: ANN001
    """Groups are the components of both kinds of links; a seeded corpus with copies that differ in single words."""
    rng = random.Random(12)
    say = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    rows = [(i, " ".join(say(rng.randint(1, 120)))) for i in range(40)]
    for i in range(40, 90):
        words = rng.choice(rows)[1].split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(90, None), (91, ""), (92, " \n"), (None, rows[0][1]), (3, "another text for id three"), (3, rows[3][1]), (5, rows[5][1].upper())]
    sets = [set(similarity.shingles((t or "").encode())[1].tolist()) for _, t in rows]
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            linked = (prints[i] ^ prints[j]).bit_count() <= 2 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if linked and group[i] != group[j]:
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    frame = docs(spark, rows, node="clash", group="clash", _hash="clash")
    kept = similarity.keep_one(frame.drop("_hash"))
    assert kept.columns == frame.drop("_hash").columns
    found = Counter(r["doc_id"] for r in kept.collect())
    least = Counter(min((d for (d, _), h in zip(rows, group, strict=True) if h == g and d is not None), default=None) for g in set(group))
    assert found == least
    assert similarity.keep_one(docs(spark, [])).count() == 0


def slow_groups(sets: list[set]) -> list[int]:
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    return group


def edited_copies(n: int) -> list[tuple[int, str]]:
    """One original and n copies at 0.85 of it, each edited in places of its own: two copies have about 0.73."""
    rng = random.Random(21)
    first = [f"w{i}" for i in range(400)]
    rows = [(n // 2, " ".join(first))]
    for i in range(n):
        words = list(first)
        for at in rng.sample(range(5, 395, 10), 6):
            words[at] = f"own{i}at{at}"
        rows.append((i + (i >= n // 2), " ".join(words)))
    return rows


def test_pipeline_near_duplicates_of_one_original(spark) -> None:  # noqa: ANN001
    rows = edited_copies(500)
    group = slow_groups([set(similarity.shingles(t.encode())[1].tolist()) for _, t in rows])
    least = sorted(min(d for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group))
    assert len(least) == 1
    assert sorted(r["doc_id"] for r in similarity.keep_one(docs(spark, rows)).collect()) == least


def test_links_between_parts_of_a_large_group(spark) -> None:  # noqa: ANN001
    frame = docs(spark, edited_copies(150))
    marked = similarity.sketches(frame).cache()
    nodes = marked.select("node", "keys")
    own = similarity.shingle_sets(frame, marked, marked.select("node"))
    alone = marked.select("node", F.col("node").alias("label"))
    found = similarity.links_between(nodes, own, alone, part_nodes=20)
    assert found.count() < 25 * 8 * 8 / 2 * 40
    named = simhash.components(found)
    assert (named.count(), named.select("label").distinct().count()) == (150, 1)  # the least node has no row of its own
    assert similarity.links_between(nodes, own, named).count() == 0


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_sharding_law_and_mixture(spark) -> None:  # noqa: ANN001
    rows = [(i, "t" * (i % 7)) for i in range(1000)] + [(5, "t" * 5), (5, "t" * 5), (None, None)]
    frame = docs(spark, rows, slot="clash").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    got = sharding.interleave(frame, 16, rows_per_range=50).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    for source in {r["source"] for r in got}:
        of = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(of[s] for s in range(16)) - min(of[s] for s in range(16)) <= 2
    assert sharding.interleave(frame.limit(0)).count() == 0
    alone = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.col("id").alias("text_crc32"))
    assert len({r["shard"] for r in sharding.interleave(alone, 16, rows_per_range=10).collect()}) == 16


def slow_shards(rows: list[tuple], n_shards: int, seed: int) -> list[tuple]:
    """(doc_id, source, crc, shard, slot), by definition: MD5 order inside each source, fractional ranks, equal runs."""
    number = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:12], 16)
    keyed = []
    for name in {r[1] for r in rows}:
        stratum = f"s{name}" if name is not None else "-"
        own = sorted((number(*(x for x in (seed, d, c) if x is not None)), -1 if d is None else d, c, name) for d, s, c in rows if s == name)
        phase = number(seed, stratum) / 2.0**48
        keyed += [(int((k + phase) / len(own) * 2.0**48), stratum, d, c, name) for k, (_, d, c, name) in enumerate(own)]
    out, firsts = [], {}
    for place, (_, _, d, c, name) in enumerate(sorted(keyed, key=lambda x: x[:4])):
        shard = place * n_shards // len(keyed)
        firsts.setdefault(shard, place)
        out.append((None if d == -1 else d, name, c, shard, place - firsts[shard]))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_range", [1000, 7])
def test_sharding_equals_brute_force(spark, rows_per_range) -> None:  # noqa: ANN001
    rng = random.Random(17)
    rows = [(rng.randint(0, 400), rng.choice(["web", "web", "web", "book", None, f"rare{i % 9}"]), rng.randint(0, 9)) for i in range(700)] + [(None, "web", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text_crc32 long").repartition(3)
    got = sharding.interleave(frame, 16, 20, rows_per_range).select("doc_id", "source", "text_crc32", "shard", "slot").collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_shards(rows, 16, 20)


def test_sharding_of_odd_rows(spark) -> None:  # noqa: ANN001
    """Names that the operator uses itself, texts without a checksum column, a very long text."""
    frame = docs(spark, [(1, "a"), (1, "b"), (2, None), (3, "x" * 2_000_000)], _range="r", _before="b", _rank="k", _row="w", _key="q")
    got = sharding.interleave(frame, 2)
    assert got.columns == [*frame.columns, "shard", "slot"]
    assert Counter(r["shard"] for r in got.collect()) == {0: 2, 1: 2}
    bare = sharding.interleave(frame.select("doc_id", "source"), 3)
    assert bare.columns == ["doc_id", "source", "shard", "slot"] and bare.count() == 4


def test_sharding_query(spark, sf_dir) -> None:  # noqa: ANN001
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in sharding.op9_sharding(spark, sf_dir).collect():
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)


# ---- chat ------------------------------------------------------------------------------------------------------------


def test_template_reads_back() -> None:
    rng = random.Random(10)
    for _ in range(2000):
        turns = [("".join(rng.choices(["user", "assistant", "</s>", "\\", "[INST]"], k=1)), "".join(rng.choices([*chat.CONTROL, "\\", "a", "\n", "<", "[", "/", "s>", "INST]", "é"], k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == chat.ASSISTANT]
        for r, t in turns:
            assert not any(c in chat.escape(t) for c in chat.CONTROL)


def slow_paths(rows: list[tuple], top: int) -> dict:
    """tree -> the best paths as (score, leaf, ids from the root)."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {n: (p, s) for t, n, p, s, *_ in rows if t == tree}
        parents = {p for p, _ in own.values()}
        paths = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at in path:
                continue
            paths.append((-sum(own[x][1] or 0 for x in path), leaf, path[::-1]))
        out[tree] = [(leaf, path) for _, leaf, path in sorted(paths)[:top]]
    return out


def test_paths_of_trees(spark) -> None:  # noqa: ANN001
    rng = random.Random(11)
    rows = []
    for tree in [*range(12), None]:
        for node in range(rng.randint(1, 25)):
            parent = rng.choice([None, 99, *range(node)]) if node else None
            rows.append((tree, node, parent, float(rng.randint(0, 3)) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["x", None, "</s>"])))
    rows += [(50, 0, 1, 1.0, "user", "a"), (50, 1, 0, 1.0, "user", "b"), (51, 0, None, 1.0, "user", "a")]  # a cycle
    rows += [(60, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(70)]  # deep
    frame = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string").repartition(3)
    said = {(t, n): (r or "", x or "") for t, n, _, _, r, x in rows}
    got = {}
    for r in chat.format_trees(frame, top=2).collect():
        got.setdefault(r["tree"], []).append((r["rank"], r["leaf"], chat.read_back(r["formatted"])))
    want = slow_paths(rows, 2)
    for tree, best in want.items():
        assert [(leaf, turns) for _, leaf, turns in sorted(got.get(tree, []))] == [(leaf, [said[tree, n] for n in path]) for leaf, path in best]


def test_chat_of_odd_tables(spark) -> None:  # noqa: ANN001
    kind = "conv_id long, turn long, role string, text string, node string"
    rows = [(1, 0, "user", None, "clash"), (1, 0, "user", None, "clash"), (1, None, None, "x", "clash"), (None, 0, "assistant", "y", "clash")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.as_trees(spark.createDataFrame(rows, kind)))).collect()}
    assert (got[1]["n_turns"], got[None]["n_turns"], got[None]["loss_chars"]) == (3, 1, 1)
    assert chat.digests(chat.format_trees(chat.as_trees(spark.createDataFrame([], kind)))).count() == 0


# ---- queries and pipeline --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, sf_dir, name) -> None:  # noqa: ANN001
    found = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(found.columns)
    at = [want.columns.index(c) for c in found.columns]
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_pipeline(spark, sf_dir) -> None:  # noqa: ANN001
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = frame.columns, frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), frame.schema)
        assert after.columns == columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r[0] for r in before.select("doc_id").collect()}
    assert 0 < len(got) < frame.count()


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path) -> None:  # noqa: ANN001
    """Nulls, empty and very long texts, repeated rows and columns with clashing names, through each stage; and no rows at all."""
    import corpus_pipeline

    rng = random.Random(18)
    long = " ".join(f"word{rng.randint(0, 999)}" for _ in range(60_000))
    rows = [(1, None), (2, ""), (None, "a null id. With a sentence."), (3, "same text, here it is."), (3, "same text, here it is."), (4, "a\nb\nc\nd"), (5, long), (6, "same text, here it is.")]
    frame = docs(spark, rows, _hash="clash", node="clash", group="clash", item_ids="clash", n_lines="clash")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, frame, sf_dir).collect()
        ids = Counter(r["doc_id"] for r in got)
        assert set(ids) <= {1, 2, 3, 4, 5, 6, None}, name
        if name == "SimHash near-dedup":
            assert ids == {None: 1, 1: 1, 3: 1, 4: 1, 5: 1}  # empty texts are equal, and so are those of 3 and 6
        if name in ("line dedup", "BPE encoding and decoding"):
            assert sum(ids.values()) == len(rows)
        assert stage(spark, frame.limit(0), sf_dir).count() == 0


def test_pipeline_equals_its_operators(spark, sf_dir, tmp_path) -> None:  # noqa: ANN001
    """run() against the public operators (whose own results are held against brute force), joined by id on the driver."""
    import corpus_pipeline

    from pulsegrid.llm import bpe, decontamination, quality

    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    frame = lambda texts: spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    texts = dict(read("documents").select("doc_id", "text").collect())
    good = {r["doc_id"] for r in quality.classify(read("documents"), read("labels")).collect() if r["predicted"]}
    texts = {d: t for d, t in texts.items() if d in good}
    texts = dict(line_dedup.dedup_lines(frame(texts)).select("doc_id", "text").collect())
    prints = {d: slow_print(t) for d, t in texts.items()}
    sets = {d: set(similarity.shingles((t or "").encode())[1].tolist()) for d, t in texts.items()}
    first: dict[int, int] = {d: d for d in texts}

    def root(d: int) -> int:
        while first[d] != d:
            d = first[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                first[y] = x
    texts = {d: t for d, t in texts.items() if root(d) == d}
    index = decontamination.Index.build(list(read("benchmark").select("item_id", "text").collect()))
    texts = {d: t for d, t in texts.items() if not index.search([decontamination.normal(t)])[0]}
    encoder = bpe.Encoder(bpe.vocabulary_of(None))
    want = {d: len(encoder.library.encode(t or "", add_special_tokens=False).ids) for d, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == want
