"""One document of each group of near-duplicates: SimHash components, widened to a shingle similarity.

A fingerprint within two bits means texts that differ in very few words. Copies whose five-word shingle sets still have
a Jaccard similarity of 0.8 lie five to fifteen bits apart, where a vantage-point tree over 64 bits no longer prunes. So
for the corpus pipeline the components of ``simhash`` are joined with links of that similarity: candidates share one of
``BANDS`` band keys (``ROWS`` minima of shingle hashes each; a pair at 0.8 shares none with a chance below 1 in 10,000),
and each candidate's similarity is then computed exactly from the shingle sets.

Texts with equal word sequences are one node. All pairs of a band's group are compared, in two steps. First each node
meets four leaders of the group (the least and greatest of two orders), which compares groups of up to three nodes wholly
and connects most of a larger group of copies. Then only pairs of different components can add anything: in a larger
group that holds several components, the nodes outside its most common component meet all others. Both kinds are dealt
by a hash into parts of bounded rows and bytes, each two parts meet in one task, and a task returns spanning-forest edges
of verified links, never the pairs themselves; inside a task only sets that hold a row's rarest shingles and have a
fitting size are compared. A group without a common core takes tasks by the square of its parts, but no memory beyond
two parts.

Defined cases: a null text counts as empty; texts of fewer words than a shingle are compared as wholes; texts without
words are equal; a very long text is one node, read whole; rows with equal doc_id and equal text are one document, of
which one row stays; a null doc_id counts as greater than any other; of a component one row stays, that of the least id
(and of its texts, the least hash); an empty table gives an empty result; extra columns are kept, with any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import simhash
from pulsegrid.llm.common import LONG_MAX, cut, lean, text_or_empty, write_table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Nodes, and bytes of shingle sets, of one part of a large group.
PART_NODES, PART_BYTES = 1000, 4 << 20
#: A second order of nodes for choosing leaders.
TURN = 0x2545F4914F6CDD1D
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> tuple[int, np.ndarray]:
    """(hash of the word sequence, sorted hashes of its distinct shingles).

    A shingle's hash is a polynomial over the 64-bit hashes of its words, mixed once more.
    """
    found = simhash.WORD.findall(text.translate(simhash._LOWER))
    whole = xxhash.xxh64_intdigest(b" ".join(found), 2)
    n = len(found) - words + 1
    if n < 2:
        return whole, np.array([whole], dtype=np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    each = word[:n].copy()
    for k in range(1, words):
        each *= _STEP
        each += word[k : k + n]
    each ^= each >> np.uint64(31)
    each *= _STEP
    return whole, np.unique(each ^ (each >> np.uint64(29)))


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of its minima."""
    least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(own), 1024):  # the hashes are random, so factor and term make orders enough
        part = own[None, start : start + 1024] * _FACTORS[:, None]
        part += _TERMS[:, None]
        least = np.minimum(least, part.min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64) * _STEP
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * _STEP
        key ^= key >> np.uint64(29)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, _hash (of the text), node (of the word sequence), keys (of the bands)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [shingles(x.as_py()) for x in part.column(2).cast(pa.large_binary())]
                nodes = np.array([w for w, _ in found], dtype=np.uint64).view(np.int64)
                keys = np.concatenate([band_keys(s) for _, s in found]).view(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), listed], ["doc_id", "_hash", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(lean(compute), "doc_id long, _hash long, node long, keys array<long>")


def candidates(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes (node, keys) that share a band with a leader of it."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    turned = F.col("node").bitwiseXOR(F.lit(TURN))
    lead = rows.groupBy("key").agg(F.min("node").alias("_1"), F.max("node").alias("_2"), F.min(turned).alias("_3"), F.max(turned).alias("_4")).filter("_1 <> _2")
    leaders = F.array_distinct(F.array("_1", "_2", F.col("_3").bitwiseXOR(F.lit(TURN)), F.col("_4").bitwiseXOR(F.lit(TURN))))
    met = rows.join(lead, "key").select("node", F.explode(leaders).alias("other")).filter("node <> other")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def shingle_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, own (40 bits of each shingle's hash), size (bytes of own) for the wanted nodes. marked: sketches of docs."""
    # one row of docs for each node that is wanted
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LONG_MAX))
    one = marked.select("node", doc.alias("_doc"), "_hash").join(wanted, "node").groupBy("node").agg(F.min(F.struct("_doc", "_hash")).alias("m")).select("node", "m.*")
    texts = docs.select(doc.alias("_doc"), F.xxhash64(text_or_empty()).alias("_hash"), text_or_empty().alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(shingles(x.as_py())[1] >> np.uint64(24)).astype("<u8") for x in batch.column(1).cast(pa.large_binary())]
            packed = [x.view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "own"])

    own = texts.join(one, ["_doc", "_hash"]).select("node", "text").mapInArrow(lean(sets), "node long, own binary").dropDuplicates(["node"])
    return write_table(own.withColumn("size", F.length("own")), "shingle-sets")


def similar(pairs: DataFrame, own: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those pairs (a, b) of nodes with a Jaccard similarity of at least ``similarity``."""
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.unique(np.frombuffer(v.as_py(), dtype="V5")) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(lean(check), "a long, b long")


def forest(label: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of left and of right that join the components of label: edges of a spanning forest.

    A similar set lacks at most n - ceil(similarity n) of a row's n shingles, so it holds one of any that many and one
    more: only holders of a row's rarest so many, with a size that can be similar, are compared.
    """
    label, sizes = label.copy(), np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(sizes)])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(shingle, kind="stable")]  # of the first shingle, the second, ...
    counts = np.bincount(shingle)
    starts = np.cumsum(counts) - counts
    on_right = np.zeros(len(sets), dtype=bool)
    on_right[right] = True
    mine_too = np.zeros(len(counts), dtype=bool)
    edges = []
    for i in left.tolist():
        mine = shingle[at[i] : at[i + 1]]
        probe = mine[np.argsort(counts[mine], kind="stable")[: len(mine) - int(np.ceil(similarity * len(mine) - 1e-9)) + 1]]
        n = counts[probe]
        places = np.repeat(starts[probe] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        other = np.unique(holders[places])
        other = other[on_right[other] & (label[other] != label[i]) & (sizes[other] >= similarity * sizes[i]) & (sizes[i] >= similarity * sizes[other])]
        if not len(other):
            continue
        mine_too[mine] = True
        size = sizes[other]
        rows = np.arange(size.sum()) + np.repeat(at[other] - (np.cumsum(size) - size), size)
        shared = np.add.reduceat(mine_too[shingle[rows]].astype(np.int64), np.cumsum(size) - size)
        mine_too[mine] = False
        for j in other[shared >= similarity * (sizes[i] + size - shared)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                edges.append((i, j))
    return edges


def links_between(nodes: DataFrame, own: DataFrame, label: DataFrame, similarity: float = SIMILARITY, part_nodes: int = PART_NODES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Links (a, b) of nodes (node, keys) in the same band's group that join different components of label (node, label)."""
    named = nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "keys").join(own.select("node", "size"), "node")
    rows = named.select("node", "label", "size", F.explode("keys").alias("key"))
    # groups of up to three nodes met wholly through their leaders
    named = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    main = F.max_by(F.struct("label", "n", "bytes"), F.struct("n", "label"))
    mixed = named.groupBy("key").agg(main.alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels")).filter("n > 3 and labels > 1")
    n_parts = lambda n, size: F.ceil(F.greatest(n / part_nodes, size / part_bytes)).cast("int")
    mixed = mixed.select(
        "key",
        F.col("main.label").alias("main"),
        n_parts(F.col("main.n"), F.col("main.bytes")).alias("n_main"),
        n_parts(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("n_rest"),
    )
    # parts 0 to n_rest - 1 hold the rest, which meets every part; those from n_rest on hold the most common component
    own_part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    in_main = F.col("label") == F.col("main")
    dealt = rows.join(mixed, "key").withColumn("part", F.when(in_main, F.col("n_rest") + own_part(F.col("n_main"))).otherwise(own_part(F.col("n_rest"))))
    others = F.sequence(F.lit(0), F.when(in_main, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_main")) - 1)
    dealt = dealt.withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        node, label, part = (group.column(c).to_numpy() for c in ("node", "label", "part"))
        left, right = (np.flatnonzero(part == key[k].as_py()) for k in (1, 2))
        found: list[tuple[int, int]] = []
        if len(left) and len(right) and (label != label[0]).any():
            sets = []
            for x in group.column("own"):
                wide = np.zeros((len(x.as_py()) // 5, 8), dtype=np.uint8)
                wide[:, :5] = np.frombuffer(x.as_py(), dtype=np.uint8).reshape(-1, 5)
                sets.append(np.unique(wide.view("<u8").ravel()))
            found = forest(label, left, right, sets, similarity)
        return pa.table({"a": pa.array([int(node[i]) for i, _ in found], pa.int64()), "b": pa.array([int(node[j]) for _, j in found], pa.int64())})

    return dealt.join(own.select("node", "own"), "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, _hash and group (a node) of each row of docs: rows linked by fingerprints or by shingle sets."""
    marked = write_table(sketches(docs), "sketches")
    prints = simhash.near_duplicates(docs).select("doc_id", "_hash", "_label")
    by_text = marked.groupBy("_hash").agg(F.first("node").alias("node"))  # equal texts have equal nodes
    named = prints.select("_hash", "_label").distinct().join(by_text, "_hash").select("_label", "node").distinct()
    least = named.groupBy("_label").agg(F.min("node").alias("a"))
    same_print = named.join(least, "_label").select("a", F.col("node").alias("b"))
    nodes = marked.groupBy("node").agg(F.first("keys").alias("keys"))
    pairs = cut(candidates(nodes))
    own = shingle_sets(docs, marked, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    label = simhash.components(similar(pairs, own).unionByName(same_print))
    more = cut(links_between(nodes, own, label))
    if not more.isEmpty():
        label = simhash.components(more.unionByName(label.toDF("a", "b")))
    rows = marked.select("doc_id", "_hash", "node")
    return rows.join(label, "node", "left").select("doc_id", "_hash", F.coalesce("label", "node").alias("group"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: one row of each group. Columns keep their names and values, whatever they are called."""
    doc = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LONG_MAX))
    first = groups(docs.select("doc_id", "text")).groupBy("group").agg(F.min(F.struct(doc("doc_id").alias("_doc"), "_hash")).alias("m")).select("m.*")
    keyed = docs.select(doc("doc_id").alias("_doc"), F.xxhash64(text_or_empty()).alias("_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return keyed.join(first, ["_doc", "_hash"], "left_semi").dropDuplicates(["_doc", "_hash"]).select("row.*")
