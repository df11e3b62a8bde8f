"""SimHash near-dedup with vantage-point trees.

Each text gets a 64-bit fingerprint (a bit is 1 if more than half of the hashes of its word shingles have it). Two
fingerprints link if they differ in at most ``radius`` bits; documents that links connect form a component.

How exact pairs are found without comparing all pairs:

1. Equal fingerprints are one node, so copies cost nothing further.
2. A vantage-point tree is fitted on a bounded sample of the nodes (``sample_rows``, by a hash). Each inner node holds a
   vantage point and a radius: fingerprints within it go to the inner child, the others to the outer child. A branch of
   the sample is split until it holds about ``shard_rows`` rows of the table. The sample grows with the table up to
   ``MOST_SAMPLED``, so leaves keep their size up to some 10^9 distinct fingerprints; beyond, full shards are dealt (4).
3. Every node is at home in one leaf, a shard. By the triangle inequality a partner lies on the other side of a
   boundary only if the node is within ``radius`` bits of it. Nodes near a boundary visit the other side too: a home
   node crosses from inner to outer only (of two partners at home on both sides it's enough that one visits), a
   visitor crosses both ways. So each linking pair meets in the home shard of one of the two, and no other pair has to.
4. A shard with more home rows than planned is dealt by a hash into parts; parts visit one another, so that no pair is
   lost and no task gets more.
5. In a shard, distances are counted in blocks with numpy and only the edges of a spanning forest are returned, at most
   one per row, never all pairs of a group.

Components: the least document id of each node is sent along the forest edges with alternating large-star and
small-star steps, over checkpointed tables.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other; rows
with equal doc_id each get their own row, with the same component if their texts are equal; a very long text is read
whole, its shingles counted in blocks; a null doc_id takes part
but never names a component, unless the component has no other id; an empty table gives an empty result; extra columns
are ignored, whatever they are called: the result has the columns made here alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import LONG_MAX, cut, lean, table, text_or_empty

#: Words of the fingerprints: runs of bytes that aren't ASCII white space.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Fingerprints that a tree is fitted on: at least, and at most.
LEAST_SAMPLED, MOST_SAMPLED = 20_000, 500_000
_BITS = np.arange(64, dtype=np.uint64)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _lower(text: bytes) -> bytes:
    """A-Z in small letters, all other bytes as they are."""
    return text.translate(_LOWER)


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """The 64-bit SimHash of a text in UTF-8."""
    words = WORD.findall(_lower(text))
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle_words + 1
    # shingles are slices of the words joined by spaces
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    each = map(whole.__getitem__, map(slice, starts, (ends[shingle_words - 1 :] - 1).tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 65_536):
        part = hashes[start : start + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[ones * 2 > n]).sum(dtype=np.uint64)) if (ones * 2 > n).any() else 0


def with_fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, _hash (of the text) and fp (the fingerprint as a signed long)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            prints = np.array([fingerprint(x.as_py(), shingle_words) for x in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(lean(compute), "doc_id long, _hash long, fp long")


# ---- the vantage-point tree ------------------------------------------------------------------------------------------


#: Inner nodes of a tree: vantage point, bits, inner child, outer child; a child below zero is leaf -child - 1.
_NODE = np.dtype([("vantage", "u8"), ("bits", "i4"), ("inner", "i4"), ("outer", "i4")])


def build_tree(sample: np.ndarray, leaf_rows: float, seed: int = 7) -> np.ndarray:
    """The inner nodes of a tree over the sample, the root first; none if it is one leaf.

    A branch in which no vantage point tried parts the rows stays one leaf.
    """
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(rows) > leaf_rows:
            for vantage in rng.choice(rows, size=min(4, len(rows)), replace=False):
                far = np.bitwise_count(rows ^ vantage)
                bits = int(np.median(far))
                inside = int((far <= bits).sum())
                if inside == len(rows):
                    bits -= 1
                    inside = int((far <= bits).sum())
                near = int((np.abs(far.astype(int) - bits) <= 2).sum())
                if 0 < inside < len(rows) and (best is None or near < best[0]):
                    best = (near, int(vantage), bits, far <= bits)
        if best is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        nodes[at] = (best[1], best[2], grow(rows[best[3]]), grow(rows[~best[3]]))
        return at

    grow(sample)
    return np.array(nodes, dtype=_NODE)


def place(prints: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home) for every leaf in which a row is at home or visits."""
    rows, leaves, homes = [], [], []
    stack = [(0 if len(tree) else -1, np.arange(len(prints)), np.ones(len(prints), dtype=bool))]
    while stack:
        node, index, home = stack.pop()
        if not len(index):
            continue
        if node < 0:
            rows.append(index)
            leaves.append(np.full(len(index), -node - 1, dtype=np.int32))
            homes.append(home)
            continue
        vantage, bits, inner, outer = tree[node].tolist()
        far = np.bitwise_count(prints[index] ^ np.uint64(vantage)).astype(np.int16)
        inside = far <= bits
        to_outer = ~inside | (far + radius > bits)
        to_inner = inside | (~home & (far - radius <= bits))
        stack.append((inner, index[to_inner], (home & inside)[to_inner]))
        stack.append((outer, index[to_outer], (home & ~inside)[to_outer]))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool)
    return np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)


def forest(homes: np.ndarray, visitors: np.ndarray, radius: int, block: int = 1024) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among homes and between visitors and homes."""
    both = np.concatenate([homes, visitors])
    label = np.arange(len(both))
    edges = []
    for start in range(0, len(homes), block):
        part = homes[start : start + block]
        for other in range(start, len(both), 8 * block):
            near = np.bitwise_count(part[:, None] ^ both[None, other : other + 8 * block]) <= radius
            while True:
                # links inside what is connected already add nothing; one new link for each row at a time
                near &= label[start : start + len(part), None] != label[None, other : other + 8 * block]
                rows = np.flatnonzero(near.any(axis=1))
                if not len(rows):
                    break
                for i, j in zip((rows + start).tolist(), (near[rows].argmax(axis=1) + other).tolist(), strict=True):
                    a, b = label[i], label[j]
                    if a != b:
                        label[label == b] = a
                        edges.append((i, j))
    values = both.view(np.int64)
    return [(int(values[a]), int(values[b])) for a, b in edges]


def links(prints: DataFrame, radius: int, shard_rows: int = 1000, sample_rows: int | None = None) -> DataFrame:
    """Forest edges (a, b) whose connected components are those of all links. prints: distinct fp."""
    total = prints.count()
    if total == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    if sample_rows is None:
        sample_rows = min(MOST_SAMPLED, max(LEAST_SAMPLED, 4 * total // shard_rows))
    taken = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 40)) < int(sample_rows / total * (1 << 40))) if total > sample_rows else prints
    sample = np.array([r[0] for r in taken.collect()], dtype=np.int64).view(np.uint64)
    tree = build_tree(np.sort(sample), max(2.0, shard_rows * len(sample) / total))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                own = batch.column(0).slice(start, 2048).to_numpy(zero_copy_only=False)
                row, leaf, home = place(own.view(np.uint64), tree, radius)
                yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(leaf), pa.array(home)], ["fp", "leaf", "home"])

    placed = prints.mapInArrow(lean(assign), "fp long, leaf int, home boolean")
    # One row for each leaf: as many as the tree has, a bounded table. Parts of a full shard: homes by a hash; the others visit.
    sizes = placed.groupBy("leaf").agg(F.count_if("home").alias("n")).filter(F.col("n") > 8 * shard_rows)
    sizes = cut(sizes.select("leaf", F.ceil(F.col("n") / (4 * shard_rows)).cast("int").alias("n_parts")))
    placed = placed.join(F.broadcast(sizes), "leaf", "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("n_parts")).cast("int")
    first = F.when(F.col("home"), own).otherwise(F.lit(0))
    placed = placed.withColumn("_own", own).withColumn("part", F.explode(F.sequence(first, F.col("n_parts") - 1)))
    placed = placed.select("fp", "leaf", "part", (F.col("home") & (F.col("part") == F.col("_own"))).alias("home"))

    def search(key: tuple, group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy()
        found = forest(np.sort(fps[home]), np.sort(fps[~home]), radius)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return placed.groupBy("leaf", "part").applyInArrow(search, "a long, b long")


# ---- components ------------------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the least node of the component, for every node that has an edge.

    Large-star and small-star steps: each moves the neighbours of a node to the least of them, until nothing moves.
    Rows per step stay within twice the edges.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above u go to the least neighbour of u (or u)
        both = pairs.union(pairs.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        pairs = cut(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle_words: int = 3, shard_rows: int = 1000, sample_rows: int | None = None) -> DataFrame:
    """docs' doc_id and _hash with fp, component_id and _label (a fingerprint of the component); one row for each row of docs."""
    prints = cut(with_fingerprints(docs, shingle_words))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    label = components(links(nodes.select("fp"), radius, shard_rows, sample_rows))
    # (fp, component's fp); nodes without a link are components of their own
    named = nodes.join(label, nodes.fp == label.node, "left").select("fp", "_least", F.coalesce("label", "fp").alias("_label"))
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    named = named.join(least, "_label").select("fp", "component_id", "_label")
    return prints.join(named, "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    docs = table(spark, sf_dir, "documents")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

