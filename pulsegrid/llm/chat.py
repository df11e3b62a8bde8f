"""Chat formatting of reply trees.

A tree's messages refer to the message they answer. Root-to-leaf paths come from self-joins that double their reach:
after k joins each message knows its ancestor 2^k answers up, how many messages and how much score lie between. The
number of joins follows the logarithm of the deepest tree. Leaves are ranked in each tree by the sum of scores along
their path; the messages of each chosen path are then listed by walking the same jumps back from its leaf, again one
join for each power of two, so no path is carried along as an array. Each chosen path becomes one formatted
conversation with the spans of its loss mask (the assistant's texts).

The template writes a turn as ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts are broken by a
backslash after their first character, and backslashes are doubled, so every text can be read back.

Defined cases: a null role or text counts as empty; a parent that isn't in the tree makes its message a root; messages
on a cycle have no root and are left out; of messages with equal tree and id one is kept, the least by (parent, role,
text); equal path scores are ranked by the leaf's id; a null tree is a tree of its own; an empty table gives an empty
result; extra columns are ignored. A conversation is one row of the result, so it has to fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import cut, table

START, END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]"
#: Control strings of chat templates; none of them is left whole inside a text.
CONTROL = (START, END, ROLE, ROLE_END, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_SPECIAL = re.compile(r"\\|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of code points under the loss mask."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = f"{START}{ROLE}{escape(role)}{ROLE_END}", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, path_score, depth, node): the messages of the ``top`` best paths of each tree.

    messages: tree, node, parent, score with unique (tree, node); depth counts from the root, 1 first.
    """
    node = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = node.select(F.col("tree").alias("t"), F.col("node").alias("known"))
    step = node.join(ids, node["tree"].eqNullSafe(ids["t"]) & (node["parent"] == ids["known"]), "left")
    # up: the ancestor 2^k answers above (null beyond the root); depth and total: of the messages below it
    step = cut(step.select("tree", "node", F.col("known").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    jumps = [step]
    bound = max(1, node.count()).bit_length() + 1
    while len(jumps) <= bound and not step.filter("up is not null").isEmpty():
        above = step.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("u"), F.col("depth").alias("d"), F.col("total").alias("s"))
        open_ = step.filter("up is not null")  # messages that have met their root stay as they are
        met = open_.join(above, open_["tree"].eqNullSafe(above["t"]) & (open_["up"] == above["n"]))
        met = met.select("tree", "node", F.col("u").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("s")).alias("total"))
        step = cut(step.filter("up is null").unionByName(met))
        jumps.append(step)
    rooted = step.filter("up is null")
    parents = jumps[0].filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["node"] == parents["u"]), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    walked = cut(chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("path_score"), "node"))
    for jump in reversed(jumps[:-1]):
        up = jump.filter("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = walked.join(up, walked["tree"].eqNullSafe(up["t"]) & (walked["node"] == up["n"])).select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"))
        walked = cut(walked.union(more))  # else the plan would double with each step
    deep = rooted.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    met = walked.join(deep, walked["tree"].eqNullSafe(deep["t"]) & (walked["node"] == deep["n"]))
    return met.select("tree", "leaf", "rank", "path_score", "depth", "node")


_FORMATTED = "leaf long, rank int, path_score double, formatted string, loss_spans array<array<long>>"


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, path_score, formatted, loss_spans (start, end in code points).

    messages: tree, node (long), parent, score, role, text.
    """
    least = F.min_by(F.struct("parent", "score", "role", "text"), F.struct("parent", "role", "text", "score"))
    one = messages.filter(F.col("node").isNotNull()).groupBy("tree", F.col("node").cast("long").alias("node")).agg(least.alias("m")).select("tree", "node", "m.*")
    one = cut(one)
    listed = paths(one, top)
    said = one.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = listed.join(said, listed["tree"].eqNullSafe(said["t"]) & (listed["node"] == said["n"]))
    whole = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), pa.array([f for f, _ in done], pa.string()), pa.array([[list(x) for x in s] for _, s in done], pa.list_(pa.list_(pa.int64())))],
                    ["tree", "leaf", "rank", "path_score", "formatted", "loss_spans"],
                )

    kind = whole.schema["tree"].dataType.simpleString()
    return whole.select("tree", "leaf", "rank", "path_score", "turns").mapInArrow(write, f"tree {kind}, {_FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations (tree, formatted, loss_spans)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[a:b]) for a, b in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, turns_sha, chars, loss_sha, size = zip(*out, strict=True) if out else ([],) * 5
            columns = [pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(read, schema)


def as_trees(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees without branches: each row answers the one before; repeated turns follow one another."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").cast("long").alias("tree"), "node", parent.alias("parent"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, read back from their formatted form."""
    tricky = f"{END}{ROLE} ok {ROLE_END}"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(tricky).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_trees(as_trees(rows)))


OP1_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
      '<(/?s>|</?SYS>>|[|](?:im_start|im_end|endoftext)[|]>)', '<' || chr(92) || chr(92) || '\\1', 'g'),
      '\\[(/?INST\\])', '[' || chr(92) || chr(92) || '\\1', 'g'), 'x^', '') as escaped from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(escaped) + 20) as bigint) as formatted_chars
from e group by conv_id
"""
