"""Operator 8, chat formatting of reply trees.

``reply_paths`` takes messages (tree_id, msg_id, parent_id, role, text, score) and enumerates root-to-leaf paths by
iterative self-joins. The joins double: after round j every message knows its 2^j-th ancestor, so a path of d messages
takes log2(d) joins, not d. Each tree keeps its ``top_k`` best leaves (largest sum of scores along the path, then the
smallest msg_id). ``format_paths`` then writes every chosen path as one conversation with its loss mask, and
``parse_conversation`` reads it back.

Defined cases: a parent_id that names no message of the tree makes its message a root; messages on a parent cycle have
no root and are left out; rows that share tree_id and msg_id are one message
(the least by parent_id, role, text and score); null text is empty; null role is the empty role; null score is 0; an empty table gives an
empty table; extra columns are ignored. Trees are identified by any non-null key (the query maps a null conv_id to a
key of its own). One conversation is one output string, so its turns have to fit one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import read, stored

TURN_OPEN, ROLE_END, TURN_CLOSE = "### ", ": ", "</turn>\n"
_IN_TEXT = re.compile(r"\\|### |</turn>")
_IN_ROLE = re.compile(r"[\\:\n]")
_TURN = re.compile(r"### ((?:[^\\:\n]++|\\[\s\S])*+): ((?:[^\\<]++|\\[\s\S]|<(?!/turn>))*+)</turn>\n")
_ESCAPED_TEXT = re.compile(r"\\(\\|### |</turn>)")
_ESCAPED_ROLE = re.compile(r"\\([\\:\n])")


def escape_text(text: str) -> str:
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape_text(text: str) -> str:
    return _ESCAPED_TEXT.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """(role, text) turns as one string, and the spans (code points, end exclusive) that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN_OPEN + _IN_ROLE.sub(lambda m: "\\" + m[0], role) + ROLE_END
        body = escape_text(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TURN_CLOSE]
        at += len(head) + len(body) + len(TURN_CLOSE)
    return "".join(parts), spans


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """Inverse of ``format_turns``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((_ESCAPED_ROLE.sub(lambda x: x[1], m[1]), unescape_text(m[2])))
        at = m.end()
    return turns


def reply_paths(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """Rows (tree_id, leaf_id, path_rank, path_score, depth, role, text): the messages of each chosen path; depth counts from 0 at the root."""
    m = messages.select("tree_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    # a message that is there several times is one
    once = m.groupBy("tree_id", "msg_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("x"))
    m = stored(once.select("tree_id", "msg_id", "x.parent_id", "x.role", "x.text", "x.score"), "messages")
    known = m.select("tree_id", F.col("msg_id").alias("anc"))
    state = stored(
        m.select("tree_id", F.col("msg_id").alias("node"), F.col("parent_id").alias("anc"), "score")
        .join(known.withColumn("found", F.lit(True)), ["tree_id", "anc"], "left")
        .select("tree_id", "node", F.when(F.col("found"), F.col("anc")).alias("anc"), F.lit(1).cast("long").alias("hops"), "score"),
        "jump",
    )
    total, pending = state.agg(F.count(F.lit(1)), F.count("anc")).first()
    jumps = []
    while pending and len(jumps) <= math.log2(total) + 1:
        jumps.append(state.where("anc is not null").select("tree_id", "node", "anc"))
        up = state.select("tree_id", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("hops2"), F.col("score").alias("score2"))
        on = state.where("anc is not null").join(up, ["tree_id", "anc"]).select("tree_id", "node", F.col("anc2").alias("anc"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("score") + F.col("score2")).alias("score"))
        state = stored(state.where("anc is null").unionByName(on), "jump")
        pending = state.where("anc is not null").count()
    rooted = state.where("anc is null")
    leaves = rooted.join(m.select("tree_id", F.col("parent_id").alias("node")).where("node is not null").distinct(), ["tree_id", "node"], "left_anti")
    best = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "node")
    paths = leaves.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= top_k)
    paths = stored(paths.select("tree_id", F.col("node").alias("leaf_id"), "node", "path_rank", F.col("score").alias("path_score")), "path")
    for jump in jumps:
        up = paths.join(jump, ["tree_id", "node"]).select("tree_id", "leaf_id", F.col("anc").alias("node"), "path_rank", "path_score")
        paths = stored(paths.unionByName(up), "path")
    return (
        paths.join(rooted.select("tree_id", "node", (F.col("hops") - 1).alias("depth")), ["tree_id", "node"])
        .join(m.select("tree_id", F.col("msg_id").alias("node"), "role", "text"), ["tree_id", "node"])
        .select("tree_id", "leaf_id", "path_rank", "path_score", "depth", "role", "text")
    )


def format_paths(paths: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per path: tree_id, leaf_id, path_rank, path_score, formatted, loss_spans."""
    grouped = paths.groupBy("tree_id", "leaf_id", "path_rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    kinds = dict(grouped.dtypes)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns], trained) for turns in batch.pop("turns")]
            batch["formatted"] = [x[0] for x in done]
            batch["loss_spans"] = [[{"start": a, "end": b} for a, b in x[1]] for x in done]
            yield batch

    schema = f"tree_id {kinds['tree_id']}, leaf_id {kinds['leaf_id']}, path_rank int, path_score double, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"
    return grouped.mapInPandas(write, schema)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees without branches; equal turns follow by role, then text."""
    w = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg_id", F.row_number().over(w).cast("long"))
    return rows.select("tree_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns of the op8 query, taken from the formatted strings and their loss masks."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for tree, text, spans in zip(batch["tree_id"], batch["formatted"], batch["loss_spans"], strict=True):
                turns = parse_conversation(text)
                loss = "".join(unescape_text(text[s["start"] : s["end"]]) for s in spans)
                rows.append((int(tree) if tree else None, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.astype({"conv_id": "Int64"})

    return formatted.select("tree_id", "formatted", "loss_spans").mapInPandas(parse, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_paths(reply_paths(linear_messages(rows))))


OP8_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS body FROM m)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(body)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
