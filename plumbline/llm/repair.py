"""Operator 12, repair of conversation structure by bidirectional Dijkstra over the edit lattice.

Rows of a conversation, in order of turn (nulls first, ties by role, then text), are kept (cost 0), given the role that is
due (Rerole, 3) or deleted (4), and turns with empty text inserted (3), so that the roles read system at most once and
first, then user and assistant in turn, ending with assistant, or nothing at all. Blank and repeated rows have to go;
a truncated row that stays costs 3 more. A node of the lattice is (rows taken, last role); a forward heap grows from the
start, a reverse heap from the ends. Each settles a node with its cost and the least audit (initials of edits) that
reaches it or leads on from it. The search goes on while a path through both heaps' tops could cost no more than the best
one met, so that every cheapest path has a crossing that is settled on both sides; the least concatenated audit wins. An
audit fixes the repair, as only one role is due after each role.

A long conversation is no group in one task. Rows are range-sorted by conversation and turn, cut into segments of at most
``SEGMENT`` rows and solved for each first and last role that may hold at their ends; per conversation the segments'
costs and audits, not its texts, are chained. What stays sequential is the answer itself: one audit and one digest of the
repaired text per conversation. The digest is taken of a stream of segments, so memory is bounded by a batch.

Defined cases: a null role or text reads as one space, as does a null conv_id or turn in the hash of ``damaged``; rows of
null conv_id are one conversation; a role is legal by its first code point, an empty one never; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_frames, read, stored

SEGMENT, SEGMENT_CHARS = 512, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The role that is due after nothing (0), s, u and a.
DUE = {"0": "u", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
ENDS = "0a"
INFINITE = float("inf")

Row = tuple[str, bool, bool]  # initial of the role, has to go, truncated
Node = tuple[int, str]


def _taken(row: Row, state: str) -> Iterator[tuple[str, int, str]]:
    """Edits that take a row after ``state``: (initial of the edit, cost, next state)."""
    role, gone, truncated = row
    yield "D", DELETE, state
    if not gone:
        more = TRUNCATED if truncated else 0
        if role == DUE[state] or role == "s" and state == "0":
            yield "K", KEEP + more, role
        if role != DUE[state]:
            yield "R", REROLE + more, DUE[state]


def cheapest(rows: list[Row], start: str = "0", ends: str = ENDS) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits that lead from state ``start`` to one of ``ends``; None if none do."""
    n = len(rows)

    def on(node: Node) -> Iterator[tuple[str, int, Node]]:
        i, state = node
        yield "I", INSERT, (i, DUE[state])
        if i < n:
            for edit, cost, to in _taken(rows[i], state):
                yield edit, cost, (i + 1, to)

    def back(node: Node) -> Iterator[tuple[str, int, Node]]:
        i, state = node
        for before in DUE:
            if DUE[before] == state:
                yield "I", INSERT, (i, before)
            if i > 0:
                for edit, cost, to in _taken(rows[i - 1], before):
                    if to == state:
                        yield edit, cost, (i - 1, before)

    # entries (cost, order, audit, node): of one cost, nodes that others of that cost can still reach come later
    forward, reverse = [(0, 0, "", (0, start))], [(0, -n, "", (n, e)) for e in ends]
    heapq.heapify(reverse)
    begun: dict[Node, tuple[int, str]] = {}
    ended: dict[Node, tuple[int, str]] = {}
    best = INFINITE
    while forward or reverse:
        tops = [h[0][0] if h else INFINITE for h in (forward, reverse)]
        if sum(tops) > best:
            break
        ahead = tops[0] <= tops[1]
        heap, mine, other = (forward, begun, ended) if ahead else (reverse, ended, begun)
        cost, _, audit, node = heapq.heappop(heap)
        if node in mine:
            continue
        mine[node] = (cost, audit)
        if node in other:
            best = min(best, cost + other[node][0])
        for edit, more, to in on(node) if ahead else back(node):
            if to in other:
                best = min(best, cost + more + other[to][0])
            if to not in mine:
                heapq.heappush(heap, (cost + more, to[0] if ahead else -to[0], audit + edit if ahead else edit + audit, to))
    found = [audit + ended[v][1] for v, (cost, audit) in begun.items() if v in ended and cost + ended[v][0] == best]
    found += [audit + edit + ended[to][1] for v, (cost, audit) in begun.items() for edit, more, to in on(v) if to in ended and cost + more + ended[to][0] == best]
    return (int(best), min(found)) if found else None


def applied(audit: str, rows: list[tuple[str, str]], state: str) -> tuple[list[tuple[str, str]], str]:
    """The repaired rows, and the state they end in."""
    out, i = [], 0
    for edit in audit:
        if edit == "I":
            state = DUE[state]
            out.append((ROLES[state], ""))
            continue
        role, text = rows[i]
        i += 1
        if edit != "D":
            state = role[:1] if edit == "K" else DUE[state]
            out.append((role if edit == "K" else ROLES[state], text))
    return out, state


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fifth of the rows' kinds of damage, by the crc32 of ``conv_id:turn``."""
    one = F.lit(" ")
    text, role = F.coalesce("text", one), F.coalesce("role", one)
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one), F.coalesce(F.col("turn").cast("string"), one)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), h.alias("h"))
    return rows.where("h <> 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, later): equal rows of a turn as one of n; later, if their role and text were seen at an earlier turn. conv is conv_id as text, empty for null."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = rows.groupBy(conv.alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    rows = stored(rows.withColumn("said", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)), "rows")
    first = rows.groupBy("conv", "said").agg(F.min(F.struct(F.col("turn").alias("first"))).alias("f")).select("conv", "said", "f.first")
    return rows.join(first, ["conv", "said"]).withColumn("later", ~F.col("turn").eqNullSafe(F.col("first"))).select("conv", "turn", "role", "text", "n", "later")


_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
_PATHS = "array<struct<start: string, end: string, cost: bigint, audit: string>>"
_SEGMENTS = f"part int, seq bigint, conv string, rows bigint, roles array<string>, texts array<string>, first_role string, last_role string, first_turn bigint, last_turn bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, paths {_PATHS}"


def _legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


def segments(rows: DataFrame, size: int = SEGMENT, chars: int = SEGMENT_CHARS) -> DataFrame:
    """Rows of ``faults`` in order, as segments of at most ``size`` rows, with the cheapest edits between the roles that may hold at their ends."""
    ordered = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text").withColumn("part", F.spark_partition_id())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, inner = 0, 0, False  # inner: the segment begins its conversation for certain
        now, conv, weight = [], None, 0

        def made(last: bool) -> dict:
            """The segment ``now``; last: it ends its conversation for certain."""
            lattice, kinds = [], {"blank": 0, "duplicate": 0, "truncated": 0}
            for _, role, text, later in now:
                end = _LAST.search(text)
                kind = "blank" if end is None else "duplicate" if later else "truncated" if end[0] not in ".!?" else None
                if kind:
                    kinds[kind] += 1
                lattice.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
            paths = []
            for start in "0" if inner else DUE:
                for ends in [ENDS] if last else DUE:
                    if found := cheapest(lattice, start, ends):
                        paths.append({"start": start, "end": ends[:1] if not last else "", "cost": found[0], "audit": found[1]})
            turns = [t for t, *_ in now if t is not None]
            roles = [r for _, r, *_ in now]
            illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:], strict=False))
            return {"part": part, "seq": seq, "conv": conv, "rows": len(now), "roles": roles, "texts": [t for _, _, t, _ in now], "first_role": roles[0], "last_role": roles[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "illegal": illegal, "paths": paths} | kinds

        for batch in batches:
            out = []
            for conv_, turn, role, text, n, later, part in zip(batch["conv"], batch["turn"], batch["role"], batch["text"], batch["n"], batch["later"], batch["part"], strict=True):  # noqa: B007
                turn = None if pd.isna(turn) else int(turn)
                for copy in range(n):
                    if now and (conv_ != conv or len(now) >= size or weight > chars):
                        out.append(made(conv_ != conv))
                        now, seq, weight, inner = [], seq + 1, 0, conv_ != conv
                    conv = conv_
                    now.append((turn, role, text, bool(later) or copy > 0))
                    weight += len(text)
                    if len(out) >= 64:
                        yield _segment_frame(out)
                        out = []
            if out:
                yield _segment_frame(out)
        if now:
            yield _segment_frame([made(False)])

    return map_frames(ordered.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "n", "later", "part"), each, _SEGMENTS)


def _segment_frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"first_turn": "Int64", "last_turn": "Int64"})


_CHAIN = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, part int, seq bigint, start string, edits string"


def chained(parts: DataFrame) -> DataFrame:
    """A row for each segment with the edits chosen for it (edits, from state start); the conversation's figures on its first."""
    small = parts.drop("roles", "texts", "rows").repartition("conv").sortWithinPartitions("conv", "part", "seq")

    def whole(pieces: list[tuple[int, int]], figures: dict, states: dict[str, tuple[int, str, tuple | None]]) -> list[dict]:
        cost, audit, chain = min((states[e] for e in ("", *ENDS) if e in states), key=lambda x: x[:2])
        steps = []
        while chain:
            chain, step = chain
            steps.append(step)
        steps.reverse()
        rows = [{"part": p, "seq": s, "start": start, "edits": edits, "conv": figures["conv"]} for (p, s), (start, edits) in zip(pieces, steps, strict=True)]
        low, high, turns = figures["low"], figures["high"], figures["turns"]
        rows[0] |= {"gaps": 0 if low is None else high - low + 1 - turns, "cost": cost, "audit": audit} | {k: figures[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        return rows

    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    frame = lambda rows: pd.DataFrame(rows, columns=["conv", *counts, "audit", "part", "seq", "start", "edits"]).astype(dict.fromkeys(counts, "Int64"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, pieces, figures, states = None, [], {}, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.conv != conv:
                    if pieces:
                        out += whole(pieces, figures, states)
                    conv, pieces, states = row.conv, [], {"0": (0, "", None)}
                    figures = {"conv": conv, "low": None, "high": None, "turns": 0, "role": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                pieces.append((row.part, row.seq))
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    figures[k] += getattr(row, k)
                if figures["role"] is not None:
                    figures["illegal"] += not _legal(figures["role"], row.first_role)
                figures["role"] = row.last_role
                if not pd.isna(row.first_turn):
                    figures["turns"] += row.turns - (figures["high"] == row.first_turn)
                    figures["low"] = int(row.first_turn) if figures["low"] is None else figures["low"]
                    figures["high"] = int(row.last_turn)
                on: dict[str, tuple[int, str, tuple | None]] = {}
                for path in row.paths:
                    if path["start"] in states:
                        cost, audit, steps = states[path["start"]]
                        new = (cost + path["cost"], audit + path["audit"], (steps, (path["start"], path["audit"])))
                        if path["end"] not in on or new[:2] < on[path["end"]][:2]:
                            on[path["end"]] = new
                states = on
            if out:
                yield frame(out)
        if pieces:
            yield frame(whole(pieces, figures, states))

    return map_frames(small, each, _CHAIN)


def digests(parts: DataFrame, chain: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired rows as ``role:text`` lines."""
    rows = parts.select("part", "seq", "conv", "roles", "texts").join(chain.select("part", "seq", "start", "edits"), ["part", "seq"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[f"{r}:{t}" for r, t in applied(edits, list(zip(roles, texts, strict=True)), start)[0]] for roles, texts, start, edits in zip(batch["roles"], batch["texts"], batch["start"], batch["edits"], strict=True)]
            yield batch[["conv", "part", "seq"]].assign(n=[len(x) for x in lines], piece=["\n".join(x) for x in lines])

    made = map_frames(rows, write, "conv string, part int, seq bigint, n bigint, piece string")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state, begun = None, None, False
        for batch in batches:
            done = []
            for conv_, n, piece in zip(batch["conv"], batch["n"], batch["piece"], strict=True):
                if conv_ != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state, begun = conv_, sha256(), False
                if n:
                    state.update(("\n" if begun else "").encode() + piece.encode("utf-8", "surrogatepass"))
                    begun = True
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        if state is not None:
            yield pd.DataFrame([(conv, state.hexdigest())], columns=["conv", "repaired_sha256"])

    return map_frames(made.repartition("conv").sortWithinPartitions("conv", "part", "seq"), digest, "conv string, repaired_sha256 string")


def repaired(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Per conversation (conv: conv_id as text, empty for null): gaps, counts of faults, cost, audit, repaired_sha256."""
    parts = stored(segments(faults(rows), size), "segments")
    chain = stored(chained(parts), "chain")
    return chain.where("audit is not null").drop("part", "seq", "start", "edits").join(digests(parts, chain), "conv")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    every = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"))
    out = every.join(repaired(damaged(rows)), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
