"""Operator 13, SimHash near-duplicates found by pivot distance tables.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of a document's word shingles,
repeats included. Equal fingerprints form one class, so copies are never paired. Distances of every class to ``PIVOTS``
fixed reference fingerprints are its coordinates: by the triangle inequality, two fingerprints that differ in at most
``bits`` bits differ by at most ``bits`` in every coordinate.

Coordinates do two things. First they deal classes over cells: a cell of more than ``CELL`` members is cut at its median
distance from a pivot, and members within ``bits`` of the cut go to both sides, so that a pair within reach always shares
a cell. A round cuts every crowded cell along as many pivots as its size asks for, each only if both sides lose a quarter
of the members; a cell along whose pivots the distances hardly spread (a tight ball of near copies) is left whole. Then, inside a cell, pairs are discarded by their
largest difference of coordinates, pivot by pivot, and the survivors verified on the fingerprints. A cell that stays
crowded is compared in blocks of two chunks of at most ``CELL`` members, each a group of its own. Groups emit links that
tie components together, not all pairs. Components come from alternating large-star and small-star steps.

Members of a cell fall to about 0.6 of them by a cut and grow to 1.2 in all, so n classes are copied about
(n / CELL) ** 0.36 times: 2.6 at 240,000 and 50 at a billion, 16 bytes each.

Defined cases: null text and text without words give fingerprint zero, linked like any other; fewer words than a shingle
give one shingle; doc_id has to fit a long; rows that share a doc_id are judged each by its own text; a row without
doc_id gets the smallest doc_id of its component, null if it has none; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_frames, read, stored
from plumbline.llm.minhash import components

PIVOTS, CELL, SEED = 48, 16384, 42
#: Pivots that may cut in one round, each used once, and the share of a cell that a cut leaves on a side.
CUTS, LEFT = 8, 0.6
#: Members that are compared with a whole chunk at a time.
BLOCK = 128

_REFERENCES = np.random.default_rng(20251).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), 4096):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i : i + 4096], ends[i : i + 4096], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, width) for t in batch["text"]), np.uint64, len(batch)).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return map_frames(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id bigint, fp bigint")


def distance_to(pivot: int) -> Column:
    """The coordinate of a fingerprint."""
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(_REFERENCES[pivot % PIVOTS].view(np.int64)))))


def _onwards(sides: Column) -> Callable[[Column], Column]:
    """Paths down a tree of cuts, each led on to the given sides of the next."""
    return lambda path: F.transform(sides, lambda side: 2 * path + side)


def cells(classes: DataFrame, bits: int, limit: int = CELL) -> DataFrame:
    """(cell, fp): every class in at least one cell, two within ``bits`` of each other in a common one."""
    rows, done, first = stored(classes.select(F.lit(0).cast("long").alias("cell"), "fp"), "cells"), None, 0
    while True:
        at = [distance_to(first + k) for k in range(CUTS)]
        quartiles = [F.percentile(d, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{k}") for k, d in enumerate(at)]  # of at most 65 values
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *quartiles).where(F.col("n") > limit)
        # left of a cut: up to it; right of it: from just so far below that a pair within reach stays together
        wanted = F.ceil(F.log(F.col("n") / limit) / -math.log(LEFT))
        middle = [F.floor(F.col(f"q{k}")[1]).cast("int") for k in range(CUTS)]
        cuts = [F.when((wanted > k) & (F.col(f"q{k}")[0] <= m - bits) & (F.col(f"q{k}")[2] > m), m).alias(f"c{k}") for k, m in enumerate(middle)]
        crowded = stored(sizes.select("cell", *cuts).where(F.coalesce(*[f"c{k}" for k in range(CUTS)]).isNotNull()), "crowded")
        if first + CUTS > PIVOTS or not crowded.take(1):
            return rows if done is None else done.unionByName(rows)
        whole = rows.join(crowded.select("cell"), "cell", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        paths = F.array(F.lit(0))
        for k, d in enumerate(at):
            c = F.col(f"c{k}")
            sides = F.when(c.isNull() | (d <= c - bits), F.array(F.lit(0))).when(d <= c, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
            paths = F.flatten(F.transform(paths, _onwards(sides)))
        split = rows.join(crowded, "cell").select("cell", "fp", F.explode(paths).alias("path"))
        rows, first = stored(split.select(F.xxhash64("cell", F.lit(first), "path").alias("cell"), "fp"), "cells"), first + CUTS


def links(members: DataFrame, bits: int, limit: int = CELL) -> DataFrame:
    """Links (a, b) between fingerprints of a cell that differ in at most ``bits`` bits; they tie together what such pairs tie together."""
    members = stored(members, "members")
    chunks = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / limit).alias("chunks"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", "chunks")
    rows = members.join(chunks, "cell").withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # a chunk that meets others is compared with itself once, in its own group
    rows = rows.select("cell", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64).view(np.uint64)
        table = np.bitwise_count(fp[:, None] ^ _REFERENCES[None, :]).astype(np.int8)
        order = np.argsort(table[:, 0], kind="stable")
        fp, table, chunk = fp[order], table[order], group["chunk"].to_numpy()[order]
        across = group["i"].iat[0] != group["j"].iat[0]
        label, out = np.arange(len(fp)), []
        for lo in range(0, len(fp), BLOCK):
            hi = min(lo + BLOCK, len(fp))
            end = int(np.searchsorted(table[:, 0], table[hi - 1, 0] + bits, "right"))
            x, y = np.nonzero(np.arange(lo, end)[None, :] > np.arange(lo, hi)[:, None])
            x, y = x + lo, y + lo
            near = label[x] != label[y]
            if across:
                near &= chunk[x] != chunk[y]
            x, y = x[near], y[near]
            for k in range(PIVOTS):
                near = np.abs(table[x, k] - table[y, k]) <= bits
                x, y = x[near], y[near]
                if len(x) < 1000:
                    near = (np.abs(table[x] - table[y]) <= bits).all(axis=1)
                    x, y = x[near], y[near]
                    break
            near = np.bitwise_count(fp[x] ^ fp[y]) <= bits
            for a, b in zip(x[near].tolist(), y[near].tolist(), strict=True):
                if label[a] != label[b]:
                    out.append((fp[a], fp[b]))
                    label[label == label[b]] = label[a]
        return pd.DataFrame(np.array(out, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return rows.groupBy("cell", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 2, doc_id: str = "doc_id", text: str = "text", limit: int = CELL) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id."""
    every = stored(fingerprints(docs, width, doc_id, text), "fingerprints")
    classes = stored(every.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(cells(classes, bits, limit), bits, limit))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    label = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "labels")
    return every.join(label, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents by three-word shingles, two differing bits."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
