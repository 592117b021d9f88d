"""Operator 6, benchmark decontamination by spaced seeds.

Tokens (lower-cased runs without ASCII punctuation) of benchmark items and training texts are hashed under fixed masks
that look at five or six of up to 13 token positions and ignore the others, so that a substituted word spoils only the
seeds that look at it; whatever tokens of an overlap are substituted, one mask at least fits between them. Training positions whose seed passes a small bit filter of the benchmark's seeds (at most
``MAX_FILTER_BITS``, so its broadcast is bounded whatever the benchmark's size; a crowded filter only lets more
positions on) are joined with the benchmark's seeds on the exact hash. Each (passage, item, diagonal) that meets is then
verified: an overlap is a stretch of ``WINDOW`` aligned tokens of which at least min(MATCHES, 80 % of the item's tokens)
are equal. Items of fewer than MIN_ITEM tokens have no room for that: they are searched by one hash of their whole token
sequence (an all-looking mask of each short length that the benchmark has), so verbatim copies of them are found anywhere
in a text. A benchmark item of one or two words thus claims every document that says it; a caller who does not want that
leaves such items out.

A seed that many items share (a benchmark's standing phrase) meets each passage once for every such item. Where that is
over ``PAIRS`` pairs, the items of the seed are dealt over as many salts as keep each at that many, and its hits go to
all of them, so that no task makes all its pairs.

Defined cases: null and empty texts have no tokens and no overlaps; ids have to fit a long; a null item_id or doc_id is carried as null; repeated documents and repeated items
each give their pairs; empty tables give an empty table; extra columns are kept by ``remove_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, map_frames, mix, read, stored

#: Fixed masks; 1 looks at a token, 0 ignores it.
MASKS = ("111111", "110101011", "111001101", "1011010011", "11000001011", "1100100000011", "1100111", "10101011", "111011")
SPAN = max(map(len, MASKS))
WINDOW, MATCHES, MIN_ITEM = 17, 12, 8
BITS_PER_SEED, FILTER_HASHES, MAX_FILTER_BITS = 64, 3, 1 << 27
#: Pairs of a hit and an item that one key of the join may make.
PAIRS = 1_000_000
#: Hits closer than this belong to one passage row.
JOIN_HITS = 32
_GROUP = 200_000

_SPLIT = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def seeds(h: np.ndarray, short: Sequence[int] = ()) -> Iterator[tuple[int, np.ndarray]]:
    """(length of the mask, seed at each position where it fits) of a sequence of token hashes, by the fixed masks and those of ``short`` lengths that look at all tokens."""
    for k, mask in [*enumerate(MASKS, 1), *((100 + n, "1" * n) for n in short)]:
        n = len(h) - len(mask) + 1
        if n > 0:
            s = np.full(n, k, np.uint64)
            for j, look in enumerate(mask):
                if look == "1":
                    s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
            yield len(mask), mix(s)


def _bits(s: np.ndarray, log2: int) -> list[np.ndarray]:
    """The filter positions of seeds."""
    return [(s >> np.uint64(i * 10)) & np.uint64((1 << log2) - 1) for i in range(FILTER_HASHES)]


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, list[int]]:
    """(item, item_id, toks: token hashes as binary uint32), (seed, item, at), and the lengths below MIN_ITEM that occur. ``item`` numbers the rows."""
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")), "items")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            for item, iid, t in zip(batch["item"], batch["item_id"], batch["text"], strict=True):
                h = words.of(tokens(t))
                if len(h):
                    each = list(seeds(h)) if len(h) >= MIN_ITEM else list(seeds(h, [len(h)]))[-1:]
                    yield pd.DataFrame({"item": [item], "item_id": pd.array([iid], "Int64"), "n": [len(h)], "toks": [(h >> np.uint64(32)).astype("<u4").tobytes()], "seeds": [np.concatenate([s for _, s in each]).astype(np.int64)], "ats": [np.concatenate([np.arange(len(s)) for _, s in each]).astype(np.int32)]})

    made = stored(map_frames(numbered.withColumn("item_id", F.col("item_id").cast("long")), run, "item bigint, item_id bigint, n int, toks binary, seeds array<bigint>, ats array<int>"), "items")
    pairs = made.select("item", F.explode(F.arrays_zip("seeds", "ats")).alias("s"))
    short = [r["n"] for r in made.where(F.col("n") < MIN_ITEM).select("n").distinct().collect()]  # fewer than MIN_ITEM
    return made.select("item", "item_id", "toks"), stored(pairs.select(F.col("s.seeds").alias("seed"), "item", F.col("s.ats").alias("at")), "seeds"), sorted(short)


def seed_filter(seed_rows: DataFrame) -> tuple[np.ndarray, int]:
    """A bit array of 2^log2 bits, at most MAX_FILTER_BITS, made in Spark as 64-bit words."""
    n = seed_rows.count()
    log2 = min(max(16, math.ceil(math.log2(max(n, 1) * BITS_PER_SEED))), int(math.log2(MAX_FILTER_BITS)))
    places = [F.shiftrightunsigned("seed", i * 10).bitwiseAND(F.lit((1 << log2) - 1)) for i in range(FILTER_HASHES)]
    at = seed_rows.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(1 << (log2 - 6), np.uint64)
    rows = words.toArrow().to_pandas()  # at most 2^21 words
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out, log2


def passages(docs: DataFrame, bits: np.ndarray, log2: int, short: Sequence[int] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stretches of documents around positions that pass the filter: (doc_id, first, toks, seeds, ats); first is the token number of toks[0], ats count from it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, have = WordHashes(), shared.value

        def search(ids: list, lists: list[np.ndarray]) -> list[tuple]:
            h = np.concatenate(lists)
            ends = np.cumsum([len(x) for x in lists])
            at, found = [], []
            for length, s in seeds(h, short):
                ok = np.ones(len(s), bool)
                for b in _bits(s, log2):
                    ok &= (have[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) != 0
                p = np.flatnonzero(ok)
                inside = ends[np.searchsorted(ends, p, "right")] >= p + length if len(p) else p
                p = p[inside] if len(p) else p
                at.append(p)
                found.append(s[p])
            if not sum(map(len, at)):
                return []
            p, s = np.concatenate(at), np.concatenate(found)
            order = np.argsort(p, kind="stable")
            p, s = p[order], s[order]
            doc = np.searchsorted(ends, p, "right")
            cuts = np.flatnonzero((np.diff(p) > JOIN_HITS) | (np.diff(doc) != 0)) + 1
            out = []
            for ps, ss in zip(np.split(p, cuts), np.split(s, cuts), strict=True):
                d = int(np.searchsorted(ends, ps[0], "right"))
                begin, end = int(ends[d]) - len(lists[d]), int(ends[d])
                a, b = max(begin, int(ps[0]) - WINDOW), min(end, int(ps[-1]) + SPAN + WINDOW)
                out.append((ids[d], a - begin, (h[a:b] >> np.uint64(32)).astype("<u4").tobytes(), ss.astype(np.int64), (ps - a).astype(np.int32)))
            return out

        for batch in batches:
            rows, ids, lists, size = [], [], [], 0
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                h = words.of(tokens(t))
                if len(h):
                    ids.append(d)
                    lists.append(h)
                    size += len(h)
                if size >= _GROUP:
                    rows += search(ids, lists)
                    ids, lists, size = [], [], 0
            if lists:
                rows += search(ids, lists)
            out = pd.DataFrame(rows, columns=["doc_id", "first", "toks", "seeds", "ats"])
            yield out.astype({"doc_id": "Int64", "first": "int64"})

    rows_in = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows_in, run, "doc_id bigint, first bigint, toks binary, seeds array<bigint>, ats array<int>")


def verify(found: DataFrame) -> DataFrame:
    """(doc_id, first, toks, item, item_id, item_toks, shift) -> the best window of each, if it is an overlap. Item token i stands against toks[i + shift]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                a, b = np.frombuffer(r.toks, "<u4"), np.frombuffer(r.item_toks, "<u4")
                lo, hi = max(0, -r.shift), min(len(b), len(a) - r.shift)
                if hi <= lo:
                    continue
                same = np.concatenate(([0], np.cumsum(a[lo + r.shift : hi + r.shift] == b[lo:hi])))
                width = min(WINDOW, hi - lo)
                hit = same[width:] - same[:-width]
                i = int(np.argmax(hit))
                if hit[i] >= (min(MATCHES, math.ceil(0.8 * len(b))) if len(b) >= MIN_ITEM else len(b)):
                    rows.append((r.doc_id, r.item_id, r.item, int(hit[i]), int(r.first + lo + r.shift + i), int(lo + i)))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item", "matched", "doc_token", "item_token"]).astype({"doc_id": "Int64", "item_id": "Int64", "item": "int64", "matched": "int64", "doc_token": "int64", "item_token": "int64"})

    return map_frames(found, run, "doc_id bigint, item_id bigint, item bigint, matched bigint, doc_token bigint, item_token bigint")


def join_seeds(hits: DataFrame, seed_rows: DataFrame) -> DataFrame:
    """Hits joined to the items of their seeds; seeds that make too many pairs are salted."""
    items_of = seed_rows.groupBy("seed").agg(F.count(F.lit(1)).alias("items")).where("items > 1")
    hits_of = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("hits"))
    salts = hits_of.join(items_of, "seed").where(F.col("hits") * F.col("items") > PAIRS)
    salts = stored(salts.select("seed", F.least("items", F.ceil(F.col("hits") * F.col("items") / PAIRS)).cast("int").alias("salts")), "salts")
    if not salts.take(1):
        return hits.join(seed_rows, "seed")
    dealt = lambda rows: rows.join(salts, "seed", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = dealt(hits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = dealt(seed_rows).withColumn("salt", F.pmod(F.xxhash64("item", "at"), F.col("salts")).cast("int")).drop("salts")
    return left.join(right, ["seed", "salt"])


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Contaminated pairs (doc_id, item_id, matched, doc_token, item_token): the best window of each pair, the first on ties."""
    items, seed_rows, short = benchmark_items(benchmark, item_id, item_text)
    bits, log2 = seed_filter(seed_rows)
    got = passages(docs, bits, log2, short, doc_id, text).withColumn("passage", F.monotonically_increasing_id())
    got = stored(got, "passages")
    hits = got.select("passage", F.explode(F.arrays_zip("seeds", "ats")).alias("s")).select("passage", F.col("s.seeds").alias("seed"), F.col("s.ats").alias("here"))
    met = join_seeds(hits, seed_rows).select("passage", "item", (F.col("here") - F.col("at")).alias("shift")).distinct()
    met = met.join(got.select("passage", "doc_id", "first", "toks"), "passage").join(items.withColumnRenamed("toks", "item_toks"), "item")
    best = verify(met.select("doc_id", "first", "toks", "item", "item_id", "item_toks", "shift"))
    top = F.max(F.struct("matched", (-F.col("doc_token")).alias("d"), (-F.col("item_token")).alias("i"))).alias("b")
    best = best.groupBy("doc_id", "item", "item_id").agg(top)
    return best.select("doc_id", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.d")).alias("doc_token"), (-F.col("b.i")).alias("item_token"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that overlap a benchmark item; rows without a doc_id cannot be named and stay."""
    bad = stored(overlaps(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that overlap."""
    return overlaps(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
