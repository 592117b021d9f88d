"""Operator 5, MinHash near-duplicates.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form one class; only classes
go on, so copies are never expanded into pairs. Each class gets ``BANDS * ROWS`` minima of universal hash functions.
Bands of the signature put classes into buckets; two sets of Jaccard similarity 0.8 share none with probability
(1 - 0.8^5)^32 < 4e-6.

Pairs in a bucket are found in two steps, so that a bucket is not expanded into all its pairs. First every class is
compared with the most central member of its buckets (the one with the largest buckets altogether), which ties most of a
group of near copies together. Then only pairs of a bucket that still lie in different components are compared; large
buckets in blocks of two bounded chunks, which emit links, not pairs. Every pair is first verified on the signatures (agreement at least ``AGREE``, five standard deviations below the threshold),
then confirmed on the full sets. Components come from alternating large-star and small-star steps on stored edge tables.

Defined cases: documents without words have an empty set, no links and are their own component; a document with fewer
words than a shingle has its whole sequence as one shingle; doc_id has to fit a long; a null doc_id is in no component (null) and kept; rows that
share a doc_id are one document, whose links are those of all its texts; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WordHashes, bit_filter, bound_batches, join_counted, map_frames, maybe_in, mix, read, stored

BANDS, ROWS, AGREE_SD = 32, 5, 5.0
#: A bit filter of 16 MB at most.
MAX_FILTER_BITS = 27
#: Members of a hot bucket are dealt over this many tasks while they learn into how many chunks it is cut.
SALT = 64
#: Buckets of more members are compared in blocks, two chunks of at most so many members and bytes of sets (unless one set is larger) at a time.
SMALL_BUCKET, CHUNK_MEMBERS, CHUNK_BYTES = 32, 4096, 16_000_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; empty without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = words.of(w)
    width_here = min(width, len(h))
    n = len(h) - width_here + 1
    s = np.full(n, width_here, np.uint64)
    for j in range(width_here):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return np.unique(mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of multiply-shift hash functions (32 bits each) over a non-empty set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 256):
        h = _A[:, None] * s[None, i : i + 256]
        h += _B[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _band_keys(sigs: np.ndarray) -> np.ndarray:
    """(n, 160) minima -> (n, 32) band keys."""
    sigs = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sigs), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, j])
    return key


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def members(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every document; set_key and bands are null without words or doc_id. The signatures are made again for the few classes that share a bucket: bands are less than half as long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            rows = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(t, width, words)
                named = len(s) and not pd.isna(d)
                rows.append((d, len(s), _key(s) if named else None, _band_keys(signature(s)).tobytes() if named else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "bands"]).astype({"doc_id": "Int64", "n_shingles": "int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id bigint, n_shingles bigint, set_key binary, bands binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(rep, bucket): 32 rows for each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                key = np.frombuffer(b"".join(batch["bands"]), np.uint64)
                yield pd.DataFrame({"rep": np.repeat(batch["rep"].to_numpy(np.int64), BANDS), "bucket": key.astype(np.int64)})

    return classes.select("rep", "bands").mapInPandas(run, "rep bigint, bucket bigint")


def _least(threshold: float) -> float:
    return threshold - AGREE_SD * (threshold * (1 - threshold) / (BANDS * ROWS)) ** 0.5


def _similar(x: bytes, y: bytes, threshold: float) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= round(100 * threshold) * (len(a) + len(b) - both)


def agreeing(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose signatures and sizes let their similarity reach the threshold."""
    least = _least(threshold)
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
                yield batch.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9))
    return sized.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a bigint, b bigint")


def sets_of(docs: DataFrame, classes: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(rep, set_key, n_shingles, sig, elements) of ``classes`` (rep, set_key), one row each. A bit filter of bounded size keeps most other documents' texts from being read twice, a join on both keys the rest."""
    key = F.xxhash64(F.col(doc_id).cast("long"))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), key.alias("key"), F.col(text).alias("text"))
    rows = maybe_in(rows, "key", "maybe", *bit_filter(classes.select(F.xxhash64("rep").alias("key")), "key", max_bits=1 << MAX_FILTER_BITS)).where("maybe")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for batch in batches:
            made = [(d, s) for d, t in zip(batch["id"], batch["text"], strict=True) if len(s := shingles(t, width, words))]
            yield pd.DataFrame([(d, _key(s), len(s), signature(s).tobytes(), s.tobytes()) for d, s in made], columns=["rep", "set_key", "n_shingles", "sig", "elements"])

    made = map_frames(rows.select("id", "text"), run, "rep bigint, set_key binary, n_shingles bigint, sig binary, elements binary")
    # a class has one rep, so copies agree in both columns, by which the join has dealt them already
    return made.join(classes.select("rep", "set_key"), ["rep", "set_key"], "left_semi").dropDuplicates(["rep", "set_key"])


def sets_in(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """``sets`` without most of those whose rep is not in ``reps`` (rep)."""
    hashed = F.xxhash64("rep")
    words = bit_filter(reps.distinct().select(hashed.alias("key")), "key")
    return maybe_in(sets.withColumn("key", hashed), "key", "maybe", *words).where("maybe").drop("key", "maybe")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold; ``pairs`` is a stored table."""
    side = lambda x: sets_in(sets.select("rep", "elements"), pairs.select(F.col(x).alias("rep"))).select(F.col("rep").alias(x), F.col("elements").alias(f"e{x}"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_similar(x, y, threshold) for x, y in zip(batch["ea"], batch["eb"], strict=True)]
            yield batch.loc[ok, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb").mapInPandas(run, "a bigint, b bigint").distinct()


def block_links(members_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different roots inside large buckets; ``members_`` has (bucket, rep, root).

    A bucket is cut into chunks of bounded size and every two chunks meet in a group of their own, which emits only what
    ties roots together. Each pair is looked at in the first bucket that its signatures share.
    """
    sets = sets_in(sets, members_.select("rep"))
    rows = members_.join(sets.select("rep", "set_key", "sig", "n_shingles"), "rep")
    load = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.sum("n_shingles") * 8 / CHUNK_BYTES), F.ceil(F.count(F.lit(1)) / CHUNK_MEMBERS), F.lit(1)).alias("chunks"))
    salted = load.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep", "bucket"), F.lit(SALT)).cast("int")).join(salted, ["bucket", "salt"]).drop("salt").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.join(sets.select("set_key", "elements"), "set_key").select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "rep", "root", "sig", "elements")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["chunk", "rep"], ignore_index=True)
        sig = np.frombuffer(b"".join(block["sig"]), "<u4").reshape(len(block), -1)
        bands = _band_keys(sig)
        band = int(np.flatnonzero(bands[0] == np.uint64(int(block["bucket"][0]) & ((1 << 64) - 1)))[0])
        rep, elements = block["rep"].tolist(), block["elements"].tolist()
        size = np.array([len(e) // 8 for e in elements])
        label = block["root"].to_numpy().copy()
        same = block["i"][0] == block["j"][0]
        half = int((block["chunk"] == block["i"][0]).sum())
        out = []
        for x in range(len(block) if same else half):
            ys = np.arange(x + 1, len(block)) if same else np.arange(half, len(block))
            ys = ys[(label[ys] != label[x]) & (size[ys] >= threshold * size[x] - 1e-9) & (size[x] >= threshold * size[ys] - 1e-9)]
            if not len(ys):
                continue
            agree = (sig[ys] == sig[x]).mean(axis=1)
            ys, agree = ys[agree >= _least(threshold)], agree[agree >= _least(threshold)]
            ys = ys[np.argsort(-agree, kind="stable")]
            ys = ys[(bands[ys] == bands[x]).argmax(axis=1) == band]
            for y in ys.tolist():
                if label[y] != label[x] and _similar(elements[x], elements[y], threshold):
                    out.append((rep[x], rep[y]))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return rows.groupBy("bucket", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root): root is the smallest node that can be reached. Nodes without edges are not listed."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "min")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "min")
        met = large.join(low, "u")
        small = met.select("u", F.col("m").alias("v")).unionByName(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = stored(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    bound_batches(docs.sparkSession)
    every = stored(members(docs, width, doc_id, text), "members")
    named = every.where("set_key is not null")
    classes = stored(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    # documents of several texts tie their classes together
    twice = stored(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "twice")
    of_class = named.select("doc_id", "set_key").join(twice, "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    several = of_class.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("other")).where("b <> other").select("doc_id", "b")
    tied = stored(of_class.join(several, "doc_id").select(F.col("rep").alias("a"), "b").where("a <> b").distinct(), "tied")

    buckets = stored(band_keys(classes), "buckets")
    shared = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    hot = buckets.count() // 1000 + 1  # of fuller buckets there are fewer than a thousand: these are broadcast
    inside = stored(join_counted(buckets, shared.withColumn("n", F.col("size")), ["bucket"], hot), "inside")
    weight = stored(inside.groupBy("rep").agg(F.sum("size").alias("weight")), "weight")
    central = inside.join(weight, "rep").groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("rep"), "rep")).alias("c"), F.count(F.lit(1)).alias("n"))
    stars = join_counted(inside, stored(central.select("bucket", F.col("c.rep").alias("b"), "n"), "central"), ["bucket"], hot).where("rep <> b").groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    best = stars.groupBy("a").agg(F.max(F.struct("n", "b")).alias("s")).select("a", F.col("s.b").alias("b"))
    met = stored(classes.select("rep", "set_key").join(weight, "rep", "left_semi"), "met")
    sets = stored(sets_of(docs, met, width, doc_id, text), "sets")
    first = stored(agreeing(best, sets, threshold), "pairs")
    edges = stored(confirmed(first, sets, threshold).unionByName(tied), "links")
    found = components(edges)

    where = inside.select("bucket", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    where = stored(where, "where")
    mixed = where.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("size")).where("r1 <> r2").select("bucket", "size")
    open_ = stored(join_counted(where, stored(mixed.withColumn("n", F.col("size")), "mixed"), ["bucket"], hot), "open")
    large, open_ = open_.where(F.col("size") > SMALL_BUCKET).drop("size"), open_.where(F.col("size") <= SMALL_BUCKET)
    x = open_.select("bucket", F.col("rep").alias("a"), F.col("root").alias("ra"))
    y = open_.select("bucket", F.col("rep").alias("b"), F.col("root").alias("rb"))
    rest = x.join(y, "bucket").where("ra < rb").select("a", "b").distinct()
    second = stored(agreeing(rest, sets, threshold), "pairs")
    more = stored(confirmed(second, sets, threshold).unionByName(block_links(large, sets, threshold)), "links")
    if more.take(1):
        found = components(edges.unionByName(more))
    label = classes.select("set_key", F.col("rep").alias("node")).join(found, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_key").join(stored(label, "labels"), "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def remove_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each component."""
    gone = near_duplicates(docs.select("doc_id", "text"), width, threshold).where("not kept").select("doc_id").distinct()
    return docs.join(stored(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by two-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
