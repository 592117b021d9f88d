"""Operator 3, quality rules and n-gram perplexity.

Perplexity comes from a modified Kneser-Ney model of order 4 over characters, case and all, counted and estimated by
Spark on the reference documents: those that pass the base rules and look like prose (``REFERENCE``: few symbols, most
words with a letter, few capitals), of all sources and languages, copies included. A character has 16 bits (those beyond
the first plane share the private use area), so a packed n-gram is its own collision-free 64-bit hash. The model is a
table of sorted hashes with log2 probabilities and of contexts with backoff weights; it grows with the input. It is
broadcast as sorted arrays while it has at most ``MAX_ENTRIES`` of them (64 MB); a larger one is joined: blocks of
documents ask once for each of their distinct n-grams. Both ways give the same perplexities.

Bands are language-specific: for each language of at least ``MIN_DOCUMENTS`` documents (the others share one band) the
quartiles of log2 perplexity are read from a histogram over all its documents that pass the base rules; a document is
rejected outside [median - LOWER * spread, median + UPPER * spread], spread being the larger of the interquartile range
and MIN_SPREAD.

Base rules: n_words < 20, or over 30 % of the words in repeated 8-word windows, fail.

Defined cases: null and empty texts have no words and fail; null languages form one group; repeated rows count and are
judged each; an empty table gives an empty table; without reference documents all symbols are alike and the band rejects
nothing; extra columns are kept (metric names are overwritten).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from plumbline.llm.common import add_columns, bound_batches, fresh, map_frames, mix, read, stored

ORDER, BITS = 4, 16
MAX_ENTRIES = 1 << 22
MIN_DOCUMENTS, UPPER, LOWER, MIN_SPREAD = 100, 6.0, 5.0, 0.3
#: Bins of log2 perplexity.
BIN = 0.005
#: Reference documents: symbols per word at most, share of words with a letter at least, capitals per letter (A-Z) at most.
REFERENCE = (0.1, 0.8, 0.3)
#: Characters that are looked at together, and distinct n-grams that a task remembers before it hands them on.
_GROUP, _REMEMBERED = 1 << 20, 1 << 21
#: Characters of a block, when the model is joined.
_BLOCK = 1 << 22


def symbols(texts: list[str]) -> np.ndarray:
    """16-bit symbols of all texts: code points, 0 is the edge of a text."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp > 0xFFFF, 0xE000 + cp % 6400, cp).astype(np.uint64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed 4-grams of all texts, each with its three leading edges and final edge; and where each text starts."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 4)[:-1]))
    padded = np.zeros(int(sizes.sum()) + 4 * len(texts), np.uint64)
    padded[np.arange(int(sizes.sum())) + np.repeat(3 + 4 * np.arange(len(texts)), sizes)] = symbols(texts)
    g = padded[3:].copy()
    for k in (1, 2, 3):
        g |= padded[3 - k : -k] << np.uint64(BITS * k)
    # a text of n symbols has n + 1 grams; the three after them reach into the next text
    keep = np.ones(len(g), bool)
    for k in (1, 2, 3):
        keep[starts[1:] - k] = False
    return g[keep], np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))


def _groups(texts: list[str], most: int = _GROUP) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of about ``most`` characters, with the place of the first."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        group.append(t or "")
        size += len(group[-1])
        if size >= most:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` words (a power of two) that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = dict.fromkeys(words)
    if len(ids) == len(words):
        return 0
    ids = dict(zip(ids, range(len(ids)), strict=True))
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    # a polynomial over the words, of doubled length with each step
    key, size, power = mix(w + np.uint64(1)), 1, 0x9E3779B97F4A7C15
    while size < width:
        key = key[:-size] * np.uint64(power) + key[size:]
        size, power = 2 * size, power * power % (1 << 64)
    in_order = np.sort(key)
    if not (in_order[1:] == in_order[:-1]).any():
        return 0
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    if not all(np.array_equal(w[a + j], w[b + j]) for j in range(width)):  # hashes collided: compare the windows themselves
        windows = Counter(tuple(words[i : i + width]) for i in range(n))
        hit = np.fromiter((windows[tuple(words[i : i + width])] > 1 for i in range(n)), bool, n)
    else:
        hit = np.zeros(n, bool)
        hit[a] = hit[b] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def text_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    white = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = raw.split(b"\n")
    dup = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        dup = sum(v - 1 for k, v in Counter(lines).items() if v > 1 and k.strip(b" \t\n\r\x0b\x0c"))
    return len(words), len(text) - white, symbols, dup, repeated_words(words)

_WHITE = b" \t\n\r\x0b\x0c"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()
_OTHER = bytes(set(range(128)) - set(_LETTERS + _WHITE))
_NO_LETTER, _NO_UPPER = (bytes(set(range(256)) - set(x)) for x in (_LETTERS, _UPPER))


def is_reference(text: str, metrics: tuple[int, int, int, int, int]) -> bool:
    """Whether a text may teach the model: the base rules, and the shares of ``REFERENCE``."""
    n_words, _, n_symbols, _, n_repeat = metrics
    if n_words < 20 or 100 * n_repeat > 30 * n_words or n_symbols > REFERENCE[0] * n_words:
        return False
    raw = text.encode("utf-8", "surrogatepass")
    capitals, letters = len(raw.translate(None, _NO_UPPER)), len(raw.translate(None, _NO_LETTER))
    return len(raw.translate(None, _OTHER).split()) >= REFERENCE[1] * n_words and capitals <= REFERENCE[2] * letters


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram long, n long) over all reference documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        made = lambda: pd.DataFrame({"gram": keys.view(np.int64), "n": n})
        for batch in batches:
            for _, group in _groups([t for t in batch["text"] if t and is_reference(t, text_rules(t))]):
                k, c = np.unique(grams(group)[0], return_counts=True)
                keys, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
                n = np.bincount(where, np.concatenate((n, c)), len(keys)).astype(np.int64)
                if len(keys) > _REMEMBERED:
                    yield made()
                    keys, n = keys[:0], n[:0]
        yield made()

    rows = map_frames(docs.select(F.col(text).alias("text")), count, "gram bigint, n bigint")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and over, from the counts of counts 1 to 4; 0.5, 1, 1.5 where these are empty."""
    if min(n) == 0:
        return [0.0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k) for k in (1, 2, 3)]


def _last(gram: Column, k: int) -> Column:
    return gram if k == ORDER else gram.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """The model: (level, key, value). Level 2k: log2 of the probability of n-grams of k symbols; 2k + 1: of the backoff weight of contexts of k symbols."""
    by_order = {ORDER: stored(counts.select(F.col("gram"), F.col("n").alias("c")), "counts")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different left neighbours
        by_order[k] = stored(by_order[k + 1].groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "counts")
    out, below = None, None
    for k in range(1, ORDER + 1):
        row = by_order[k].agg(*[F.count_if(F.col("c") == j) for j in (1, 2, 3, 4)]).first()
        d = F.element_at(F.array(*map(F.lit, discounts(list(row)))), F.least("c", F.lit(3)).cast("int") + 1)
        level = by_order[k].withColumn("d", d).withColumn("context", _context(F.col("gram")))
        contexts = level.groupBy("context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("free"))
        level = level.join(contexts, "context")
        if below is None:
            level = level.withColumn("under", F.lit(2.0**-BITS))
        else:
            level = level.withColumn("low", _last(F.col("gram"), k - 1)).join(below, "low")
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("free") * F.col("under")
        level = stored(level.select("gram", p.alias("p")), "level")
        below = level.select(F.col("gram").alias("low"), F.col("p").alias("under"))
        both = level.select(F.lit(2 * k).alias("level"), F.col("gram").alias("key"), F.log2("p").alias("value"))
        both = both.unionByName(contexts.select(F.lit(2 * k - 1).alias("level"), F.col("context").alias("key"), F.log2("free").alias("value")))
        out = both if out is None else out.unionByName(both)
    return stored(out, "model")


class Arrays:
    """The model as sorted arrays of hashes beside their values, one pair for each level."""

    def __init__(self, model: pd.DataFrame):
        self.levels = {}
        for level, rows in model.groupby("level"):
            key = rows["key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(key)
            self.levels[int(level)] = key[order], rows["value"].to_numpy(np.float64)[order]

    def find(self, level: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (0 for the others)."""
        keys, values = self.levels[level]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[at] == key
        return there, np.where(there, values[at], 0.0)

    def log2(self, gram: np.ndarray, k: int = ORDER) -> np.ndarray:
        """log2 of the probability of n-grams of k symbols: their own, or else the context's backoff weight and that of the last k - 1 symbols."""
        if not k or not self.levels:
            return np.full(len(gram), -float(BITS))
        there, out = self.find(2 * k, gram)
        lost = gram[~there]
        if len(lost):
            out[~there] = self.find(2 * k - 1, lost >> np.uint64(BITS))[1] + self.log2(lost & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
        return out


def look_up(model: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, value): what ``Arrays.log2`` gives for the distinct keys of ``asked``, by joins."""
    out = asked.select("key").distinct().withColumn("value", F.lit(None).cast("double")).withColumn("lost", F.lit(0.0))
    for k in range(ORDER, 0, -1):
        at = lambda level: model.where(F.col("level") == level).select(F.col("key").alias("at"), F.col("value").alias("v"))  # noqa: B023, E731
        gram = _last(F.col("key"), k)
        out = out.withColumn("at", gram).join(at(2 * k), "at", "left").withColumn("value", F.coalesce("value", F.col("lost") + F.col("v"))).drop("at", "v")
        out = out.withColumn("at", _context(gram)).join(at(2 * k - 1), "at", "left").withColumn("lost", F.col("lost") + F.coalesce("v", F.lit(0.0))).drop("at", "v")
    return out.select("key", F.coalesce("value", F.col("lost") - BITS).alias("value"))



METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RULES = ", ".join(f"{c} bigint" for c in METRICS) + ", base_failed boolean"
_NEW = (*METRICS, "base_failed", "log2_ppl")


def _ruled(texts: list[str]) -> pd.DataFrame:
    rules = np.array([text_rules(t) for t in texts], np.int64).reshape(-1, len(METRICS))
    return pd.DataFrame(rules, columns=list(METRICS)).assign(base_failed=(rules[:, 0] < 20) | (100 * rules[:, 4] > 30 * rules[:, 0]))


def _per_symbol(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return -np.add.reduceat(value, starts) / np.diff(np.append(starts, len(value)))


def measure(docs: DataFrame, model: DataFrame, keep: list[str], text: str = "text", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The columns ``keep`` plus the base metrics, base_failed, and log2_ppl (log2 of the perplexity per symbol)."""
    keep = [c for c in keep if c not in _NEW]
    if model.count() > max_entries:
        return _measure_joined(docs, model, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(Arrays(model.toArrow().to_pandas()))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        texts = [t or "" for t in batch[text]]
        ppl = np.zeros(len(texts))
        for first, group in _groups(texts):
            g, starts = grams(group)
            place, different = pd.factorize(g)
            ppl[first : first + len(group)] = _per_symbol(shared.value.log2(different)[place], starts)
        return _ruled(texts).assign(log2_ppl=ppl)

    return add_columns(docs, keep, [text], _RULES + ", log2_ppl double", run)


def _measure_joined(docs: DataFrame, model: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The same by a join with the model: a block of documents is one row (its columns as an Arrow stream, its texts compressed, its distinct n-grams)."""
    made = to_arrow_schema(T._parse_datatype_string(_RULES))
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(_RULES + ", log2_ppl double").fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pyspark.TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for first, group in _groups(texts, _BLOCK):
                rules = pa.RecordBatch.from_pandas(_ruled(group), made, preserve_index=False)
                kept = batch.slice(first, len(group)).select(keep)
                rows = pa.RecordBatch.from_arrays([*kept.columns, *rules.columns], names=[*keep, *made.names])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as w:
                    w.write_batch(rows)
                sizes = np.fromiter(map(len, group), np.int64, len(group)).tobytes()
                z = zstandard.compress("".join(group).encode("utf-32-le", "surrogatepass"), 1)
                keys = np.unique(grams(group)[0]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()]), pa.array([sizes]), pa.array([z]), pa.array([keys], pa.list_(pa.int64()))], names=["block", "rows", "sizes", "z", "keys"])
                block += 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                key = np.array([x["key"] for x in r["values"]], np.int64).view(np.uint64)
                value = np.array([x["value"] for x in r["values"]])
                order = np.argsort(key)
                ends = np.cumsum(np.frombuffer(r["sizes"], np.int64)).tolist()
                whole = zstandard.decompress(r["z"]).decode("utf-32-le", "surrogatepass")
                g, starts = grams([whole[a:b] for a, b in zip([0, *ends], ends)])
                ppl = _per_symbol(value[order][np.searchsorted(key[order], g)], starts)
                with pa.ipc.open_stream(r["rows"]) as rows:
                    one = rows.read_next_batch()
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array(ppl)], names=[*one.schema.names, "log2_ppl"])

    bound_batches(docs.sparkSession)
    rows = docs.select(*dict.fromkeys([*keep, text]))
    blocks = stored(rows.mapInArrow(pack, "block bigint, rows binary, sizes binary, z binary, keys array<bigint>"), "blocks")
    asked = blocks.select("block", F.explode("keys").alias("key"))
    answers = asked.join(stored(look_up(model, asked), "found"), "key").groupBy("block").agg(F.collect_list(F.struct("key", "value")).alias("values"))
    return blocks.select("block", "rows", "sizes", "z").join(answers, "block").drop("block").mapInArrow(score, schema)


def bands(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """(band_lang, low, high); band_lang null holds for all languages of too few documents."""
    ok = measured.where("not base_failed").select(F.coalesce(lang, F.lit("")).alias("l"), F.round(F.col("log2_ppl") / BIN).cast("int").alias("bin"))
    hist = stored(ok.groupBy("l", "bin").agg(F.count(F.lit(1)).alias("n")), "hist")
    many = hist.groupBy("l").agg(F.sum("n").alias("of")).where(F.col("of") >= MIN_DOCUMENTS).select("l", F.col("l").alias("band_lang"))
    hist = hist.join(many, "l", "left").groupBy("band_lang", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("band_lang")
    up = hist.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    q = [F.min(F.when(F.col("upto") >= p * F.col("all"), F.col("bin") * BIN)).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    spread = F.greatest(F.col("q75") - F.col("q25"), F.lit(MIN_SPREAD))
    return up.groupBy("band_lang").agg(*q).select("band_lang", (F.col("q50") - LOWER * spread).alias("low"), (F.col("q50") + UPPER * spread).alias("high"))


def verdicts(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """``measured`` plus kept: not base_failed and log2_ppl inside its language's band."""
    limits = stored(bands(measured, lang), "bands")
    at, bottom, top = fresh(measured.columns, "band_lang", "low", "high")
    own = limits.where("band_lang is not null").select(F.col("band_lang").alias(at), F.col("low").alias(bottom), F.col("high").alias(top))
    rest = (limits.where("band_lang is null").select("low", "high").first() or (None, None))
    low, high = (F.coalesce(c, F.lit(x).cast("double")) for c, x in zip((bottom, top), rest, strict=True))
    fits = F.coalesce((F.col("log2_ppl") >= low) & (F.col("log2_ppl") <= high), F.lit(True))
    met = measured.join(own, F.coalesce(measured[lang], F.lit("")) == own[at], "left")
    return met.withColumn("kept", ~F.col("base_failed") & fits).drop(at, bottom, top)


def quality(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Metrics and verdict of every document; ``keep`` names the columns to carry along (all by default)."""
    keep = list(dict.fromkeys([*(docs.columns if keep is None else keep), lang]))
    model = kneser_ney(count_grams(docs, text))
    return verdicts(stored(measure(docs, model, keep, text, max_entries), "quality"), lang)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands on every document."""
    rows = quality(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return rows.select("doc_id", *METRICS, "base_failed", "kept", F.round("log2_ppl", 6).alias("log2_ppl"))
