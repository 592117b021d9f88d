"""Operator 11, spelling variants found by asymmetric q-chunks.

Words are counted in Spark; two words are near if one inserted, deleted or replaced code point tells them apart. Of a
pair, the shorter word (or either of two of one length) is cut into two disjoint chunks; the other gives its positional
grams of the chunks' widths. One edit leaves a chunk whole, in the other word at its own place (the edit lies behind it)
or moved by the difference of the lengths, none or one (the edit lies before it), so of all grams within shift one only
those two can meet it, and the join asks for place and text at once. Candidates are verified by banded edit distance.

A chunk that many words share (a common prefix or ending) would pair all of them. Such groups are cut again: the window
between the chunk and the far end, in which the edit lies, is halved, and one of its halves joins the chunk. Halving ends
at one code point, where members differ in nothing else; so all pairs are found and no group is paired whole. A pair is
taken from the one group whose window holds its first difference.

Variants point to the near word of largest count (ties: least in code-point order) if that is at least ``ratio`` times
their own; roots follow such pointers to the end by pointer doubling.

Defined cases: null text has no words; a null doc_id reads as the empty text; repeated rows count as often as they occur;
a run of letters of any length is a word; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import map_frames, read, stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Groups of more words are cut again.
GROUP = 64
#: Words a task counts before it hands them on.
KEPT = 200_000


def damaged_words(docs: DataFrame, least: int = LEAST_LENGTH, every: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): counts, several rows a word, of letter runs of at least ``least`` code points after one run in ``every`` (by crc32 of document and run) has lost a code point."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")  # maximal: shorter runs cannot become words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        give = lambda: pd.DataFrame({"word": list(total.keys()), "n": list(total.values())}).astype({"n": "int64"})
        for batch in batches:
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                if pd.isna(t):
                    continue
                seed = zlib.crc32(f"{'' if pd.isna(d) else d}:".encode())
                for word, n in Counter(runs.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > KEPT:
                    yield give()
                    total.clear()
        yield give()

    return map_frames(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")), count, "word string, n bigint")


def _grams(words: DataFrame, longer: int) -> DataFrame:
    """(len, a, b, longer, word, n): two windows of each word, as the shorter of a pair sees them; a code points before the window and b behind it are a chunk."""
    size = F.length("word") - longer
    half = F.floor(size / 2).cast("int")
    window = F.explode(F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (size - half).alias("b"))))
    return words.select(size.alias("len"), F.lit(longer).alias("longer"), "word", "n", window.alias("w")).select("len", "w.a", "w.b", "longer", "word", "n")


def _chunk() -> list:
    """The key columns of a group: length of the shorter word, window, and the text around it."""
    around = F.xxhash64(F.expr("substring(word, 1, a)"), F.expr("if(b > 0, right(word, b), '')"))
    return ["len", "a", "b", around.alias("chunk")]


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Pairs (x, nx, y, ny) of near words, each once."""
    key = ["len", "a", "b", "chunk"]
    # the longer word of a pair may be the shortest word and one more
    rows = _grams(words, 0).unionByName(_grams(words, 1).where(F.col("len") > 0))
    ready = None
    while True:
        rows = stored(rows.select(*_chunk(), "longer", "word", "n"), "grams")
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("longer") == 0).alias("chunks")).where("size > 1 and chunks > 0")
        crowded = (F.col("size") > group) & (F.col("len") - F.col("a") - F.col("b") > 1)
        sizes = stored(sizes.select(*key, crowded.alias("crowded")), "sizes")
        small = rows.join(sizes.where("not crowded").drop("crowded"), key)
        ready = small if ready is None else ready.unionByName(small)
        if not sizes.where("crowded").take(1):
            break
        half = F.floor((F.col("len") - F.col("a") - F.col("b")) / 2).cast("int")
        middle = F.col("len") - F.col("a") - F.col("b")
        halves = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b"))))
        rows = rows.join(sizes.where("crowded").drop("crowded"), key).select("len", halves.alias("w"), "longer", "word", "n").select("len", "w.a", "w.b", "longer", "word", "n")
    ready = stored(ready, "groups")
    x = ready.where("longer = 0").select(*key, F.col("word").alias("x"), F.col("n").alias("nx"))
    y = ready.select(*key, "longer", F.col("word").alias("y"), F.col("n").alias("ny"))
    inside = (F.col("b") == 0) | (F.expr("substring(x, 1, len - b)") != F.expr("substring(y, 1, len - b)"))  # the first difference lies in the window
    met = x.join(y, key).where(((F.col("longer") == 1) | (F.col("x") < F.col("y"))) & inside)
    return met.where(F.levenshtein("x", "y", 1) == 1).select("x", "nx", "y", "ny")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the end of the chain. Counts rise tenfold along it, so doubling ends after a few joins."""
    to = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = step.drop("moved")
        if not step.where("moved").take(1):
            return to


def variants(docs: DataFrame, ratio: int = RATIO, least_count: int = LEAST_COUNT, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = damaged_words(docs, doc_id=doc_id, text=text).groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words.where(F.col("n") >= least_count), "words")
    pairs = stored(near_pairs(words, group), "pairs")
    sides = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("m")).unionByName(pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("m")))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    far = -F.col("best.m") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n"))
    out = stored(out, "forms")
    return out.join(roots(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their spelling variants."""
    found = variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
