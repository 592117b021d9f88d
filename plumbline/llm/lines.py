"""Operator 4, line dedup by a suffix array over line-ID sequences.

Lines that occur once cannot belong to a repeated run, so only repeated lines stay; they get IDs by rank of their 128-bit
hash, and their unbroken stretches (segments, numbered in document order) are the sequences.

Distributed prefix doubling ranks every suffix by its first 2^k lines: pairs (rank of the first half, rank of the second
half) are range-sorted by Spark and numbered in order, so the ranks of round k sort the suffixes by 2^k lines. Suffixes
whose pair occurs once are settled and drop out; rounds go on until no two suffixes share 2^k lines, or until the prefixes
are long enough (see below).

Going down again from the largest k gives each suffix its longest common prefix with an earlier suffix: a prefix of
``len`` lines is extended by the next 2^k lines if another suffix shares all of them and the first of these is an earlier
one. The suffixes that share a prefix are an interval of the suffix array with that longest common prefix, known by its
first member. What a suffix ends with is a repeated run that cannot be extended to the right, with its first copy.

Runs of at least ``min_words`` words are later copies, and their lines are deleted. Earlier is by (doc_id, hash of the
text, line). Only suffixes with ``min_words`` words take part in the way down, if the largest 2^k of the lines that hold
these words occur again.

Common prefixes have to be known up to ``min_words`` lines only. A repeated run is covered by the prefixes of its own
suffixes: take the last one that still has ``min_words`` words inside the run. It and all before it are later copies too,
and what the run has after its first line holds fewer words, so fewer lines, as every line has a word.

Defined cases: null and empty texts have no lines; blank lines are skipped by the sequences and stay in the text; a null
doc_id comes before all others; doc_id has to fit a long; rows equal in doc_id and text are one document, and all of them
lose the same lines; copies that overlap their own first copy lose all but its first lines; an empty table gives an empty
table; extra columns of any name are kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import bit_filter, bound_batches, join_counted, map_frames, maybe_in, read, stored

MIN_WORDS = 50
#: A key of more than this part of all lines is joined by a broadcast; there are fewer than a thousand in a round.
HOT_SHARE = 1000


def document_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, at, line_no, h1, h2, words) for each line with a word; at counts those lines only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            doc, at, no, h, n = [], [], [], [], []
            for d, t in enumerate(batch["text"]):
                k = 0
                for i, line in enumerate((t or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    words = len(line.split())
                    if words:
                        doc.append(d)
                        at.append(k)
                        no.append(i)
                        h.append(xxhash.xxh3_128_digest(line))
                        n.append(words)
                        k += 1
            both = np.frombuffer(b"".join(h), ">i8").reshape(-1, 2).astype(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array.take(np.array(doc, np.int64)), "th": batch["th"].to_numpy()[doc], "at": np.array(at, np.int32), "line_no": np.array(no, np.int32), "h1": both[:, 0], "h2": both[:, 1], "words": np.array(n, np.int32)})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id bigint, th bigint, at int, line_no int, h1 bigint, h2 bigint, words int")


def ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct ``keys`` of ``cols`` (other columns are kept) with ``rank``, a number that grows with their order."""
    # ids grow with the partition and the row in it, and partitions and rows are in order
    return stored(keys.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def line_sequences(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seg, doc_id, th, l): the stretches of repeated lines with at least ``min_words`` words; l has (at, line_no, words, id) in order."""
    lines = stored(document_lines(docs, doc_id, text), "lines")
    ids = ranked(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h1", "h2")
    again = join_counted(lines, ids, ["h1", "h2"], lines.count() // HOT_SHARE).select("doc_id", "th", "at", "line_no", "words", F.col("rank").alias("id"))
    again = stored(again.dropDuplicates(["doc_id", "th", "at"]), "again")
    order = Window.partitionBy("doc_id", "th").orderBy("at")
    stretch = again.withColumn("gap", F.col("at") - F.row_number().over(order))
    segments = stretch.groupBy("doc_id", "th", "gap").agg(F.sort_array(F.collect_list(F.struct("at", "line_no", "words", "id"))).alias("l"), F.sum("words").alias("n"))
    # numbered in document order, so that the smaller (seg, p) is the earlier line
    return ranked(segments.where(F.col("n") >= min_words).drop("n"), "doc_id", "th", "gap").select(F.col("rank").alias("seg"), "doc_id", "th", "l")


def suffix_ranks(names: DataFrame, upto: int | None = None) -> list[DataFrame]:
    """Prefix doubling over ``names`` (seg, p, rank; other columns are kept). Item k: the suffixes whose first 2^k lines occur again, rank in the order of these lines; the last item is the suffix array of what is then left, or the first that lets common prefixes of ``upto`` lines be put together."""
    out, hot = [names], names.count() // HOT_SHARE
    kept = [c for c in names.columns if c != "rank"]
    while upto is None or 1 << len(out) <= upto:
        step = 1 << (len(out) - 1)
        second = F.first("rank").over(Window.partitionBy("seg").orderBy("p").rangeBetween(step, step))
        pairs = stored(out[-1].select(*kept, F.col("rank").alias("a"), second.alias("b")).where("b is not null"), "pairs")
        numbers = ranked(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "a", "b")
        if numbers.isEmpty():
            break
        out.append(stored(join_counted(pairs, numbers, ["a", "b"], hot).select(*kept, "rank"), "names"))
    return out


def _least(words: np.ndarray, least: int) -> np.ndarray:
    """For every line the number of lines from it on that have ``least`` words together; 0 if all of them have not."""
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + least)
    return np.where(end < len(total), end - np.arange(len(words)), 0)


def suffixes(segments: DataFrame, least: int) -> DataFrame:
    """(seg, p, rank, need): every suffix, the id of its first line, and how many lines it takes to ``least`` words; 0 if it has not as many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            need = [_least(np.asarray(w, np.int64), least) for w in batch["words"]]
            size = [len(n) for n in need]
            yield pd.DataFrame({"seg": np.repeat(batch["seg"].to_numpy(), size), "p": np.concatenate([np.arange(n) for n in size] or [[]]).astype(np.int32), "rank": np.concatenate([*batch["ids"]] or [[]]).astype(np.int64), "need": np.concatenate(need or [[]]).astype(np.int32)})

    return map_frames(segments.select("seg", F.col("l.id").alias("ids"), F.col("l.words").alias("words")), run, "seg bigint, p int, rank bigint, need int")


def repeated_runs(segments: DataFrame, min_words: int = MIN_WORDS, upto: int | None = None) -> DataFrame:
    """(seg, p, len, first: struct(seg, p)): every suffix's longest common prefix with an earlier suffix, of those with ``min_words`` words or more; if ``upto`` (``min_words`` at least) is given, prefixes of more lines may be given as so many or more."""
    ranks = suffix_ranks(stored(suffixes(segments, min_words), "names"), upto)
    hot = ranks[0].count() // HOT_SHARE
    at = lambda k: ranks[k].select("seg", "p", F.col("rank").alias("b"))
    # suffixes of which the first 2^k of the needed lines occur again
    state = None
    for k, rank in enumerate(ranks):
        mine = rank.where((F.col("need") >= 1 << k) & (F.col("need") < 2 << k)).select("seg", "p", "need")
        state = mine if state is None else state.unionByName(mine)
    none = F.struct(F.lit(-1).cast("long").alias("seg"), F.lit(-1).alias("p"))
    # own: the suffix itself; else it stands for the interval that it is the first member of
    state = stored(state.select("seg", "p", "need", F.lit(0).alias("len"), none.alias("first"), F.lit(True).alias("own")), "state")
    for k in reversed(range(len(ranks))):
        here = state.withColumn("q", F.col("p") + F.col("len")).join(at(k).withColumnRenamed("p", "q"), ["seg", "q"], "left").drop("q")
        here = stored(here, "here")
        longer = here.where("b is not null").groupBy("len", "first", "b").agg(F.min(F.struct("seg", "p")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
        longer = stored(longer, "longer")
        # all copies of one passage share a key
        met = join_counted(here, longer, ["len", "first", "b"], hot, "left").drop("b")
        more = F.col("to").isNotNull() & (F.col("to") != F.struct("seg", "p")) & F.col("own")
        moved = met.select("seg", "p", "need", F.when(more, F.col("len") + (1 << k)).otherwise(F.col("len")).alias("len"), F.when(more, F.col("to")).otherwise(F.col("first")).alias("first"), "own")
        heads = longer.select("to.seg", "to.p", F.lit(0).alias("need"), (F.col("len") + (1 << k)).alias("len"), F.col("to").alias("first"), F.lit(False).alias("own")).distinct()
        state = stored(moved.unionByName(heads), "state")
    return state.where(F.col("own") & (F.col("len") >= F.col("need"))).select("seg", "p", "len", "first")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, line_no, words, seg, p): the lines of later copies."""
    segments = line_sequences(docs, min_words, doc_id, text)
    runs = stored(repeated_runs(segments, min_words, min_words), "runs")
    place = segments.join(runs.select("seg").distinct(), "seg", "left_semi").select("doc_id", "th", "seg", F.posexplode("l").alias("p", "x"))
    place = place.join(runs.select("seg", "p", (F.col("p") + F.col("len")).alias("end")), ["seg", "p"], "left")
    # a line is gone if a run that starts at it or before reaches beyond it; a segment lies in one document
    reach = F.max("end").over(Window.partitionBy("seg").orderBy("p"))
    return place.withColumn("reach", reach).where("reach > p").select("doc_id", "th", "seg", "p", F.col("x.line_no").alias("line_no"), F.col("x.words").alias("words"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, drop_empty: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the lines of later copies; n_chars, if there, is counted anew where lines went; documents left without a word are dropped if ``drop_empty`` (those that had none before stay)."""
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    gone = stored(gone.withColumn("key", F.xxhash64("doc_id", "th")), "gone")
    names = ["_key", "_id", "_th", "_lost", "_cut", "_maybe"]
    while set(names) & set(docs.columns):
        names = ["_" + n for n in names]
    key, id_, th, lost, cut, maybe = names
    # most documents lose nothing: a bit filter of bounded size lets them pass, the others meet their lines in a join
    rows = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64("text")).withColumn(key, F.xxhash64(id_, th))
    rows = maybe_in(rows, key, maybe, *bit_filter(gone, "key"))
    left = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), F.col("lines").alias(lost))
    met = rows.where(maybe).join(left, F.col(id_).eqNullSafe(left["gone_id"]) & (F.col(th) == left["gone_th"]), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, lost in zip(texts, gone, strict=True):
            if lost is not None:
                lost = set(lost)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
            out.append(t)
        return pd.Series(out, dtype=object)

    bound_batches(docs.sparkSession)
    # not deterministic to the optimiser, so that it runs once, not for the filter too
    met = met.withColumn(cut, without.asNondeterministic()("text", lost))
    if drop_empty:
        met = met.where(F.col(lost).isNull() | F.col(cut).rlike("[^ \\t\\n\\x0B\\f\\r]"))
    met = met.withColumn("text", F.col(cut))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.where(~F.col(maybe)).select(*docs.columns).unionByName(met.select(*docs.columns))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of lines that later copies lose: doc_id, start_line, n_lines (with blank lines between), n_words."""
    lost = repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    w = Window.partitionBy("seg").orderBy("p")
    runs = lost.withColumn("run", F.col("p") - F.row_number().over(w)).groupBy("doc_id", "seg", "run").agg(F.min("line_no").alias("start_line"), (F.max("line_no") - F.min("line_no") + 1).alias("n_lines"), F.sum("words").alias("n_words"))
    return runs.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_words").cast("long").alias("n_words"))
