"""From documents to token ids: quality rules, line dedup, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, lines, minhash, quality
from plumbline.llm.common import give_back, read, shared_dir
from plumbline.sources.tables import discard, recorded

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Tables that stages have stored on their way.
_LEFT: list[str] = []


def stage(run_: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what earlier ones stored on their way: their results are written, and ``docs`` is read from there."""

    @functools.wraps(run_)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _LEFT, docs)
        give_back()  # what the driver held for an earlier stage
        with recorded() as made:
            out = run_(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out

    return staged


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return quality.quality(docs).where("kept").select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents left without a word go."""
    return lines.remove_repeats(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.remove_near_duplicates(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


@stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids and their digests."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: Perplexity and MinHash have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns goes through the shared folder."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, step) in enumerate(STAGES[:-1]):
        step(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
