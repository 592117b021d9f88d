"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.sources.tables import shared_dir, stored

__all__ = ["WordHashes", "add_columns", "ascii_lower", "bit_filter", "bound_batches", "fresh", "give_back", "join_counted", "map_frames", "maybe_in", "mix", "read", "shared_dir", "stored"]

BATCH_BYTES = 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: pandas would make floats of integers with nulls, which large ids do not survive.
NULLABLE = {pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    return pd.DataFrame({n: c.to_pandas(types_mapper=NULLABLE.get if c.null_count else None) for n, c in zip(batch.schema.names, batch.columns, strict=True)})


def give_back() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and would keep it beside what the next one needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB in this session, so that long texts do not fill a Python worker; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas whose integers stay integers beside nulls."""
    to = to_arrow_schema(T._parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for out in run(_frame(b) for b in batches):
            yield from pa.Table.from_pandas(out, to, preserve_index=False).to_batches()
        give_back()

    bound_batches(df.sparkSession)
    return df.mapInArrow(each, schema)


def add_columns(df: DataFrame, keep: Sequence[str], used: Sequence[str], schema: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The columns ``keep``, which stay in the JVM, and those of ``schema``, which ``make`` gives for a batch of the columns ``used``."""
    new = T._parse_datatype_string(schema)
    to = to_arrow_schema(new)
    names = list(used)
    new_task = [True]

    def each(*columns: pa.Array) -> pa.Array:
        if new_task:
            new_task.clear()
            give_back()
        made = pa.RecordBatch.from_pandas(make(_frame(pa.RecordBatch.from_arrays(list(columns), names))), to, preserve_index=False)
        return pa.StructArray.from_arrays(made.columns, fields=list(to))

    bound_batches(df.sparkSession)
    # not deterministic to the optimiser, so that a filter on the result does not run it again
    called = F.arrow_udf(each, new).asNondeterministic()(*[F.col(c) for c in names])
    made = "_made"
    while made in keep:
        made += "_"
    return df.select(*keep, called.alias(made)).select(*keep, *[F.col(made)[n].alias(n) for n in new.names])


def bit_filter(keys: DataFrame, key: str, bits_per_key: int = 16, max_bits: int = 1 << 24) -> tuple[DataFrame, int]:
    """A bit array of (word, bits) rows over the 64-bit hashes ``key``, and its number of bits: a power of two, at most ``max_bits`` (2 MB); a fuller one only lets more pass."""
    n = keys.count() * bits_per_key
    size = min(max_bits, max(1 << 10, 1 << n.bit_length()))
    at = F.col(key).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")), size


def maybe_in(df: DataFrame, key: str, name: str, words: DataFrame, size: int) -> DataFrame:
    """``df`` with the boolean ``name``: whether the filter lets its 64-bit hash ``key`` pass. The filter is broadcast, its size is bounded."""
    at = F.col(key).bitwiseAND(F.lit(size - 1))
    words = words.select(F.col("word").alias(f"{name}_word"), F.col("bits").alias(f"{name}_bits"))
    met = df.withColumn(f"{name}_word", F.shiftright(at, 6)).join(F.broadcast(words), f"{name}_word", "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return met.withColumn(name, F.coalesce(F.col(f"{name}_bits").bitwiseAND(bit) != 0, F.lit(False))).drop(f"{name}_word", f"{name}_bits")


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as tell them from the columns ``taken``, in any case."""
    known = {t.lower() for t in taken}
    pad = "_"
    while known & {(pad + n).lower() for n in names}:
        pad += "_"
    return [pad + n for n in names]


def join_counted(rows: DataFrame, keyed: DataFrame, on: Sequence[str], hot: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to the distinct keys ``keyed``, a stored table whose column n, which is dropped, counts their rows.

    A key of over ``hot`` rows would fill one task. Such keys are at most the number of rows divided by ``hot``, so they are
    broadcast, if there are any; the others are shuffled. Rows with a null in their key meet nothing and are not shuffled.
    """
    many, few = keyed.where(F.col("n") > hot).drop("n"), keyed.where(F.col("n") <= hot).drop("n")
    named = rows.dropna(subset=list(on))
    if many.isEmpty():
        out = named.join(few, list(on), how)
    else:
        rest = named.join(F.broadcast(many.select(*on)), list(on), "left_anti").join(few, list(on), how)
        out = named.join(F.broadcast(many), list(on)).unionByName(rest)
    if how == "left":
        null = F.lit(False)
        for c in on:
            null = null | F.col(c).isNull()
        out = out.unionByName(rows.where(null), allowMissingColumns=True)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, whatever the locale and script."""
    return F.translate(col, UPPER, UPPER.lower())


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to ``keep`` words of a task."""

    def __init__(self, keep: int = 100_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
