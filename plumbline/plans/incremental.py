"""Profiles of a growing table: only parts that have changed are read again.

A part is a value of the table's partition columns. Its fingerprint is made of its files' paths, sizes and times, so
finding out what has changed reads no data. States of changed parts are computed in one scan that is pruned to them, and
saved beside those of the others; an index of (part, fingerprint, attempt) says which states make up the table now and is
written last, so that a crash leaves the last profile as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ref
from plumbline.operators import states
from plumbline.sources import history
from plumbline.sources.tables import stored

#: Up to so many changed parts are named in a partition filter; more are joined.
NAMED_PARTS = 1000


def part_of(by: Sequence[str]) -> Column:
    """The partition values as one text; null and the empty text differ."""
    return F.to_json(F.struct(*[ref(b).cast("string").alias(f"p{i}") for i, b in enumerate(by)]))


def fingerprints(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(part, fingerprint) of a table of files that is partitioned by ``by``: only names, sizes and times of the files are looked at."""
    files = df.select(part_of(by).alias("part"), "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    h = F.xxhash64("file_path", "file_size", "file_modification_time")
    return files.groupBy("part").agg(F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))).alias("fingerprint"))


@dataclass
class Incremental:
    """A profile from states: merged statistics, and what was read for it (parts, rows) beside what there is."""

    columns: DataFrame
    parts_read: int
    rows_read: int
    parts: int


def profile(df: DataFrame, by: Sequence[str], path: str, table: str) -> Incremental:
    """The profile of ``df``, a table of files partitioned by ``by``, from the states kept under ``path`` for ``table`` and those of parts that are new or changed since; parts that are gone count no more."""
    spark = df.sparkSession
    name = ("states", table)
    now = stored(fingerprints(df, by), "fingerprints")
    seen = history.manifest(spark, path).where((F.col("schema_name") == name[0]) & (F.col("table_name") == name[1]))
    newest = seen.orderBy(F.col("committed_at").desc(), F.col("attempt").desc()).select("snapshot_id", "attempt").first()
    if newest is None:
        index = now.limit(0).withColumn("run", F.lit(""))
    else:
        index = history.load(spark, f"{path}/index").where(F.col("attempt") == newest["attempt"]).select("part", "fingerprint", "run")
    known = index.select("part", F.col("fingerprint").alias("old"), "run")
    met = stored(now.join(known, "part", "left").withColumn("changed", ~F.col("fingerprint").eqNullSafe(F.col("old"))), "met")
    run = uuid.uuid4().hex
    changed = met.where("changed")
    n, all_parts = changed.count(), met.count()
    rows = 0
    if n:
        part = part_of(by)
        if n <= NAMED_PARTS:
            values = {r["part"] for r in changed.select("part").collect()}
            dirty = df.where(part.isin(sorted(values)))  # on partition columns alone: other parts' files are not opened
        else:
            dirty = df.withColumn("_part", part).join(changed.select(F.col("part").alias("_part")), "_part", "left_semi").drop("_part")
        fresh = states.partial_states(dirty, by).withColumn("part", part).drop(*by).withColumn("run", F.lit(run))
        tag = {"schema_name": F.lit(name[0]), "table_name": F.lit(name[1])}
        history.save(fresh.withColumns(tag), f"{path}/states")
    entries = met.select("part", "fingerprint", F.when(F.col("changed"), F.lit(run)).otherwise(F.col("run")).alias("run"))
    if n or newest is None or index.count() != all_parts:
        history.commit({"index": entries}, path, *name, run, F.current_timestamp())
    entries = stored(entries, "index")
    kept = history.load(spark, f"{path}/states").where(F.col("table_name") == name[1]).join(entries, ["part", "run"], "left_semi")
    if n:
        first = kept.where((F.col("run") == run) & (F.col("ordinal") == kept.agg(F.min("ordinal")).first()[0]))
        rows = first.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return Incremental(states.merge_states(kept), n, rows, all_parts)
