"""Snapshots of profiles as append-only tables, and reading them back.

A snapshot has several parts (columns, tables, top values, ...), each a table of its own. ``commit`` writes all parts
under the id of the attempt and adds a line to the manifest last, as one file that appears at once. Readers see the
attempts that the manifest names, one for each snapshot: what a crashed attempt left is never read, and a retried or
repeated run adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

KEY = ("schema_name", "table_name")
_SNAPSHOT = (*KEY, "snapshot_id")
_MANIFEST = "schema_name string, table_name string, snapshot_id string, attempt string, committed_at timestamp"


def save(profile: DataFrame, path: str) -> None:
    """Append rows that carry schema_name and table_name; snapshots are never rewritten."""
    profile.write.mode("append").partitionBy(*KEY).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a saved table; names that look like numbers stay texts."""
    found = spark.read.option("mergeSchema", "true").parquet(path)
    fields = [T.StructField(f.name, T.StringType() if f.name in KEY else f.dataType, f.nullable) for f in found.schema.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(schema_name, table_name, snapshot_id, attempt, committed_at) of all snapshots that are there: of several attempts the one committed first."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    every = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    first = every.groupBy(*_SNAPSHOT).agg(F.min(F.struct("committed_at", "attempt")).alias("f"))
    return first.select(*_SNAPSHOT, "f.attempt", "f.committed_at")


def _of(schema_name: str, table_name: str, snapshot_id: str | None = None) -> Column:
    mine = (F.col("schema_name") == schema_name) & (F.col("table_name") == table_name)
    return mine if snapshot_id is None else mine & (F.col("snapshot_id") == snapshot_id)


def committed(spark: SparkSession, path: str, schema_name: str, table_name: str, snapshot_id: str) -> bool:
    return bool(manifest(spark, path).where(_of(schema_name, table_name, snapshot_id)).take(1))


def stage(parts: Mapping[str, DataFrame], path: str, schema_name: str, table_name: str, snapshot_id: str, created_at: Column) -> str:
    """Write the parts of a snapshot, not yet to be seen; gives the attempt's id."""
    attempt = uuid.uuid4().hex
    tag = {"schema_name": F.lit(schema_name), "table_name": F.lit(table_name), "snapshot_id": F.lit(snapshot_id), "created_at": created_at, "attempt": F.lit(attempt)}
    kinds = []
    for name, rows in parts.items():
        rows = rows.withColumns(tag)
        save(rows, f"{path}/{name}")
        kinds.append((name, rows.schema.json()))
    # a part without rows has no file that would tell its columns
    spark = rows.sparkSession
    spark.createDataFrame(kinds, "part string, columns string").coalesce(1).write.mode("append").parquet(f"{path}/kinds")
    return attempt


def publish(spark: SparkSession, path: str, schema_name: str, table_name: str, snapshot_id: str, attempt: str) -> None:
    """Let an attempt's parts be seen, all at once."""
    row = spark.range(1).select(F.lit(schema_name).alias("schema_name"), F.lit(table_name).alias("table_name"), F.lit(snapshot_id).alias("snapshot_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def commit(parts: Mapping[str, DataFrame], path: str, schema_name: str, table_name: str, snapshot_id: str, created_at: Column) -> bool:
    """Save a snapshot whole; False, and nothing is written, if it is there already."""
    spark = next(iter(parts.values())).sparkSession
    if committed(spark, path, schema_name, table_name, snapshot_id):
        return False
    publish(spark, path, schema_name, table_name, snapshot_id, stage(parts, path, schema_name, table_name, snapshot_id, created_at))
    return True


def load_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """The rows of a part of all committed snapshots. The manifest has a row for each snapshot and is broadcast while Spark finds it small."""
    seen = manifest(spark, path).select(*_SNAPSHOT, "attempt")
    try:
        rows = load(spark, f"{path}/{part}")
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        kind = spark.read.parquet(f"{path}/kinds").where(F.col("part") == part).first()
        return spark.createDataFrame([], T.StructType.fromJson(json.loads(kind["columns"]))).drop("attempt")
    return rows.join(seen, [*_SNAPSHOT, "attempt"], "left_semi").drop("attempt")


def history(snapshots: DataFrame, limit: int = 20, key: Sequence[str] = KEY) -> DataFrame:
    """The newest ``limit`` (1 to 100, else 20) snapshots of each table, newest first as ``rank`` 1."""
    limit = limit if 1 <= limit <= 100 else 20
    w = Window.partitionBy(*key).orderBy(F.col("created_at").desc(), F.col("snapshot_id").desc())
    return snapshots.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def latest(snapshots: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return history(snapshots, 1, key).drop("rank")


def previous(snapshots: DataFrame, before, key: Sequence[str] = KEY) -> DataFrame:
    """The newest snapshot of each table made before a time."""
    return latest(snapshots.where(F.col("created_at") < before), key)


def to_json(rows: DataFrame, *keep: str) -> DataFrame:
    """Every row as a JSON document ``payload`` beside the columns to keep."""
    return rows.select(*keep, F.to_json(F.struct(*rows.columns)).alias("payload"))


def from_json(documents: DataFrame, like: DataFrame) -> DataFrame:
    return documents.select(F.from_json("payload", like.schema).alias("p")).select("p.*")
