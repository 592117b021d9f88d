"""Changes between the profiles of consecutive snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of change in the order of a report, with their severity.
KINDS = ("score", "removed", "type", "nullability", "distinct_count", "null_percentage", "distinct_percentage", "outlier_percentage", "pii", "added", "duplicate_rows")
SEVERITY = {"removed": "high", "type": "high", "added": "medium", "pii": "high", "nullability": "medium", "score": "medium", "null_percentage": "medium", "outlier_percentage": "medium", "distinct_percentage": "low", "distinct_count": "low", "duplicate_rows": "low"}


def consecutive(tables: DataFrame, key: Sequence[str] = ("schema_name", "table_name")) -> DataFrame:
    """(key, snapshot_id, previous_id) of table profiles; null for a table's first."""
    w = Window.partitionBy(*key).orderBy("created_at", "snapshot_id")
    return tables.select(*key, "snapshot_id", F.lag("snapshot_id").over(w).alias("previous_id"))


def _change(when: Column, kind: str, old: Column, new: Column, text: Column) -> Column:
    return F.when(when, F.struct(F.lit(KINDS.index(kind)).alias("kind_rank"), F.lit(kind).alias("kind"), F.lit(SEVERITY[kind]).alias("severity"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value"), text.alias("text")))


def _fixed(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def changes(columns: DataFrame, tables: DataFrame, key: Sequence[str] = ("schema_name", "table_name")) -> DataFrame:
    """(key, snapshot_id, column_name, kind_rank, kind, severity, old_value, new_value, text) of every snapshot against the one before it.

    ``columns`` holds column profiles with key and snapshot_id, ``tables`` (key, snapshot_id, created_at, score,
    duplicate_rows). Table-level changes have a null column_name.
    """
    key = list(key)
    pairs = consecutive(tables, key).where("previous_id is not null")
    fields = ["data_type", "nullable", "distinct_count", "null_percentage", "distinct_percentage", "outlier_percentage", "pii"]
    side = lambda p: columns.select(*key, "snapshot_id", "column_name", F.struct(*fields).alias(p))
    new = side("b").join(pairs.select(*key, "snapshot_id"), [*key, "snapshot_id"])
    old = side("a").withColumnRenamed("snapshot_id", "previous_id").join(pairs, [*key, "previous_id"]).drop("previous_id")
    both = old.join(new, [*key, "snapshot_id", "column_name"], "full_outer")
    a, b, name = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}")), F.col("column_name")
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    delta = lambda f, t: met & (F.abs(F.coalesce(b(f), F.lit(0.0)) - F.coalesce(a(f), F.lit(0.0))) >= t)
    arrow = lambda what, x, y, unit="": F.concat(F.lit(what + " changed: "), name, F.lit(" ("), x.cast("string"), F.lit(f"{unit} -> "), y.cast("string"), F.lit(f"{unit})"))
    rows = [
        _change(F.col("b").isNull(), "removed", a("data_type"), F.lit(None), F.concat(F.lit("removed: "), name)),
        _change(met & (a("data_type") != b("data_type")), "type", a("data_type"), b("data_type"), arrow("type", a("data_type"), b("data_type"))),
        _change(met & (a("nullable") != b("nullable")), "nullability", a("nullable"), b("nullable"), F.concat(F.lit("nullability changed: "), name)),
        _change(met & (a("distinct_count") != b("distinct_count")), "distinct_count", a("distinct_count"), b("distinct_count"), arrow("distinct count", a("distinct_count"), b("distinct_count"))),
        *[_change(delta(f, t), f, a(f), b(f), arrow(f.replace("_", " "), _fixed(a(f)), _fixed(b(f)), "%")) for f, t in (("null_percentage", 10), ("distinct_percentage", 10), ("outlier_percentage", 5))],
        _change(met & (a("pii") != b("pii")), "pii", a("pii"), b("pii"), arrow("PII classification", a("pii"), b("pii"))),
        _change(F.col("a").isNull(), "added", F.lit(None), b("data_type"), F.concat(F.lit("added: "), name)),
    ]
    per_column = both.select(*key, "snapshot_id", "column_name", F.inline(F.array_compact(F.array(*rows))))
    t = pairs.join(tables.select(*key, "snapshot_id", F.struct("score", "duplicate_rows").alias("b")), [*key, "snapshot_id"])
    t = t.join(tables.select(*key, F.col("snapshot_id").alias("previous_id"), F.struct("score", "duplicate_rows").alias("a")), [*key, "previous_id"])
    rows = [
        _change(a("score") != b("score"), "score", a("score"), b("score"), F.concat(F.lit("quality score changed: "), _fixed(a("score")), F.lit(" -> "), _fixed(b("score")))),
        _change(a("duplicate_rows") != b("duplicate_rows"), "duplicate_rows", a("duplicate_rows"), b("duplicate_rows"), F.concat(F.lit("duplicate rows changed: "), a("duplicate_rows").cast("string"), F.lit(" -> "), b("duplicate_rows").cast("string"))),
    ]
    per_table = t.select(*key, "snapshot_id", F.lit(None).cast("string").alias("column_name"), F.inline(F.array_compact(F.array(*rows))))
    return per_column.unionByName(per_table)


def reports(changed: DataFrame, tables: DataFrame, key: Sequence[str] = ("schema_name", "table_name")) -> DataFrame:
    """(key, snapshot_id, changed, score_delta, column_changes): one report per snapshot that has a predecessor; no change gives false and an empty list."""
    key = list(key)
    pairs = consecutive(tables, key).where("previous_id is not null")
    s = tables.select(*key, "snapshot_id", "score")
    p = pairs.join(s, [*key, "snapshot_id"]).join(s.withColumnRenamed("snapshot_id", "previous_id").withColumnRenamed("score", "old"), [*key, "previous_id"])
    text = changed.groupBy(*key, "snapshot_id").agg(F.sort_array(F.collect_list(F.struct("kind_rank", "column_name", "text"))).alias("l"))
    p = p.join(text, [*key, "snapshot_id"], "left")
    return p.select(*key, "snapshot_id", F.col("l").isNotNull().alias("changed"), (F.col("score") - F.col("old")).alias("score_delta"), F.coalesce(F.col("l.text"), F.array().cast("array<string>")).alias("column_changes"))
