"""A profile as one nested JSON document for each snapshot, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KEY = ("schema_name", "table_name", "snapshot_id", "created_at")
#: Parts that belong to a column of the profile, and what orders their rows; all are bounded (ten values, nine classes, ten bins, twelve months).
PER_COLUMN = {"top_values": "rank", "patterns": "pattern", "histograms": "bin", "dates": "period"}
PER_TABLE = ("correlations", "links", "checks")
#: Of a report of ``drift.reports``, if the parts hold these; a first snapshot has none.
DRIFT = ("changed", "score_delta", "column_changes")


def documents(parts: Mapping[str, DataFrame]) -> DataFrame:
    """(schema_name, table_name, snapshot_id, created_at, payload): the parts of any number of snapshots (as ``history.load_part`` gives them) as one document each, with columns in their order and all that belongs to a column inside it."""
    key = list(_KEY)
    inner = lambda df, skip: [c for c in df.columns if c not in (*key, *skip)]
    columns = parts["columns"]
    own = inner(columns, ())
    for name, order in PER_COLUMN.items():
        fields = inner(parts[name], ("column_name",))
        rows = parts[name].groupBy(*key, "column_name").agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))
        columns = columns.join(rows, [*key, "column_name"], "left")
    nested = columns.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in own if c != "ordinal"], *PER_COLUMN))).alias("columns"))
    out = parts["tables"].join(nested, key, "left")
    for name in PER_TABLE:
        rows = parts[name].groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*inner(parts[name], ())))).alias(name))
        out = out.join(rows, key, "left")
    if "drift" in parts:
        rows = parts["drift"].select("schema_name", "table_name", "snapshot_id", F.struct(*DRIFT).alias("drift"))
        out = out.join(rows, ["schema_name", "table_name", "snapshot_id"], "left")
    return out.select(*key, F.to_json(F.struct(*inner(out, ()))).alias("payload"))


def document_schema(parts: Mapping[str, DataFrame]) -> T.StructType:
    """The type of a payload made of these parts."""
    row = lambda df, skip, first=None: sorted((f for f in df.schema.fields if f.name not in (*_KEY, *skip)), key=lambda f: f.name != first)
    lists = [T.StructField(n, T.ArrayType(T.StructType(row(parts[n], ("column_name",), o)))) for n, o in PER_COLUMN.items()]
    columns = T.StructType([*row(parts["columns"], (), "ordinal"), *lists])
    per_table = [T.StructField(n, T.ArrayType(T.StructType(row(parts[n], ())))) for n in PER_TABLE]
    drift = [T.StructField("drift", T.StructType([parts["drift"].schema[c] for c in DRIFT]))] if "drift" in parts else []
    return T.StructType([*row(parts["tables"], ()), T.StructField("columns", T.ArrayType(columns)), *per_table, *drift])


def parsed(docs: DataFrame, schema: T.StructType) -> dict[str, DataFrame]:
    """The parts of documents, as they were; a column or table without rows of a part has none of it."""
    p = docs.select(*_KEY, F.from_json("payload", schema).alias("p"))
    table = [f.name for f in schema.fields if f.name not in ("columns", "drift", *PER_TABLE)]
    out = {"tables": p.select(*_KEY, *[F.col(f"p.{c}") for c in table])}
    out |= {n: p.select(*_KEY, F.inline(f"p.{n}")) for n in PER_TABLE}
    if "drift" in schema.fieldNames():
        out["drift"] = p.where("p.drift is not null").select("schema_name", "table_name", "snapshot_id", "p.drift.*")
    every = p.select(*_KEY, F.inline("p.columns"))
    out["columns"] = every.drop(*PER_COLUMN)
    out |= {n: every.select(*_KEY, "column_name", F.inline(n)) for n in PER_COLUMN}
    return out
