"""Column families, text forms and guarded percentages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def family(dtype: T.DataType) -> str:
    """text, datetime, numeric or other, by the class of the type (a name such as array<int> would mislead)."""
    if isinstance(dtype, T.StringType | T.CharType | T.VarcharType):
        return "text"
    if isinstance(dtype, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "datetime"
    return "numeric" if isinstance(dtype, T.NumericType) else "other"


def of_family(df: DataFrame, kind: str, skip: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == kind and f.name not in skip]


def ref(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    return isinstance(dtype, T.MapType) or isinstance(dtype, T.StructType) and any(_holds_map(f.dataType) for f in dtype.fields)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """``c`` with every map in it, at any depth, as an array of its entries sorted by key, so that it can be grouped, hashed and compared."""
    if not _holds_map(dtype):
        return c
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: comparable(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[comparable(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]))
    entries = F.transform(F.map_entries(c), lambda e: F.struct(comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")))
    return F.array_sort(entries)


def row_values(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """All columns but ``skip`` in a form that can be grouped and hashed."""
    return [comparable(ref(f.name), f.dataType) for f in df.schema.fields if f.name not in skip]


def unpivoted(df: DataFrame, values: dict[str, Column], by: Sequence[str] = (), kind: str = "string") -> DataFrame:
    """(by, column_name, v): the non-null ``values`` (name -> column), one below the other; whatever the names hold, and no rows if there are none."""
    if not values:
        return df.select(*[ref(b).alias(b) for b in by], F.lit("").alias("column_name"), F.lit(None).cast(kind).alias("v")).where(F.lit(False))
    rows = df.select(*[ref(b).alias(b) for b in by], *[v.cast(kind).alias(name) for name, v in values.items()])
    return rows.unpivot([ref(b) for b in by], [ref(n) for n in values], "column_name", "v").where("v is not null")


def joined(left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Both sides on ``key``, where nulls are equal; one copy of the key. ``small``: the right side is known to be, and is broadcast."""
    right = right.select(*[ref(c).alias(f"_right_{c}" if c in key else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [ref(k).eqNullSafe(ref(f"_right_{k}")) for k in key])
    return left.join(F.broadcast(right) if small else right, on, how).drop(*[f"_right_{k}" for k in key])


def as_text(name: str, dtype: T.DataType) -> Column:
    c = comparable(ref(name), dtype)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    if isinstance(dtype, T.FloatType | T.DoubleType):
        c = c + F.lit(0.0).cast(dtype)  # -0.0 and 0.0 are one value
    return c.cast("string")


def percentage(part: Column, total: Column) -> Column:
    """100 * part / total, 0 of an empty total."""
    return F.when(total > 0, part * F.lit(100.0) / total).otherwise(F.lit(0.0))


def likely_key(name: Column) -> Column:
    """Whether a column name reads like an identifier."""
    n = F.lower(F.trim(name))
    return (n == "id") | ((F.length(n) > 3) & (n.endswith("_id") | n.endswith("id")))


def decimals(number: Column, digits: int) -> Column:
    """A double rounded to ``digits`` as a decimal text (0.0006, 20000000.0), where a cast of a small or large one gives a power of ten (6.0E-4, 2.0E7); null for NaN and infinity."""
    plain = F.round(number, digits).try_cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(plain, r"(\.[0-9]+?)0+$", "$1")
