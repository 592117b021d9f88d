"""Keys and links of tables: unique column sets, declared links, checking links, and finding candidates by containment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import comparable, family, ref, unpivoted
from plumbline.sources.tables import stored

_NAMES = ["child_table", "child_column", "parent_table", "parent_column"]
#: Column sets whose estimated number of different values reaches this share of the rows are counted exactly.
NEAR_UNIQUE = 0.9


def check_link(child: DataFrame, column: str | Sequence[str], parent: DataFrame, target: str | Sequence[str]) -> DataFrame:
    """One row: rows with a value (in every column of the link), orphans among them, and the share that match. Values are added up before the join, so hot values are no matter."""
    columns, targets = ([x] if isinstance(x, str) else list(x) for x in (column, target))
    if len(columns) != len(targets):
        raise ValueError("a link needs as many columns on both sides")
    keys = [f"k{i}" for i in range(len(columns))]
    filled = " and ".join(f"{k} is not null" for k in keys)
    values = child.groupBy(*[ref(c).alias(k) for c, k in zip(columns, keys, strict=True)]).agg(F.count(F.lit(1)).alias("n")).where(filled)
    there = parent.select(*[ref(c).alias(k) for c, k in zip(targets, keys, strict=True)]).where(filled).distinct().withColumn("found", F.lit(True))
    met = values.join(there, keys, "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filled_rows"), F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))
    return met.select("filled_rows", "orphan_rows", F.when(F.col("filled_rows") > 0, 100.0 * (F.col("filled_rows") - F.col("orphan_rows")) / F.col("filled_rows")).otherwise(0.0).alias("match_percentage"))


def _kind(f: T.StructField) -> str | None:
    """integer (all widths compare) or text; other columns are not linked."""
    if f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    return "text" if family(f.dataType) == "text" else None


def _typed(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    return {f.name: k for f in df.schema.fields if (k := _kind(f)) and (columns is None or f.name in columns)}


def _value(name: str, kind: str) -> Column:
    return ref(name).cast("long") if kind == "integer" else ref(name)


def sketched_pairs(tables: Mapping[str, DataFrame], min_distinct: int = 2) -> DataFrame:
    """Pairs of columns (child_table, child_column, parent_table, parent_column) between which a link is not ruled out; one scan of each table, nothing shuffled but a row for each column.

    A theta sketch holds the least hashes of a column's values. A hash in the child's sketch that lies in the range of the
    parent's and is missing there belongs to a value that the parent lacks: such pairs are certainly no link, and no link
    is lost. A pair also goes if the child's extremes lie outside the parent's, or the estimated number of the parent's
    different values is far from the number of its rows.
    """
    rows = None
    for name, df in tables.items():
        typed = _typed(df)
        if not typed:
            continue
        one = []
        for c, kind in typed.items():
            v = _value(c, kind)
            ends = [(f(v) if kind == "integer" else F.lit(None)).cast("long") for f in (F.min, F.max)] + [(f(v) if kind == "text" else F.lit(None)).cast("string") for f in (F.min, F.max)]
            one.append(F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count(v).alias("n"), F.theta_sketch_agg(v.cast("string"), F.lit(14)).alias("theta"), *[e.alias(x) for e, x in zip(ends, ("lo", "hi", "first", "last"), strict=True)]))
        found = df.agg(F.array(*one).alias("c")).select(F.inline("c"))
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        raise ValueError("no table has a column that could be linked")
    d = F.theta_sketch_estimate("theta")
    rows = stored(rows.withColumn("d", d).where(F.col("d") >= min_distinct), "sketches")
    light = rows.drop("theta")
    side = lambda s: light.select(*[F.col(x).alias(f"{s}_{x}") for x in light.columns])
    within = lambda a, b: (F.col(f"child_{a}") >= F.col(f"parent_{a}")) & (F.col(f"child_{b}") <= F.col(f"parent_{b}"))
    # a small row for each pair of columns of a kind; then the sketches of those that are left
    pairs = side("child").join(side("parent").where(F.col("parent_d") >= NEAR_UNIQUE * F.col("parent_n")), (F.col("child_kind") == F.col("parent_kind")) & (F.col("child_table") != F.col("parent_table")))
    pairs = pairs.where(F.when(F.col("child_kind") == "integer", within("lo", "hi")).otherwise(within("first", "last"))).select(*_NAMES)
    for x in ("child", "parent"):
        pairs = pairs.join(rows.select(F.col("table").alias(f"{x}_table"), F.col("column").alias(f"{x}_column"), F.col("theta").alias(f"{x}_theta")), [f"{x}_table", f"{x}_column"])
    return pairs.where(F.theta_sketch_estimate(F.theta_difference("child_theta", "parent_theta")) == 0).select(*_NAMES)


def discover_links(tables: Mapping[str, DataFrame], min_distinct: int = 2) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, distinct_values): all values of the child column are in a unique parent column of another table.

    Sketches of all integer and text columns leave few pairs; the columns of these are reduced to their different values
    once, and counted exactly in one join of integers and one of texts.
    """
    pairs = stored(sketched_pairs(tables, min_distinct), "pairs")
    left = pairs.collect()  # at most a row for each pair of columns
    wanted = {(r[0], r[1]) for r in left} | {(r[2], r[3]) for r in left}
    out = None
    for kind in ("integer", "text"):
        rows = None
        for name, df in tables.items():
            typed = {c: k for c, k in _typed(df).items() if k == kind and (name, c) in wanted}
            if typed:
                v = unpivoted(df, {c: _value(c, kind) for c in typed}, kind="long" if kind == "integer" else "string")
                n = v.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "column_name", "v", "n")
                rows = n if rows is None else rows.unionByName(n)
        if rows is None:
            continue
        rows = stored(rows, "values")
        sizes = rows.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("most"))
        sizes = stored(sizes.where(F.col("d") >= min_distinct), "sizes")
        c = sizes.select(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column"), F.col("d").alias("distinct_values"))
        p = sizes.where("most = 1").select(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"), F.col("d").alias("parent_values"))
        open_ = stored(pairs.join(c, _NAMES[:2]).join(p, _NAMES[2:]).where("distinct_values <= parent_values").select(*_NAMES, "distinct_values"), "pairs")
        child = rows.select("v", F.col("table_name").alias("child_table"), F.col("column_name").alias("child_column")).join(open_, _NAMES[:2])
        parent = rows.select("v", F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_column"))
        met = child.join(parent, ["v", *_NAMES[2:]]).groupBy(*_NAMES, "distinct_values").agg(F.count(F.lit(1)).alias("met"))
        met = met.where("met = distinct_values").drop("met")
        out = met if out is None else out.unionByName(met)
    return pairs.withColumn("distinct_values", F.lit(0).cast("long")).limit(0) if out is None else out


def unique_keys(df: DataFrame, max_columns: int = 2, columns: Sequence[str] | None = None) -> DataFrame:
    """(key_columns, n_columns): the least sets of up to ``max_columns`` columns without nulls, in table order, whose values differ in all rows.

    Level by level: sets that hold a key are left out; one scan estimates the different values of all other sets of a
    level, and those that come near the number of rows are counted exactly, by two hashes of their values. Empty tables
    have no key.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    value = {f.name: comparable(ref(f.name), f.dataType) for f in fields}
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(value.values())]).first()
    total = first["rows"]
    whole = [f.name for i, f in enumerate(fields) if total and first[f"n{i}"] == total]
    of, again = ({c: f"{x}{i}" for i, c in enumerate(whole)} for x in "hg")  # two hashes of each column, made once
    hashed = df.select(*[F.xxhash64(value[c]).alias(of[c]) for c in whole], *[F.xxhash64(F.lit(7), value[c]).alias(again[c]) for c in whole])
    keys: list[tuple[str, ...]] = []
    distinct: dict[tuple[str, ...], int] = {}
    for width in range(1, max_columns + 1):
        sets = [s for s in combinations(whole, width) if not any(set(k) <= set(s) for k in keys)]
        # of a set that could be one, all but one column may have so many values only as the rows need
        if width > 1:
            sets = [s for s in sets if NEAR_UNIQUE * total <= distinct[s[:1]] * distinct[s[1:]] * 1.2]
        distinct |= {s: total for s in combinations(whole, width) if s not in sets}  # not estimated: no bound on larger sets
        if not sets:
            continue
        # a row for each set, added up before the shuffle: as many sketches in one row would be too much code to compile
        rows = hashed.select(F.posexplode(F.array(*[F.xxhash64(*[ref(of[c]) for c in s]) for s in sets])).alias("i", "h"))
        estimates = rows.groupBy("i").agg(F.approx_count_distinct("h", 0.02).alias("d")).collect()  # a row for each set
        distinct |= {sets[r["i"]]: r["d"] for r in estimates}
        near = [s for s in sets if distinct[s] >= NEAR_UNIQUE * total]
        if near:
            hashes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(*[ref(of[c]) for c in s]).alias("a"), F.xxhash64(F.lit(7), *[ref(again[c]) for c in s]).alias("b")) for i, s in enumerate(near)]))
            repeated = hashed.select(hashes.alias("h")).groupBy("h.i", "h.a", "h.b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i").distinct().collect()  # at most a row for each set
            twice = {r["i"] for r in repeated}
            keys += [s for i, s in enumerate(near) if i not in twice]
    return df.sparkSession.createDataFrame([(list(k), len(k)) for k in keys], "key_columns array<string>, n_columns int")


def declared_links(rows: Sequence[tuple[str, str, str, str]] | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Links that the caller knows: (column_name, target_schema, target_table, target_column), typed as foreign keys."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), "column_name string, target_schema string, target_table string, target_column string")
    return df.select("column_name", "target_schema", "target_table", "target_column", F.lit("foreign_key").alias("type"))


def catalogue_links(key_columns: DataFrame, referential: DataFrame, schema_name: str, table_name: str) -> DataFrame:
    """The declared links of a table, from a database's information_schema.key_column_usage and referential_constraints (read them with ``open_table``): a row for each column of each key, in the order of the keys' columns.

    Columns of a link of several are paired by position_in_unique_constraint.
    """
    own = key_columns.where((F.col("table_schema") == schema_name) & (F.col("table_name") == table_name)).where("position_in_unique_constraint is not null")
    own = own.select("constraint_schema", "constraint_name", "column_name", "ordinal_position", F.col("position_in_unique_constraint").alias("position"))
    refers = referential.select("constraint_schema", "constraint_name", "unique_constraint_schema", "unique_constraint_name")
    target = key_columns.select(F.col("constraint_schema").alias("unique_constraint_schema"), F.col("constraint_name").alias("unique_constraint_name"), F.col("ordinal_position").alias("position"), F.col("table_schema").alias("target_schema"), F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"))
    met = own.join(refers, ["constraint_schema", "constraint_name"]).join(target, ["unique_constraint_schema", "unique_constraint_name", "position"])
    return met.orderBy("constraint_schema", "constraint_name", "ordinal_position").select("column_name", "target_schema", "target_table", "target_column", F.lit("foreign_key").alias("type"))
