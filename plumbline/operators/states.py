"""Mergeable statistics of the parts of a table: computed once for each part, merged without its rows.

Counts, sums and extremes merge as they are; moments as sums of powers of deviations, moved to the common mean, so that
large numbers lose no digits; different values by HyperLogLog sketches and percentiles by KLL sketches, whose error does
not grow with the number of parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import as_text, family, joined, percentage, ref
from plumbline.operators.stats import PERCENTILES

#: Size of a KLL sketch. A rank is off by at most RANK_ERROR of the values with a probability of 99 %.
KLL, RANK_ERROR = 400, 0.01
#: Columns in one aggregation, to keep generated code small.
BATCH = 20


def _state(f: T.StructField, ordinal: int) -> Column:
    c, kind = ref(f.name), family(f.dataType)
    text, numeric, dates = (kind == k for k in ("text", "numeric", "datetime"))
    none = F.lit(None).cast("double")
    v, n = c.cast("double"), F.count(c)
    finite = F.when((v - v) == 0, v)
    long = lambda x, on: x.cast("long") if on else F.lit(None).cast("long")
    num = lambda x: x if numeric else none
    m2 = F.coalesce(F.var_pop(v) * n, F.lit(0.0))
    text_of = as_text(f.name, f.dataType)
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(kind).alias("family"),
        F.count(F.lit(1)).alias("rows"), n.alias("n"), F.hll_sketch_agg(text_of).alias("hll"),
        long(F.count_if(c == ""), text).alias("empty"), long(F.count_if((c != "") & c.rlike(r"^\s+\z")), text).alias("blank"), long(F.min(F.length(c)), text).alias("len_lo"), long(F.max(F.length(c)), text).alias("len_hi"), long(F.sum(F.length(c)), text).alias("len_sum"),
        long(F.count_if(c == 0), numeric).alias("zeros"), num(F.sum(v)).alias("s1"), num(F.avg(v)).alias("mean"), num(m2).alias("m2"),
        num(F.coalesce(F.skewness(v) * F.pow(m2, F.lit(1.5)) / F.sqrt(n), F.lit(0.0))).alias("m3"), num(F.coalesce((F.kurtosis(v) + 3) * m2 * m2 / n, F.lit(0.0))).alias("m4"),
        num(F.min(v)).alias("lo"), num(F.max(v)).alias("hi"), (F.kll_sketch_agg_double(finite, F.lit(KLL)) if numeric else F.lit(None).cast("binary")).alias("kll"),
        long(F.unix_micros(F.min(c).cast("timestamp")) if dates else none, dates).alias("first"), long(F.unix_micros(F.max(c).cast("timestamp")) if dates else none, dates).alias("last"),
    )


def partial_states(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The states of all columns (of ``columns``) for each part of a table: a row per part and column, one scan."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields, 1) if f.name not in by and (columns is None or f.name in columns)]
    out = None
    for k in range(0, len(fields), BATCH):
        rows = df.groupBy(*[ref(b).alias(b) for b in by]).agg(F.array(*[_state(f, i) for i, f in fields[k : k + BATCH]]).alias("m")).select(*by, F.inline("m"))
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_states(states: DataFrame, by: Sequence[str] = (), at: Sequence[float] = PERCENTILES) -> DataFrame:
    """Statistics of the union of parts from their states. Percentiles (p50, ...) and approx_distinct_count are estimates."""
    key = [*by, "column_name"]
    common = states.groupBy(*key).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("n")))).alias("avg"))
    d, n, m2, m3, m4 = F.col("mean") - F.col("avg"), F.col("n"), F.col("m2"), F.col("m3"), F.col("m4")
    sums = {"m2": m2 + n * d * d, "m3": m3 + 3 * d * m2 + n * d * d * d, "m4": m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d}
    m = joined(states, common, key).groupBy(*key).agg(
        F.first("ordinal").alias("ordinal"), F.first("data_type").alias("data_type"), F.first("family").alias("family"), F.first("avg").alias("avg"), F.sum("rows").alias("total_rows"), F.sum("n").alias("n"),
        *[F.sum(x).alias(name) for name, x in sums.items()], F.sum("s1").alias("sum"), F.min("lo").alias("min_num"), F.max("hi").alias("max_num"), F.sum("zeros").alias("zero_count"),
        F.sum("empty").alias("empty_count"), F.sum("blank").alias("whitespace_count"), F.min("len_lo").alias("min_length"), F.max("len_hi").alias("max_length"), F.sum("len_sum").alias("len_sum"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("approx_distinct_count"), F.kll_merge_agg_double("kll").alias("kll"),
    )
    c = F.col
    some = F.col("kll").isNotNull() & (F.kll_sketch_get_n_double("kll") > 0)
    quantiles = [F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(p))).alias(f"p{round(100 * p)}") for p in at]
    return m.select(
        *key, "ordinal", "data_type", "family", "total_rows", (c("total_rows") - c("n")).alias("null_count"), percentage(c("total_rows") - c("n"), c("total_rows")).alias("null_percentage"), "approx_distinct_count",
        "avg", "sum", F.try_divide("m2", "n").alias("variance"), F.sqrt(F.try_divide("m2", "n")).alias("stddev"), F.when(c("m2") > 0, F.sqrt("n") * c("m3") / F.pow("m2", F.lit(1.5))).alias("skewness"), F.when(c("m2") > 0, c("n") * c("m4") / (c("m2") * c("m2")) - 3).alias("kurtosis"),
        "min_num", "max_num", "zero_count", "empty_count", "whitespace_count", "min_length", "max_length", F.try_divide("len_sum", "n").alias("avg_length"),
        F.timestamp_micros("first").alias("min_ts"), F.timestamp_micros("last").alias("max_ts"), ((c("last") - c("first")) / F.lit(86_400e6)).alias("date_range_days"), *quantiles, "kll",
    )


def rank_errors(df: DataFrame, merged: DataFrame, at: Sequence[float] = PERCENTILES, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, percentile, estimate, rank_error): how far the rank of each estimate lies from the percentile, as a share of all values; one scan, no shuffle of values."""
    from plumbline.operators.stats import numbers

    key = [*by, "column_name"]
    names = [f"p{round(100 * p)}" for p in at]
    rows = joined(numbers(df, None, by).where((F.col("v") - F.col("v")) == 0), merged.select(*key, *names), key)
    counts = [x for n in names for x in (F.count_if(F.col("v") < F.col(n)).alias(f"{n}_below"), F.count_if(F.col("v") <= F.col(n)).alias(f"{n}_upto"), F.first(n).alias(f"{n}_at"))]
    ranks = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("all"), *counts)
    # the estimate covers the ranks of all values equal to it
    error = lambda n, p: F.greatest(F.lit(0.0), F.col(f"{n}_below") / F.col("all") - p, p - F.col(f"{n}_upto") / F.col("all"))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("percentile"), F.col(f"{n}_at").alias("estimate"), error(n, p).alias("rank_error")) for n, p in zip(names, at, strict=True)]))
    return ranks.select(*key, each)
