"""Statistics of all columns in one pass, and value frequencies shared by everything that groups by value.

``by`` names columns that split the table (say a snapshot or a day): every function then gives its rows per value of
them, in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.columns import as_text, family, joined, of_family, percentage, ref, row_values, unpivoted
from plumbline.sources.tables import stored

#: String classes in order of precedence; the first three ignore case.
PATTERNS = (
    ("email", r"(?i)^[^@\s]+@[A-Za-z0-9]+\.[A-Za-z]{2,}\z"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"),
    ("url", r"(?i)^https?://[^\s]+\z"),
    ("date", r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\z"),
    ("numeric_string", r"^[+-]?[0-9]+([.,][0-9]+)?\z"),
    ("integer_string", r"^[0-9]+\z"),
    ("alphabetic", r"^[A-Za-z]+\z"),
    ("alphanumeric", r"^[A-Za-z0-9]+\z"),
    ("symbolic", r"^[^A-Za-z0-9]+\z"),
)
#: Metric groups; moments are variance, deviation, skewness and kurtosis.
GROUPS = ("text", "numeric", "moments", "datetime")
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
ENTROPY_DISTINCT = 10_000
CORRELATED_COLUMNS = 12
BINS = 10
#: Longer texts are grouped by digest.
LONG_TEXT = 256
#: Columns in one aggregation, to keep generated code small.
COLUMN_BATCH = 60


def finite(v: Column) -> Column:
    """A number; null for NaN and infinity."""
    return F.when((v - v) == 0, v)


def _columns(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in by and (columns is None or f.name in columns)]


def _metrics(f: T.StructField, ordinal: int, as_of: Column, groups: Sequence[str]) -> Column:
    """The metrics of one column as a struct of aggregates; those of other groups are null or zero and cost nothing."""
    c, none = ref(f.name), F.lit(None)
    kind = family(f.dataType)
    total, filled = F.count(F.lit(1)), F.count(c)
    numeric, dates, text = (kind == k and k in groups for k in ("numeric", "datetime", "text"))
    num = c.cast("double")
    stat = lambda f_: f_(num) if numeric else none.cast("double")
    zero = F.lit(0).cast("long")
    ends = numeric or dates
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    future = F.count_if(c > as_of) if dates else zero
    return F.struct(
        F.lit(ordinal).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(kind).alias("family"), F.lit(f.nullable).alias("nullable"),
        total.alias("total_rows"), (total - filled).alias("null_count"), percentage(total - filled, total).alias("null_percentage"),
        (F.count_if(c == "") if text else zero).alias("empty_count"), (F.count_if((c != "") & c.rlike(r"^\s+\z")) if text else zero).alias("whitespace_count"),
        (F.coalesce(F.min(F.length(c)), F.lit(0)).cast("long") if text else none.cast("long")).alias("min_length"), (F.coalesce(F.max(F.length(c)), F.lit(0)).cast("long") if text else none.cast("long")).alias("max_length"),
        (F.avg(F.length(c)) if text else none.cast("double")).alias("avg_length"),
        (F.min(c).cast("string") if ends else none.cast("string")).alias("min"), (F.max(c).cast("string") if ends else none.cast("string")).alias("max"),
        stat(F.min).alias("min_num"), stat(F.max).alias("max_num"), stat(lambda v: F.min(finite(v))).alias("min_bin"), stat(lambda v: F.max(finite(v))).alias("max_bin"), stat(F.avg).alias("avg"), stat(F.sum).alias("sum"),
        (F.count_if(c == 0) if numeric else zero).alias("zero_count"),
        future.alias("future_date_count"), (percentage(future, filled) if dates else F.lit(0.0)).alias("future_date_percentage"),
        ((micros(F.max(c)) - micros(F.min(c))) / F.lit(86_400e6) if dates else none.cast("double")).alias("date_range_days"),
    )


def column_stats(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), as_of: Column | None = None, groups: Sequence[str] = GROUPS) -> DataFrame:
    """One row per column with the statistics of the metric ``groups`` (counts always); no statistics of an empty group.

    One scan; the moments take a second one, over rows of (column, number), as many aggregates in one row would be too
    much code for the JVM to compile.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    fields = _columns(df, columns, by)
    if not fields:
        raise ValueError("no column to profile")
    order = {f.name: i for i, f in enumerate(df.schema.fields, 1)}
    out = None
    for i in range(0, len(fields), COLUMN_BATCH):
        part = fields[i : i + COLUMN_BATCH]
        grouped = df.groupBy(*[ref(b).alias(b) for b in by]) if by else df
        rows = grouped.agg(F.array(*[_metrics(f, order[f.name], as_of, groups) for f in part]).alias("m")).select(*by, F.inline("m"))
        out = rows if out is None else out.unionByName(rows)
    moments = numbers(df, columns, by) if "moments" in groups and any(family(f.dataType) == "numeric" for f in fields) else None
    if moments is None:
        return out.withColumns({c: F.lit(None).cast("double") for c in ("variance", "stddev", "skewness", "kurtosis")})
    moments = moments.groupBy(*by, "column_name").agg(F.var_pop("v").alias("variance"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    moments = moments.select(*by, "column_name", "variance", F.sqrt("variance").alias("stddev"), "skewness", "kurtosis")
    return joined(out, moments, [*by, "column_name"], "left")


def value_freq(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, value, long, n): how often each non-null value occurs, as text; a text over LONG_TEXT characters by its SHA-256, with long set.

    One shuffle for all columns; hot values are added up before it.
    """
    fields = _columns(df, columns, by)
    long = unpivoted(df, {f.name: as_text(f.name, f.dataType) for f in fields}, by)
    long = long.withColumn("long", F.length("v") > LONG_TEXT).withColumn("value", F.when(F.col("long"), F.sha2("v", 256)).otherwise(F.col("v")))
    return long.groupBy(*by, "column_name", "value", "long").agg(F.count(F.lit(1)).alias("n"))


def distinct_by_hash(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, distinct_count): numbers of different values by two 64-bit hashes each, so that 16 bytes of a value are shuffled, however long it is; copies are joined before."""
    key = [*by, "column_name"]
    values = unpivoted(df, {f.name: as_text(f.name, f.dataType) for f in _columns(df, columns, by)}, by)
    different = values.groupBy(*key, F.xxhash64("v").alias("_a"), F.xxhash64(F.lit(7), "v").alias("_b")).agg(F.lit(1).alias("_n"))
    return different.groupBy(*key).agg(F.count(F.lit(1)).alias("distinct_count"))


def distinct_counts(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return freq.groupBy(*by, "column_name").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("filled"), F.max("n").alias("top_n"))


def top_values(freq: DataFrame, totals: DataFrame, df: DataFrame, by: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column of ``df``, ties by value (long texts by digest); percentage of all rows. ``totals`` has (by, column_name, total_rows)."""
    w = Window.partitionBy(*by, "column_name").orderBy(F.col("n").desc(), "value")
    top = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if of_family(df, "text", list(by)):
        top = stored(top, "top")
        if top.where("long").take(1):  # else the texts need not be read again
            top = top.join(long_values(df, top, by), ["column_name", "value", "long"], "left").withColumn("value", F.coalesce("text", "value")).drop("text")
    top = joined(top, totals.select(*by, "column_name", "total_rows"), [*by, "column_name"])
    return top.select(*by, "column_name", F.col("rank").cast("long").alias("rank"), "value", F.col("n").alias("count"), percentage(F.col("n"), F.col("total_rows")).alias("percentage"))


def long_values(df: DataFrame, top: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(column_name, value, long, text): the texts behind the digests among ``top``; few of them, so Spark broadcasts them as long as they are."""
    wanted = top.where("long").select("column_name", "value", "long").distinct()
    texts = unpivoted(df, {c: ref(c) for c in of_family(df, "text", list(by))}).where(F.length("v") > LONG_TEXT)
    rows = texts.select("column_name", F.sha2("v", 256).alias("value"), F.col("v").alias("text"))
    return rows.join(wanted, ["column_name", "value"]).groupBy("column_name", "value", "long").agg(F.min("text").alias("text"))


def entropy(freq: DataFrame, text_columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy (bits) and its share of log2(distinct) for text columns of 2 to ENTROPY_DISTINCT values."""
    size = distinct_counts(freq, by).where((F.col("distinct_count") > 1) & (F.col("distinct_count") <= ENTROPY_DISTINCT))
    rows = joined(freq.where(F.col("column_name").isin(*text_columns)), size, [*by, "column_name"], small=not by)
    p = F.col("n") / F.col("filled")
    out = rows.groupBy(*by, "column_name").agg((-F.sum(p * F.log2(p))).alias("entropy"), F.first("distinct_count").alias("d"))
    return out.select(*by, "column_name", "entropy", (F.col("entropy") / F.log2("d")).alias("normalized_entropy"))


def texts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, column_name, v): the non-null texts of all text columns, whole."""
    return unpivoted(df, {c: ref(c) for c in of_family(df, "text", list(by)) if columns is None or c in columns}, by)


def string_patterns(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per text column and string class: count and share of non-null values."""
    rows = texts(df, columns, by)
    kind = F.lit("mixed")
    for name, pattern in reversed(PATTERNS):
        kind = F.when(F.col("v").rlike(pattern), name).otherwise(kind)
    n = rows.groupBy(*by, "column_name", kind.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("percentage", percentage(F.col("count"), F.sum("count").over(Window.partitionBy(*by, "column_name"))))


def date_distribution(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), months: int = 12) -> DataFrame:
    """Counts of the ``months`` most recent months of each datetime column; share of all rows."""
    names = [c for c in of_family(df, "datetime", list(by)) if columns is None or c in columns]
    # a null date is the empty month, which counts towards all rows
    rows = unpivoted(df, {c: F.coalesce(F.date_format(F.date_trunc("month", ref(c)), "yyyy-MM"), F.lit("")) for c in names}, by)
    n = rows.groupBy(*by, "column_name", F.col("v").alias("period")).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*by, "column_name")
    n = n.withColumn("total", F.sum("count").over(w)).where("period <> ''").withColumn("rank", F.row_number().over(w.orderBy(F.col("period").desc())))
    return n.where(F.col("rank") <= months).select(*by, "column_name", "period", "count", percentage(F.col("count"), F.col("total")).alias("percentage"))


def numbers(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str]) -> DataFrame:
    """(by, column_name, v): the non-null numbers of all numeric columns."""
    return unpivoted(df, {c: ref(c) for c in of_family(df, "numeric", list(by)) if columns is None or c in columns}, by, "double")


def number_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """(by, column_name, v, n): how often each number occurs; from ``freq`` (of value_freq), which need not be shuffled again, if it is given."""
    key = [*by, "column_name"]
    if freq is None:
        return numbers(df, columns, by).groupBy(*key, (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    fields = [f for f in df.schema.fields if family(f.dataType) == "numeric" and f.name not in by and (columns is None or f.name in columns)]
    single = [f.name for f in fields if isinstance(f.dataType, T.FloatType)]  # their text is shorter than that of the same double
    v = F.when(F.col("column_name").isin(single), F.col("value").try_cast("float").cast("double")).otherwise(F.col("value").try_cast("double"))
    return freq.where(F.col("column_name").isin([f.name for f in fields])).select(*key, v.alias("v"), "n")


def percentiles(df: DataFrame, columns: Sequence[str] | None = None, at: Sequence[float] = PERCENTILES, by: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """Exact interpolated percentiles of numeric columns as p50, p75, ..., for each value of ``by``.

    Different values with their counts are range-sorted by (by, column, value), cumulated by partition, and only the
    neighbours of each rank are picked, so no task holds a column or a group. NaN is left out.
    """
    key = [*by, "column_name"]
    counts = number_counts(df, columns, by, freq).where(~F.isnan("v"))
    part = counts.repartitionByRange(*key, "v").sortWithinPartitions(*key, "v").withColumn("part", F.spark_partition_id())
    part = stored(part, "values")
    sums = part.groupBy(*key, "part").agg(F.sum("n").alias("s"))  # a row for each group and partition that holds some of it
    w = Window.partitionBy(*key)
    before = F.coalesce(F.sum("s").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*key, "part", before.alias("before"), F.sum("s").over(w).alias("all"))
    upto = F.sum("n").over(Window.partitionBy(*key, "part").orderBy("v"))
    rows = joined(part.withColumn("upto", upto), sums, [*key, "part"], small=not by).withColumn("upto", F.col("upto") + F.col("before"))
    picks, out = [], []
    for p in at:
        rank = F.lit(p) * (F.col("all") - 1)
        name = f"p{round(100 * p)}"
        for side, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.min(F.when(F.col("upto") > r, F.col("v"))).alias(f"{name}_{side}"))
        share = F.lit(p) * (F.col("all") - 1) - F.floor(F.lit(p) * (F.col("all") - 1))
        out.append((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * share).alias(name))
    return rows.groupBy(*key, "all").agg(*picks).select(*key, *out)


def approx_percentiles(df: DataFrame, columns: Sequence[str] | None = None, at: Sequence[float] = PERCENTILES, accuracy: int = 10_000, by: Sequence[str] = ()) -> DataFrame:
    found = numbers(df, columns, by).groupBy(*by, "column_name").agg(F.percentile_approx("v", list(at), accuracy).alias("q"))
    return found.select(*by, "column_name", *[F.col("q")[i].alias(f"p{round(100 * p)}") for i, p in enumerate(at)])


def _weighted(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str], freq: DataFrame | None) -> DataFrame:
    """(by, column_name, v, n): all numbers, each once if there are no counts."""
    return numbers(df, columns, by).withColumn("n", F.lit(1).cast("long")) if freq is None else number_counts(df, columns, by, freq)


def outliers(df: DataFrame, stats: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """Values further than three standard deviations from the mean; share of non-null values. ``stats`` as from column_stats."""
    s = stats.select(*by, "column_name", F.col("avg").alias("m"), "stddev")
    far = (F.col("stddev") > 0) & (F.abs(F.col("v") - F.col("m")) > 3 * F.col("stddev"))
    n = joined(_weighted(df, columns, by, freq), s, [*by, "column_name"], small=not by).groupBy(*by, "column_name").agg(F.coalesce(F.sum(F.when(far, F.col("n"))), F.lit(0)).alias("outlier_count"), F.sum("n").alias("filled"))
    return n.select(*by, "column_name", "outlier_count", percentage(F.col("outlier_count"), F.col("filled")).alias("outlier_percentage"))


def histogram(df: DataFrame, stats: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """Ten equal-width bins per numeric column, empty ones left out; one bin if all values are equal; share of the values in bins. NaN and infinity are in none and bound none."""
    s = stats.select(*by, "column_name", F.col("min_bin").alias("lo"), F.col("max_bin").alias("hi"))
    width = F.col("hi") - F.col("lo")
    bin_ = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / width * BINS))).otherwise(0).cast("long")
    n = joined(_weighted(df, columns, by, freq).where(finite(F.col("v")).isNotNull()), s, [*by, "column_name"], small=not by).groupBy(*by, "column_name", "lo", "hi", bin_.alias("bin")).agg(F.sum("n").alias("count"))
    upper = F.when((F.col("bin") == BINS - 1) | (width == 0), F.col("hi")).otherwise(F.col("lo") + width * (F.col("bin") + 1) / BINS)
    share = percentage(F.col("count"), F.sum("count").over(Window.partitionBy(*by, "column_name")))
    return n.select(*by, "column_name", "bin", (F.col("lo") + width * F.col("bin") / BINS).alias("lower"), upper.alias("upper"), "count", share.alias("percentage"))


def correlations(df: DataFrame, columns: Sequence[str] | None = None, cap: int = CORRELATED_COLUMNS) -> DataFrame:
    """Pearson coefficient of every pair of the numeric columns, over rows where both are there; none if there are over ``cap``, or one side is constant."""
    names = [c for c in of_family(df, "numeric") if columns is None or c in columns]
    schema = "column_a string, column_b string, coefficient double"
    if not 2 <= len(names) <= cap:
        return df.sparkSession.createDataFrame([], schema)
    # a row for each pair, added up before the shuffle; corr leaves out rows where one side is null
    number = {c: ref(c).cast("double") for c in names}
    pairs = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), number[a].alias("x"), number[b].alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = df.select(F.inline(F.array(*pairs)))
    return rows.groupBy("column_a", "column_b").agg(F.corr("x", "y").alias("coefficient")).where("coefficient is not null and not isnan(coefficient)")


def duplicate_rows(df: DataFrame, by: Sequence[str] = (), fingerprint: bool = False) -> DataFrame:
    """Rows beyond the first of each equal row (nulls are equal), and their share; ``fingerprint`` groups by two 64-bit hashes instead of the row."""
    cols = row_values(df, by)
    key = [F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)] if fingerprint else cols
    n = df.groupBy(*[ref(b).alias(b) for b in by], *[c.alias(f"_{i}") for i, c in enumerate(key)]).agg(F.count(F.lit(1)).alias("_n"))
    n = (n.groupBy(*by) if by else n).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"))
    return n.select(*by, "total_rows", "duplicate_rows", percentage(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"))


def approx_distinct(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """HyperLogLog++ distinct counts of all columns in one pass."""
    fields = _columns(df, columns, ())
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.approx_count_distinct(as_text(f.name, f.dataType), rsd).alias("approx_distinct_count")) for f in fields]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
