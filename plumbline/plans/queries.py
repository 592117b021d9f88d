"""The registered queries of the profiling library and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import decimals
from plumbline.operators import drift, links, pii, quality, states, stats, topk
from plumbline.plans import document, incremental, inputs
from plumbline.plans.profile import column_profiles, profile_table, run_profile
from plumbline.sources import history
from plumbline.sources.tables import discover_columns, exact_sample, keyed_sample, open_table, shared_dir, stored

Query = Callable[[SparkSession, str], DataFrame]

_PERCENTILES = ("p50", "p75", "p90", "p95", "p99")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return open_table(spark, "parquet", f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql, t=_table(spark, sf_dir, table))


def _as_of() -> Column:
    return F.lit(inputs.AS_OF).cast("timestamp_ntz")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _tagged(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("table_name"), "*")
        out = df if out is None else out.unionByName(df)
    return out


def discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of orders and lineitem, and how far each is filled."""
    out = []
    for t in ("orders", "lineitem"):
        df = _table(spark, sf_dir, t)
        out.append((t, discover_columns(df).join(stats.column_stats(df, groups=()).select("column_name", "total_rows", "null_count"), "column_name")))
    return _rounded(_tagged(out))


def completeness(df: DataFrame) -> DataFrame:
    p = stats.column_stats(df, groups=()).join(stats.distinct_by_hash(df), "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    pct = F.when(F.col("total_rows") > 0, 100.0 * F.col("distinct_count") / F.col("total_rows")).otherwise(0.0)
    return p.select("column_name", "total_rows", "null_count", "null_percentage", "distinct_count", pct.alias("distinct_percentage"))


def column_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(completeness(_table(spark, sf_dir, "lineitem")))


def text_blank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.column_stats(_derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders"), ["name", "constant_col"])
    return _rounded(s.select("column_name", "total_rows", "empty_count", "whitespace_count", "min_length", "max_length", "avg_length"))


def numeric_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("dirty_orders", _derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders")), ("lineitem", _table(spark, sf_dir, "lineitem"))]
    rows = _tagged([(n, stats.column_stats(df).where("family = 'numeric'")) for n, df in parts])
    return _rounded(rows.select("table_name", "column_name", "min_num", "max_num", "avg", "sum", "zero_count"), 2)


def numeric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.column_stats(_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _rounded(s.select("column_name", "variance", "stddev", "skewness", "kurtosis"), 4)


def numeric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tagged([(t, stats.percentiles(_table(spark, sf_dir, t), c)) for t, c in (("lineitem", ["l_quantity", "l_extendedprice", "l_discount"]), ("events", ["value"]))]), 4)


def numeric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, df, c in (("events", _table(spark, sf_dir, "events"), ["value"]), ("dirty_orders", _derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders"), ["amount", "score"])):
        out.append((name, stats.outliers(df, stats.column_stats(df, c), c)))
    return _rounded(_tagged(out))


def numeric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return _rounded(stats.histogram(df, stats.column_stats(df), ["o_totalprice", "o_custkey"]), 4)


def datetime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, c in (("orders", "o_orderdate"), ("events", "ts")):
        s = stats.column_stats(_table(spark, sf_dir, name), [c], as_of=_as_of())
        out.append((name, s.select("column_name", F.col("min").cast("timestamp_ntz").alias("min_ts"), F.col("max").cast("timestamp_ntz").alias("max_ts"), "future_date_count", "future_date_percentage", "date_range_days")))
    return _rounded(_tagged(out))


def date_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.date_distribution(_table(spark, sf_dir, "orders")))


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, cols in (("events", ["event_type", "user_id"]), ("part", ["p_brand", "p_type", "p_size"]), ("documents", ["text"])):
        df = _table(spark, sf_dir, name)
        out.append((name, stats.top_values(stats.value_freq(df, cols), stats.column_stats(df, cols, groups=()), df)))
    return _rounded(_tagged(out))


def string_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_tagged([("pages", stats.string_patterns(_table(spark, sf_dir, "pages"), ["url"])), ("contacts", stats.string_patterns(_derived(spark, sf_dir, inputs.DIRTY_CONTACTS, "customer")))]))


def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, cols in (("orders", ["o_orderpriority", "o_orderstatus"]), ("part", ["p_brand", "p_type", "p_name"])):
        out.append((name, stats.entropy(stats.value_freq(_table(spark, sf_dir, name), cols), cols)))
    return _rounded(_tagged(out))


def numeric_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlations(_table(spark, sf_dir, "lineitem")))


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.duplicate_rows(_derived(spark, sf_dir, inputs.DIRTY_DUPS, "orders")))


def duplicate_rows_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.duplicate_rows(_derived(spark, sf_dir, inputs.DIRTY_DUPS, "orders"), fingerprint=True))


def keyed_sample_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by a key hash that both engines know."""
    return _rounded(completeness(keyed_sample(_table(spark, sf_dir, "orders"), ["o_orderkey"], 0.1, F.col("o_orderkey") * 7919)))


def pii_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _tagged([(t, discover_columns(_table(spark, sf_dir, t))) for t in ("customer", "supplier", "part", "lineitem")])
    return names.select("table_name", "column_name", pii.header_label(F.col("column_name")).alias("label")).where("label is not null")


def _contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = _derived(spark, sf_dir, inputs.DIRTY_CONTACTS, "customer")
    base = stats.column_stats(df)
    return base, stats.top_values(stats.value_freq(df), base, df)


def pii_value_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all values, not the top ten; whole texts, which are not shuffled."""
    df = _derived(spark, sf_dir, inputs.DIRTY_CONTACTS, "customer")
    return _rounded(pii.column_ratios(df, ["contact", "reach", "payment_value", "host", "doc", "token", "segment"]))


def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, top = _contacts(spark, sf_dir)
    return _rounded(pii.detect(base, top))


def masked_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, top = _contacts(spark, sf_dir)
    return _rounded(pii.masked(top, pii.detect(base, top)).select("column_name", "rank", "value", "count"))


def _checked(spark: SparkSession, sf_dir: str, rules: quality.QualityRules) -> DataFrame:
    df = _derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders")
    return quality.checks(column_profiles(df, as_of=_as_of(), tier="standard"), stats.duplicate_rows(df), rules)


RULES = quality.QualityRules(max_null=5.0, high_cardinality=60.0, dominant_value=15.0, allow_empty=True, allow_whitespace=True)


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_checked(spark, sf_dir, quality.QualityRules()))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_checked(spark, sf_dir, quality.QualityRules()))


def quality_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_checked(spark, sf_dir, RULES))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot for each year of orders, made on the first of January after: column profiles, and tables with score and duplicates. All years in one pass."""
    df = _derived(spark, sf_dir, inputs.DIRTY_YEARS, "orders")
    made = F.make_timestamp_ntz(F.col("y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    tag = {"schema_name": F.lit("s"), "table_name": F.lit("orders"), "snapshot_id": F.col("y").cast("string"), "created_at": made}
    columns = stored(column_profiles(df, by=["y"], as_of=made, tier="standard"), "columns")
    dup = stored(stats.duplicate_rows(df, ["y"]), "duplicates")
    tables = dup.join(quality.score(quality.checks(columns, dup, by=["y"]), ["y"]), "y")
    return columns.withColumns(tag), tables.withColumns(tag)


def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = history.history(_snapshots(spark, sf_dir)[1], 3)
    return _rounded(t.select("schema_name", "table_name", "snapshot_id", "created_at", "rank", "total_rows", "score"))


def snapshot_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = history.latest(_snapshots(spark, sf_dir)[1])
    return _rounded(t.select("schema_name", "table_name", "snapshot_id", "created_at", "total_rows", "score"))


def snapshot_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots saved as a table and loaded again, once as they are and once as JSON documents: the newest of each table before a time."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    tables = _snapshots(spark, sf_dir)[1]
    history.save(tables, f"{path}/tables")
    history.save(history.to_json(tables, "schema_name", "table_name"), f"{path}/json")
    loaded = history.load(spark, f"{path}/tables")
    parsed = history.from_json(history.load(spark, f"{path}/json"), tables)
    out = []
    for name, rows in (("table", loaded), ("json", parsed)):
        rows = history.previous(rows, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"))
        out.append((name, rows.select(F.col("snapshot_id"), "created_at", "total_rows", "duplicate_rows", "score")))
    return _rounded(_tagged(out))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Checks and drift of a second run over a table that has changed since the first."""
    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    for i, sql in enumerate((inputs.STATE_1, inputs.STATE_2), 1):
        out = run_profile(_derived(spark, sf_dir, sql, "customer"), "s", "t", str(i), F.lit(f"1999-06-0{i} 00:00:00").cast("timestamp_ntz"), path)
    return out


def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_runs(spark, sf_dir)[0])


def run_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eleven kinds of change; numbers rounded, types and labels as they are."""
    c = _runs(spark, sf_dir)[1]
    shown = lambda v: F.coalesce(decimals(F.col(v).try_cast("double"), 4), F.col(v))
    return c.select("column_name", "kind", "severity", shown("old_value").alias("old_value"), shown("new_value").alias("new_value"))


def pii_headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that name a kind of personal data, backed by their values or not."""
    df = _derived(spark, sf_dir, inputs.HEADED, "customer")
    base = stats.column_stats(df, groups=())
    return _rounded(pii.detect(base, stats.top_values(stats.value_freq(df), base, df)))


def basic_tier_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic tier over chosen columns: no outliers, entropy or percentiles."""
    p = column_profiles(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"], as_of=_as_of(), tier="basic")
    return _rounded(p.select("column_name", "data_type", "total_rows", "null_count", "distinct_count", "distinct_percentage", "top_percentage", "avg", "stddev", F.lit("entropy" in p.columns or "p50" in p.columns).alias("more")), 3)


def drift_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes of all consecutive snapshots."""
    c = drift.changes(*_snapshots(spark, sf_dir))
    return c.select("snapshot_id", "column_name", "kind", "severity", F.round(F.col("old_value").cast("double"), 4).alias("old_value"), F.round(F.col("new_value").cast("double"), 4).alias("new_value"))


def drift_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the newest snapshot."""
    columns, tables = _snapshots(spark, sf_dir)
    new = history.latest(tables).select("schema_name", "table_name", "snapshot_id")
    c = drift.changes(columns, tables).join(F.broadcast(new), ["schema_name", "table_name", "snapshot_id"], "left_semi")
    return c.select("snapshot_id", "column_name", "kind", "severity", F.round(F.col("old_value").cast("double"), 4).alias("old_value"), F.round(F.col("new_value").cast("double"), 4).alias("new_value"))


def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, tables = _snapshots(spark, sf_dir)
    r = drift.reports(drift.changes(columns, tables), tables)
    return r.select("snapshot_id", "changed", "score_delta", F.size("column_changes").cast("long").alias("n_changes"))


LINKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "customer", "c_custkey"))


def fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for child, c, parent, p in LINKS:
        row = links.check_link(_table(spark, sf_dir, child), c, _table(spark, sf_dir, parent), p).select(F.lit(f"{child}.{c}").alias("child"), F.lit(f"{parent}.{p}").alias("parent"), "*")
        out = row if out is None else out.unionByName(row)
    return _rounded(out)


FK_TABLES = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"]}


def fk_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.discover_links({t: _table(spark, sf_dir, t).select(*c) for t, c in FK_TABLES.items()})


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimates to one digit beside the exact counts that they come close to, within a tenth; else the estimate itself."""
    df = _table(spark, sf_dir, "lineitem")
    exact = stats.distinct_counts(stats.value_freq(df)).select("column_name", "distinct_count")
    met = stats.approx_distinct(df).join(exact, "column_name")
    near = F.abs(F.col("approx_distinct_count") - F.col("distinct_count")) <= 0.1 * F.col("distinct_count")
    return met.select("column_name", F.when(near, F.col("distinct_count")).otherwise(F.col("approx_distinct_count")).alias("distinct_count"))


def approx_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch's percentiles at an accuracy that makes them values at the exact ranks."""
    df = _table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).cast("int").alias("thousands"))
    return _rounded(stats.approx_percentiles(df, accuracy=1_000_000_000).select("column_name", *_PERCENTILES))


def profile_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each day of events, merged per event type without reading the rows again."""
    df = _table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "value", "user_id")
    merged = states.merge_states(states.partial_states(df, ["day", "event_type"]), ["event_type"])
    exact = stats.distinct_counts(stats.value_freq(df.select("event_type", "value", "user_id"), by=["event_type"]), ["event_type"]).select("event_type", "column_name", "distinct_count")
    met = merged.join(exact, ["event_type", "column_name"])
    near = F.abs(F.col("approx_distinct_count") - F.col("distinct_count")) <= 0.1 * F.col("distinct_count")
    return _rounded(met.select("event_type", "column_name", "total_rows", "null_count", "avg", "sum", F.col("variance"), "min_num", "max_num", F.when(near, F.col("distinct_count")).otherwise(F.col("approx_distinct_count")).alias("distinct_count")), 2)


PROFILED = ("column_name", "data_type", "total_rows", "null_count", "distinct_count", "distinct_percentage", "top_percentage", "min_length", "max_length", "avg", "stddev", "p50", "p99", "outlier_count", "entropy", "pii", "pii_confidence")


def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile_table(_table(spark, sf_dir, "lineitem"), as_of=_as_of()).columns.select(*PROFILED), 3)


def percentiles_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the values of each type of event."""
    return _rounded(stats.percentiles(_table(spark, sf_dir, "events").select("event_type", "value"), by=["event_type"]).drop("column_name"), 4)


def kll_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from KLL sketches of the months of lineitem: the exact value where the estimate's rank is within the error, else the estimate."""
    df = _table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_quantity", "l_partkey")
    merged = stored(states.merge_states(states.partial_states(df, ["month"])), "merged")
    rows = df.drop("month")
    exact = stats.percentiles(rows)
    exact = exact.select("column_name", F.inline(F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(p).alias("exact")) for p in _PERCENTILES])))
    met = states.rank_errors(rows, merged).join(exact, ["column_name", "percentile"])
    return _rounded(met.select("column_name", "percentile", F.when(F.col("rank_error") <= states.RANK_ERROR, F.col("exact")).otherwise(F.col("estimate")).alias("value")), 4)


def heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent values, by summary and second scan where that proves them."""
    out = [(t, topk.heavy_hitters(_table(spark, sf_dir, t), cols, exact=True).drop("proven")) for t, cols in (("events", ["event_type", "user_id", "event_id"]), ("part", ["p_brand", "p_type", "p_size"]), ("documents", ["lang", "text"]))]
    return _rounded(_tagged(out))


def exact_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand orders by a hash of their keys that both engines know."""
    df = _table(spark, sf_dir, "orders")
    return _rounded(exact_sample(df, 1000, ["o_orderkey"], hashed=F.col("o_orderkey") * 7919 % 1000003).select("o_orderkey", "o_custkey", "o_totalprice"), 2)


def basic_tier_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic tier where values are counted only of columns with up to 500 different ones; estimates within a tenth show the exact count, as in approx_distinct, and top values of under a hundredth are left out."""
    df = _table(spark, sf_dir, "lineitem")
    p = column_profiles(df, as_of=_as_of(), tier="basic", counted=500)
    exact = stats.distinct_counts(stats.value_freq(df)).select("column_name", F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.1 * F.col("exact")
    return _rounded(p.join(exact, "column_name").select("column_name", "total_rows", "null_count", F.when(near, F.col("exact")).otherwise(F.col("distinct_count")).alias("distinct_count"), "distinct_exact", F.when(F.col("top_percentage") >= 1, F.col("top_percentage")).otherwise(0.0).alias("top_percentage")), 3)


def profile_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of one profile as rows (part, column_name, item, amount): columns, duplicates, top values, patterns, histograms, months, correlations and links."""
    df = _derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders")
    found = links.discover_links({"orders": df.select("id", "score"), "nation": _table(spark, sf_dir, "nation")})
    declared = links.declared_links(found.select(F.col("child_column").alias("column_name"), F.lit("s").alias("target_schema"), F.col("parent_table").alias("target_table"), F.col("parent_column").alias("target_column")).where("target_table = 'nation'"))
    p = profile_table(df, as_of=_as_of(), relationships=declared)
    row = lambda part, rows, item, amount, name="column_name": rows.select(F.lit(part).alias("part"), F.col(name).alias("column_name"), item.cast("string").alias("item"), amount.cast("double").alias("amount"))
    c = F.col
    ends = [row(x, p.columns.where("column_name in ('id', 'score', 'created_at')"), c(x), c("total_rows")) for x in ("min", "max")]
    counts = [row(x, p.columns, F.lit("count"), c(x)) for x in ("total_rows", "null_count", "distinct_count")]
    tops = row("top_values", p.top_values.where("column_name <> 'amount'"), F.concat_ws(":", c("rank").cast("string"), c("value")), c("count"))
    rest = [
        tops, row("patterns", p.patterns, c("pattern"), c("count")), row("histograms", p.histograms, c("bin"), c("count")), row("dates", p.dates, c("period"), c("count")),
        row("correlations", p.correlations, c("column_b"), c("coefficient"), "column_a"), row("links", p.links, c("target_column"), F.lit(1)), row("duplicates", p.duplicates.withColumn("x", F.lit("")), F.lit("rows"), c("duplicate_rows"), "x"),
    ]
    out = None
    for part in (*ends, *counts, *rest):
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


def snapshot_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots, of which the first crashed once before its parts were whole and was then run twice: figures of what is there, a row for each."""
    path = f"{shared_dir(spark)}/retried-{uuid.uuid4().hex}"
    states_ = [_derived(spark, sf_dir, sql, "customer") for sql in (inputs.STATE_1, inputs.STATE_2)]
    made = [F.lit(f"1999-06-0{i} 00:00:00").cast("timestamp_ntz") for i in (1, 2)]
    history.stage({"checks": states_[0].select(F.lit("left by a crash").alias("name"))}, path, "s", "t", "1", made[0])
    for i in (0, 0, 1):
        run_profile(states_[i], "s", "t", str(i + 1), made[i], path)
    part = lambda name: history.load_part(spark, path, name)
    n = lambda name: part(name).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    out = part("tables").select("snapshot_id", "total_rows", "duplicate_rows", "score")
    for name in ("columns", "checks", "top_values"):
        out = out.join(n(name), "snapshot_id")
    return _rounded(out)


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved profile as one nested JSON document, read back: figures of each column's lists."""
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    df = _derived(spark, sf_dir, inputs.DIRTY_ORDERS, "orders")
    run_profile(df, "s", "orders", "1", _as_of(), path)
    parts = {n: history.load_part(spark, path, n) for n in ("columns", "tables", *document.PER_COLUMN, *document.PER_TABLE)}
    docs = stored(document.documents(parts), "documents")
    back = document.parsed(docs, document.document_schema(parts))
    total = lambda part: back[part].groupBy("column_name").agg(F.count(F.lit(1)).alias(f"n_{part}"), F.sum("count").alias(f"sum_{part}"))
    out = back["columns"].select("snapshot_id", "column_name", "total_rows", "null_count", "distinct_count")
    for part in document.PER_COLUMN:
        out = out.join(total(part), "column_name", "left")
    return _rounded(out.join(back["tables"].select("snapshot_id", "score"), "snapshot_id"))


def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, profiled, then again after the first day's values have changed: the merged profile, and what the second run read."""
    base = f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex}"
    df = _table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "user_id", "event_type", "value")
    df.repartition("day").write.partitionBy("day").parquet(f"{base}/events")
    read = lambda: spark.read.parquet(f"{base}/events")
    incremental.profile(read(), ["day"], f"{base}/states", "events")
    day = df.agg(F.min("day")).first()[0]
    changed = stored(df.where(F.col("day") == day).withColumn("value", F.col("value") + 1000), "changed")
    changed.drop("day").write.mode("overwrite").parquet(f"{base}/events/day={day}")
    run = incremental.profile(read(), ["day"], f"{base}/states", "events")
    exact = stats.distinct_counts(stats.value_freq(read().drop("day"))).select("column_name", F.col("distinct_count").alias("exact"))
    met = run.columns.join(exact, "column_name")
    near = F.abs(F.col("approx_distinct_count") - F.col("exact")) <= 0.1 * F.col("exact")
    shown = ("column_name", "total_rows", "null_count", "avg", "variance", "skewness", "kurtosis", "min_num", "max_num", "zero_count", "min_length", "max_length", "avg_length", "date_range_days")
    return _rounded(met.select(*shown, F.when(near, F.col("exact")).otherwise(F.col("approx_distinct_count")).alias("distinct_count"), F.lit(run.parts_read).cast("long").alias("parts_read"), F.lit(run.rows_read).cast("long").alias("rows_read")), 4)


KEYED = {"region": 2, "nation": 2, "customer": 2, "orders": 2, "lineitem": 2, "events": 2, "conversations": 2, "labels": 2}


def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least unique sets of up to two columns."""
    out = _tagged([(t, links.unique_keys(_table(spark, sf_dir, t), n)) for t, n in KEYED.items()])
    return _rounded(out.select("table_name", F.array_join("key_columns", ",").alias("key_columns"), "n_columns"))


ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def fk_discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between all integer and text columns of all tables."""
    return links.discover_links({t: _table(spark, sf_dir, t) for t in ALL_TABLES})


def composite_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pairs of customer and status in orders are among those of the orders with an even key, and how many rows are orphans."""
    orders = _table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderstatus"]
    return _rounded(links.check_link(orders, keys, orders.where("o_orderkey % 2 = 0"), keys))


def queries() -> dict[str, Query]:
    every = (
        discover, column_completeness, text_blank_stats, numeric_basic, numeric_moments, numeric_percentiles, numeric_outliers, numeric_histogram, datetime_stats, date_distribution, top_values, string_patterns, text_entropy,
        numeric_correlations, duplicate_rows, duplicate_rows_fingerprint, keyed_sample_profile, pii_header, pii_value_ratio, pii_detect, masked_top_values, quality_checks, quality_score, quality_custom_rules, snapshot_history, snapshot_latest, snapshot_previous, run_checks, run_drift, pii_headed, basic_tier_columns,
        drift_history, drift_changes, drift_report, fk_check, fk_discover, approx_distinct, approx_percentiles, profile_by_partition, profile_lineitem,
        percentiles_by_group, kll_percentiles, heavy_hitters, exact_size_sample, basic_tier_estimated, profile_all_parts, snapshot_retried, profile_documents, incremental_profile, unique_keys, fk_discover_all, composite_link,
    )
    return {("discover_columns" if f is discover else f.__name__): f for f in every}
