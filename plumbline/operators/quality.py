"""Quality checks and score from column profiles; works for any number of tables at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import likely_key, percentage


@dataclass(frozen=True)
class QualityRules:
    """Thresholds in percent; one outside 0 to 100 falls back to its default."""

    max_null: float = 20.0
    high_cardinality: float = 95.0
    dominant_value: float = 80.0
    allow_empty: bool = False
    allow_whitespace: bool = False

    def threshold(self, name: str) -> float:
        value = getattr(self, name)
        return float(value if 0 <= value <= 100 else QualityRules.__dataclass_fields__[name].default)


def _check(when: Column, name: str, passed: Column, severity: Column | str, metric: str, threshold: float | None, actual: Column, points: Column | int, per_column: bool = True) -> Column:
    label = F.concat(F.lit(name + ":"), F.col("column_name")) if per_column else F.lit(name)
    return F.when(
        when,
        F.struct(
            label.alias("name"), passed.alias("passed"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(metric).alias("metric"),
            F.lit(threshold).cast("double").alias("threshold"), actual.cast("double").alias("actual"), (F.lit(points) if isinstance(points, int) else points).cast("long").alias("points"),
        ),
    )


def checks(profiles: DataFrame, duplicates: DataFrame, rules: QualityRules = QualityRules(), by: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """(by, name, passed, severity, metric, threshold, actual, points): all checks of column profiles and of (by, duplicate_rows); points are what each takes off the score."""
    c = F.col
    total, yes, no = c("total_rows"), F.lit(True), F.lit(False)
    null_ok = c("null_percentage") <= rules.threshold("max_null")
    unique = (total > 0) & (c("distinct_count") == total)
    passing = lambda ok: F.when(ok, "pass").otherwise("fail")
    text = c("family") == "text"
    blank = lambda n: F.when(c(n) == 0, "pass").otherwise("warn")
    filled = total - c("null_count")
    rows = [
        _check(yes, "completeness", null_ok, passing(null_ok), "null_percentage", rules.threshold("max_null"), c("null_percentage"), F.when(null_ok, 0).otherwise(10)),
        _check(likely_key(c("column_name")), "uniqueness", unique, passing(unique), "distinct_percentage", 100.0, c("distinct_percentage"), F.when(unique, 0).otherwise(5)),
        _check((total > 0) & (c("distinct_count") <= 1), "constant", no, "warn", "distinct_count", 1.0, c("distinct_count"), 0),
        _check((total > 0) & (c("distinct_percentage") >= rules.threshold("high_cardinality")) & ~likely_key(c("column_name")), "high_cardinality", yes, "info", "distinct_percentage", rules.threshold("high_cardinality"), c("distinct_percentage"), 0),
        _check(c("top_percentage") >= rules.threshold("dominant_value"), "dominant_value", yes, "info", "top_value_percentage", rules.threshold("dominant_value"), c("top_percentage"), 0),
        _check(text, "empty", (c("empty_count") == 0) | rules.allow_empty, blank("empty_count"), "empty_count", 0.0, c("empty_count"), F.when((c("empty_count") > 0) & (not rules.allow_empty), 3).otherwise(0)),
        _check(text, "whitespace", (c("whitespace_count") == 0) | rules.allow_whitespace, blank("whitespace_count"), "whitespace_count", 0.0, c("whitespace_count"), F.when((c("whitespace_count") > 0) & (not rules.allow_whitespace), 2).otherwise(0)),
        _check((c("family") == "numeric") & (c("outlier_count") > 0), "outliers", yes, "warn", "outlier_percentage", None, c("outlier_percentage"), 0),
        _check((c("family") == "datetime") & (c("future_date_count") > 0), "future_dates", no, "warn", "future_date_count", 0.0, c("future_date_count"), 3),
        _check((c("family") == "numeric") & (c("zero_count") > 0), "zero_values", yes, "info", "zero_percentage", None, percentage(c("zero_count"), filled), 0),
    ]
    per_column = profiles.select(*by, F.explode(F.array_compact(F.array(*rows))).alias("k")).select(*by, "k.*")
    dup = _check(c("duplicate_rows") > 0, "duplicate_rows", no, "warn", "duplicate_rows", 0.0, c("duplicate_rows"), 5, per_column=False)
    return per_column.unionByName(duplicates.select(*by, F.explode(F.array_compact(F.array(dup))).alias("k")).select(*by, "k.*"))


def score(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, score): 100 less the points of all checks, at least 0."""
    grouped = checked.groupBy(*by) if by else checked
    return grouped.agg(F.greatest(F.lit(0).cast("long"), 100 - F.coalesce(F.sum("points"), F.lit(0))).cast("double").alias("score"))
