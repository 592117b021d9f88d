"""Most frequent values without counting all values.

A mergeable summary of bounded size, made in one scan, names candidates for each column; a second scan counts only these,
joined by broadcast (their number is bounded). The summary's error bounds what any value that is no candidate can
occur, so the counts of the candidates either prove the top values or show for which columns all values have to be counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import as_text, percentage, unpivoted
from plumbline.operators import stats
from plumbline.sources.tables import stored

#: Values a summary tracks, and candidates it names.
TRACKED, CANDIDATES = 4096, 128


def _items(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """(column_name, item, value, long): non-null values as text, a long one by its digest; an item tells the two apart."""
    rows = unpivoted(df, {f.name: as_text(f.name, f.dataType) for f in df.schema.fields if columns is None or f.name in columns})
    long = F.length("v") > stats.LONG_TEXT
    value = F.when(long, F.sha2("v", 256)).otherwise(F.col("v"))
    return rows.select("column_name", F.concat(F.when(long, "L").otherwise("S"), value).alias("item"))


def candidates(df: DataFrame, columns: Sequence[str] | None = None, tracked: int = TRACKED, named: int = CANDIDATES) -> DataFrame:
    """(column_name, item, value, long, n, bound): the named values with exact counts; no other value of the column occurs more than ``bound`` times.

    A tracked value's true count lies between its lower and upper estimate, which differ by at most 3.5 / tracked of all
    values; the summary names those whose lower estimate exceeds that difference, most frequent first.
    """
    items = _items(df, columns)
    summary = items.groupBy("column_name").agg(F.count(F.lit(1)).alias("filled"), F.call_function("approx_top_k", F.col("item"), F.lit(named), F.lit(tracked)).alias("top"))
    summary = stored(summary, "summary")
    error = F.ceil(2 * 3.5 * F.col("filled") / tracked)
    least = F.when(F.size("top") >= named, F.array_min(F.transform("top", lambda x: x["count"]))).otherwise(F.lit(0))
    named_ = summary.select("column_name", "filled", F.greatest(error, least).alias("bound"), F.explode("top").alias("t")).select("column_name", "filled", "bound", "t.item")
    counted = items.join(F.broadcast(named_.select("column_name", "item")), ["column_name", "item"]).groupBy("column_name", "item").agg(F.count(F.lit(1)).alias("n"))
    found = named_.join(counted, ["column_name", "item"])
    # candidates that make up all the values leave none to bound
    whole = F.sum("n").over(Window.partitionBy("column_name")) == F.col("filled")
    return found.select("column_name", "item", F.substring("item", 2, 1 << 30).alias("value"), F.col("item").startswith("L").alias("long"), "n", F.when(whole, F.lit(0)).otherwise(F.col("bound")).cast("long").alias("bound"))


def heavy_hitters(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10, tracked: int = TRACKED, exact: bool = False) -> DataFrame:
    """(column_name, rank, value, count, percentage, proven): the ``k`` most frequent values, as ``stats.top_values`` gives them.

    Without ``exact`` only values that the summary proves to be among them are there, perhaps none (each value above
    2 * 3.5 / tracked of a column is); with it, columns whose top the summary cannot prove are counted by value, and
    ``proven`` says which were not.
    """
    seen = stored(candidates(df, columns, tracked), "candidates")
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    sure = seen.where(F.col("n") > F.col("bound")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    top = sure.select("column_name", "value", "long", "n", "rank", F.lit(True).alias("proven"))
    if exact:
        whole = seen.groupBy("column_name").agg(((F.count_if(F.col("n") > F.col("bound")) >= k) | (F.max("bound") == 0)).alias("whole")).where("whole").select("column_name")
        names = {r["column_name"] for r in whole.collect()}  # a row for each column
        rest = [c for c in df.columns if c not in names and (columns is None or c in columns)]
        top = top.where(F.col("column_name").isin(list(names)))
        if rest:
            freq = stats.value_freq(df, rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            top = top.unionByName(freq.select("column_name", "value", "long", "n", "rank", F.lit(False).alias("proven")))
    top = stored(top, "top")
    if top.where("long").take(1):
        top = top.join(stats.long_values(df, top), ["column_name", "value", "long"], "left").withColumn("value", F.coalesce("text", "value")).drop("text")
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    top = top.crossJoin(F.broadcast(total))  # one row
    return top.select("column_name", F.col("rank").cast("long").alias("rank"), "value", F.col("n").alias("count"), percentage(F.col("n"), F.col("total_rows")).alias("percentage"), "proven")
