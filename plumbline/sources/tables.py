"""Reading tables, sampling them, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.columns import ref, row_values

FILE_FORMATS = ("parquet", "orc", "json", "csv")
#: Source names and the URL scheme of each.
JDBC = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "sqlserver": "sqlserver", "derby": "derby"}


def open_table(spark: SparkSession, kind: str, location: str, table: str = "", *, partition_column: str = "", bounds: tuple[int, int] = (0, 0), partitions: int = 4, **options: str) -> DataFrame:
    """A table as a DataFrame: a file format with a path, ``table`` (catalog), or a JDBC source with a URL and a table name.

    A JDBC table is read in ``partitions`` parts if a partition column and its bounds are given; else in one task.
    """
    kind = kind.lower()
    if kind in FILE_FORMATS:
        return spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options).format(kind).load(location)
    if kind == "table":
        return spark.table(location)
    if kind in JDBC or location.startswith("jdbc:"):
        parts = {"partitionColumn": partition_column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)} if partition_column else {}
        url = location if location.startswith("jdbc:") else f"jdbc:{JDBC[kind]}:{location}"
        return spark.read.format("jdbc").options(url=url, dbtable=table, **parts, **options).load()
    if kind == "snowflake":
        raise ValueError("snowflake needs its own connector; read the table with it and pass the DataFrame")
    raise ValueError(f"unknown source type: {kind}")


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of the base tables of a catalog's database: no views, no temporary ones."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW")


def list_jdbc_tables(catalogue: DataFrame, schema_name: str) -> DataFrame:
    """(table_schema, table_name) of the base tables of a schema, from a database's information_schema.tables as ``open_table`` reads it."""
    return catalogue.where((F.col("table_schema") == schema_name) & (F.col("table_type") == "BASE TABLE")).select("table_schema", "table_name")


def discover_columns(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, nullable)."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, nullable boolean")


def sample_rows(df: DataFrame, size: int, total: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows, at most that many; all rows if size is not positive or not below total."""
    if size <= 0 or total <= size:
        return df
    return df.sample(False, min(1.0, size / total), seed).limit(size)


#: Rows of one range of hashes that are ranked in one task.
RANKED = 100_000


def exact_sample(df: DataFrame, size: int, keys: Sequence[str] = (), seed: int = 42, hashed: Column | None = None) -> DataFrame:
    """Exactly ``size`` rows (all, if there are no more): those with the least hashes of ``keys`` (all columns if none are given), so the same rows on any run and partitioning.

    The hash that bounds the sample is found from counts by ranges of hashes, of 2^16 ranges at a time, until a range holds
    few enough rows to be ranked in a task; the rows are then filtered, not sorted. Rows of equal keys go by a hash of all
    columns; rows equal in all are counted. ``hashed`` takes the place of the hash of the keys, say to agree with another engine.
    """
    if size <= 0:
        return df
    every = row_values(df)
    hashes = {"_h0": F.xxhash64(F.lit(seed), *([ref(k) for k in keys] or every)) if hashed is None else hashed.cast("long"), "_h1": F.xxhash64(F.lit(seed + 1), *every)}
    rows = df.withColumns(hashes)
    known = stored(rows.select("_h0", "_h1"), "hashes")
    inside, missing, taken = known, size, F.lit(False)  # of the rows that may lie on the bound, so many are still to take
    edge = F.lit(True)
    for h in hashes:
        for shift in (48, 32, 16, 0):
            ranges = inside.groupBy(F.shiftright(h, shift).alias("r")).agg(F.count(F.lit(1)).alias("n"))  # at most 2^16 ranges
            upto = F.sum("n").over(Window.orderBy("r"))
            bound = ranges.withColumn("upto", upto).where(F.col("upto") >= missing).orderBy("r").first()
            if bound is None:
                return df
            here = F.shiftright(h, shift)
            taken = taken | (edge & (here < bound["r"]))
            edge = edge & (here == bound["r"])
            inside, missing = inside.where(here == bound["r"]), missing - (bound["upto"] - bound["n"])
            if bound["n"] == missing:
                return rows.where(taken | edge).drop(*hashes)
            if bound["n"] <= RANKED and inside.distinct().count() == bound["n"]:
                last = inside.orderBy("_h0", "_h1").limit(missing).agg(F.max(F.struct("_h0", "_h1")).alias("x")).first()["x"]
                at_most = (F.col("_h0") < last["_h0"]) | (F.col("_h0") == last["_h0"]) & (F.col("_h1") <= last["_h1"])
                return rows.where(taken | (edge & at_most)).drop(*hashes)
    copies = rows.where(edge).limit(1).withColumn("_h0", F.explode(F.sequence(F.lit(1), F.lit(missing))))
    return rows.where(taken).unionByName(copies.withColumn("_h0", F.lit(0).cast("long"))).drop(*hashes)


def keyed_sample(df: DataFrame, keys: Sequence[str], fraction: float, hashed: Column | None = None) -> DataFrame:
    """The same rows on every run and partitioning: those whose key hash falls below ``fraction``. ``hashed`` takes the place of Spark's hash, say to agree with another engine."""
    h = F.xxhash64(*keys) if hashed is None else hashed
    return df.where(F.pmod(h, F.lit(1_000_000)) < int(fraction * 1_000_000))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh temporary one where it is unset and Spark runs in one process (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


_recording: ContextVar[list[str] | None] = ContextVar("recording", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Gives the list of the folders that ``stored`` writes meanwhile, for ``discard``."""
    made: list[str] = []
    before = _recording.set(made)
    try:
        yield made
    finally:
        _recording.reset(before)


def discard(spark: SparkSession, made: list[str], needed: DataFrame) -> None:
    """Delete stored tables and forget them, but for those whose files ``needed`` still reads."""
    files = needed.inputFiles()
    names = {p: p.rsplit("/", 1)[1] for p in made}
    read = {p for p, n in names.items() if any(f"/{n}/" in f for f in files)}
    for p in made:
        if p not in read:
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made[:] = [p for p in made if p in read]


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: cuts lineage and survives lost executors.

    Compressed Parquet, unlike ``checkpoint()``; the files go with the shared folder.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    made = _recording.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
