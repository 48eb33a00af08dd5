"""Helpers shared by the training-data operators: scratch tables, skew-safe joins, text constants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and text contract here: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than 1/HOT_SHARE of all rows counts as hot, so at most HOT_SHARE keys can be hot.
HOT_SHARE = 1000

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's setting for the rows of a batch to a Python worker; batches of whole texts take TEXT_ROWS.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 512


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir where set, else a folder of this machine (local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: cuts lineage, survives lost executors.

    The write's shuffle files go when it is done, as the table stands for them. Python workers get `batch_rows` rows at a
    time, Spark's own number if None.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {SHUFFLE_CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing will read any more. Other tables stay."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(scratch_root(spark))
        system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            path = system.makeQualified(hadoop.Path(folder))
            if path.getParent().equals(system.makeQualified(root)):
                system.delete(path, True)


def blank_null(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_keys(id_col: str, text_col: str, columns: list[str]) -> dict[str, Column]:
    """Two columns that tell rows apart by id (null as itself) and text; their names are longer than any of columns."""
    pad = max(map(len, columns), default=0)
    return {"by_id".ljust(pad, "_") + "_1": F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), "by_text".ljust(pad, "_") + "_2": F.xxhash64(text_col)}


def without_rows(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without rows whose keys stand in gone, and with one row for keys that stand in repeated (tables with the columns of keys).

    Only rows of repeated keys are shuffled; the others are filtered where they stand. Nothing of docs is written.
    """
    on, rows = list(keys), join_small(docs.withColumns(keys), gone, list(keys), "left_anti")
    if repeated.isEmpty():
        return rows.drop(*on)
    once = join_small(rows, repeated, on, "left_semi").dropDuplicates(on)
    return join_small(rows, repeated, on, "left_anti").unionByName(once).drop(*on)


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str, max_rows: int = 100_000) -> DataFrame:
    """Join with a side that is broadcast only when a count proves it small; a shuffled merge join beyond that.

    right should be materialised: its rows are counted first. AQE splits skewed partitions of the merge join.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row per key, n_col = the group's row count).

    Groups of more than total / HOT_SHARE rows are at most HOT_SHARE by counting, so those are broadcast; the
    others meet in a merge join in which no key is hot.
    """
    limit = max(1000, total // HOT_SHARE)
    hot = groups.filter(F.col(n_col) > limit)
    cold = groups.filter(F.col(n_col) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    )
