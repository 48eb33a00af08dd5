"""Incremental jobs on Structured Streaming: record ingestion with keyed upserts, message intake without repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessella.operators.pack import last_turns
from tessella.sources.tables import upsert


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 16, kind: str = "parquet") -> DataFrame:
    """New record files as they come, a bounded number for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def _buckets(spark: SparkSession, target: str, upto: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """For each bucket the complete versions (number, folder) of at most `upto`, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[tuple[int, str]]] = {}
    for version in fs.listStatus(path) if fs.exists(path) else []:
        at, name = version.getPath(), version.getPath().getName()
        if name.startswith("v=") and (upto is None or int(name[2:]) <= upto) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
            for folder in fs.listStatus(at):
                if folder.getPath().getName().startswith("_bucket="):
                    found.setdefault(int(folder.getPath().getName()[8:]), []).append((int(name[2:]), folder.getPath().toString()))
    return {bucket: sorted(folders) for bucket, folders in found.items()}


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table that ingest() keeps: the newest complete version of each bucket."""
    folders = [versions[-1][1] for versions in _buckets(spark, target).values()]
    return spark.read.parquet(*folders) if folders else None


def newest_only(rows: DataFrame, table: DataFrame | None, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """Of a batch and the table's rows of the same keys the newest, so that batches may come in any order."""
    if table is not None:
        rows = rows.unionByName(table.join(rows.select(*keys).distinct(), list(keys), "left_semi"))
    return rows


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], newest: Sequence[Column], transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64, mode: str = "append") -> StreamingQuery:
    """Upsert a stream into a Parquet table in buckets of keys, then stop when all that is there has been read.

    Each batch rewrites only the buckets that its keys fall into, as version batch id + 1, from their newest earlier
    versions; a batch that is repeated after a failure writes the same again. Versions older than those are deleted then, so
    a bucket has two at most. The checkpoint is where a restart goes on. One task writes a bucket: choose `buckets`, which
    must stay the same for a table, so that one fits.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows = (transform(rows) if transform else rows).persist()  # read several times below: keyed state would be stepped anew for each
        try:
            write(rows, batch_id)
        finally:
            rows.unpersist()

    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [row[0] for row in rows.select(bucket).distinct().collect()]
        if not touched:
            return
        kept = {b: versions for b, versions in _buckets(spark, target, batch_id).items() if b in touched}
        before = spark.read.schema(rows.schema).parquet(*(versions[-1][1] for versions in kept.values())) if kept else rows.limit(0)
        table = upsert(before, newest_only(rows, before if kept else None, keys, newest), keys, newest)
        table.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/v={batch_id + 1}")
        for _, folder in (old for versions in kept.values() for old in versions[:-1]):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unrepeated(messages: DataFrame, keys: Sequence[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Messages without repeats of a key within the watermark; rows later than that are dropped. State is bounded by the delay."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def intake(messages: DataFrame, log: str, checkpoint: str, keys: Sequence[str], at: str, delay: str = "1 hour") -> StreamingQuery:
    """Append messages without repeats to a Parquet log, exactly once for each batch."""
    rows = unrepeated(messages, keys, at, delay)
    return rows.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def refreshed_context(log: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Each conversation's last turns, from the message log."""
    return last_turns(log, key, order, role, text)


def context_stream(messages: DataFrame, key: str, order: str, role: str, text: str, roles: Sequence[str] = ("user", "assistant"), limit: int = 6, longest: int | None = None, idle: float | None = None) -> DataFrame:
    """key, version, order, role, text: after each batch the last turns of the conversations that it touched, from keyed state.

    The state of a conversation is its last `limit` turns and a counter of its versions; a message of an order that it
    knows is a repeat. Messages may come late: they take their place by order. Texts are kept whole, or
    with `longest` their first characters. With `idle`, a conversation without messages for so many seconds is forgotten by a
    timer; its next message begins a new context.
    """
    schema = messages.schema
    turn = T.StructType([T.StructField("at", schema[order].dataType), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    kept = T.StructType([T.StructField("version", T.LongType()), T.StructField("turns", T.ArrayType(turn))])
    out = T.StructType([schema[key], T.StructField("version", T.LongType()), schema[order], schema[role], T.StructField(text, T.StringType())])
    said = F.col(text) if longest is None else F.substring(text, 1, longest)
    rows = messages.filter(F.col(role).isin(*roles) & F.col(key).isNotNull() & F.col(order).isNotNull()).select(key, order, role, said.alias(text))
    processor = LastTurns([key, order, role, text], kept, limit, idle)
    return rows.groupBy(key).transformWithState(processor, out, "Update", "ProcessingTime" if idle else "None")


class LastTurns(StatefulProcessor):
    """Keeps the last turns of a conversation; see context_stream. columns: key, order, role, text."""

    def __init__(self, columns: Sequence[str], kept: T.StructType, limit: int, idle: float | None) -> None:
        self.columns, self.kept, self.limit, self.idle = list(columns), kept, limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("context", self.kept)  # one value: a conversation is read and written once a batch

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        name, order, role, text = self.columns
        version, turns = self.state.get() or (0, [])
        known = {turn[0]: tuple(turn) for turn in turns}
        for row in rows:
            known.setdefault(row[order], (row[order], row[role], row[text]))
        last = [known[at] for at in sorted(known)[-self.limit :]]
        self.state.update((version + 1, last))
        if self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        for at, who, said in last:
            yield Row(**{name: key[0], "version": version + 1, order: at, role: who, text: said})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def refresh_contexts(messages: DataFrame, target: str, checkpoint: str, key: str, order: str, role: str, text: str, limit: int = 6, longest: int | None = None, idle: float | None = None, buckets: int = 64) -> StreamingQuery:
    """Keep a table of each conversation's last turns (key, version, turns) up to date with a stream of messages.

    Each batch reads and writes only the conversations that it touches (their buckets of the table); a restart goes on from
    the checkpoint's state. current() reads the table. State needs the RocksDB provider, which is set for this query only, as
    is the number of whole texts that a Python worker gets at a time.
    """
    spark = messages.sparkSession
    turns = F.array_sort(F.collect_list(F.struct(order, role, text))).alias("turns")  # `limit` at most
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        updates = context_stream(messages, key, order, role, text, limit=limit, longest=longest, idle=idle)
        return ingest(updates, target, checkpoint, [key], [F.desc("version")], lambda rows: rows.groupBy(key, "version").agg(turns), buckets, mode="update")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
