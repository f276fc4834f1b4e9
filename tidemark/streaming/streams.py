"""Incremental versions of the batch operators as Structured Streaming queries over a folder that receives event files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.tables import shared_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file of a folder as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside use the state store that processors with state of their own need; the session's setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through the stream, as a table in the shared folder.

    Appended rows go to a file sink. Of a complete or an updated result each batch is written to a folder of its own; what is read is the last complete one, or the changes of all batches.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")).start()
    query.awaitTermination()
    rows = spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(f"{base}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == F.lit(last))
    return rows if mode == "append" else rows.drop("batch")


def stats(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n) by tumbling windows; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def dedupe(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_by_user(stream: DataFrame) -> DataFrame:
    """(user_id, event_type, value): the last value of each kind, as it changes."""
    return stream.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n) of runs of events without a longer gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


class _Threads(StatefulProcessor):
    """Of each thread the newest time, and the outlines of that time: all others have been told to be stale."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "micros long")
        self.fresh = handle.getMapState("fresh", "email_id long", "micros long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        for batch in rows:
            outlined = batch[batch["has_outline"].fillna(False).astype(bool)]
            newest = int(batch["micros"].max()) if before is None else max(before, int(batch["micros"].max()))
            stale = outlined[outlined["micros"] < newest]["email_id"].tolist()
            if before is not None and newest > before:
                stale += [k[0] for k in self.fresh.keys()]
                self.fresh.clear()
            for email in outlined[outlined["micros"] == newest]["email_id"].tolist():
                self.fresh.updateValue((email,), (newest,))
            if newest != before:
                self.newest.update((newest,))
                if self.idle is not None:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer)
                    self.handle.registerTimer(newest // 1000 + self.idle)
            before = newest
            if stale:
                yield pd.DataFrame({"email_id": stale, "thread_id": [key[0]] * len(stale), "overtaken": [newest] * len(stale)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.fresh.clear()
        return iter(())

    def close(self) -> None:
        pass


def stale_outlines(messages: DataFrame, idle: int | None = None, late: str = "1 hour") -> DataFrame:
    """(email_id, thread_id, overtaken) as messages land (email_id, thread_id, received_at, has_outline): every outline that a newer message of its thread overtakes, once, with that message's time in microseconds.

    State is the newest time of each thread and the outlines of that very time. With ``idle`` (milliseconds) threads are forgotten once the watermark is so far past their newest message; what lands later begins them anew.
    Start the query inside ``keyed_state``.
    """
    rows = messages.select("thread_id", "email_id", "received_at", F.unix_micros("received_at").alias("micros"), "has_outline").where("received_at is not null")
    if idle is not None:
        rows = rows.withWatermark("received_at", late)
    told = rows.groupBy("thread_id").transformWithStateInPandas(_Threads(idle), "email_id long, thread_id long, overtaken long", "append", "none" if idle is None else "eventTime")
    return told


def upsert(stream: DataFrame, path: str, keys: list[str]):
    """Start a stream that keeps a table at the last row of each key; returns the query and a function that reads the table.

    Each batch writes the changed table to a folder of its own, numbered by the batch, and the highest finished number is the table: a restart finds it there.
    """
    from tidemark.operators.merge import latest, merge_latest

    def newest(spark: SparkSession, below: int | None = None) -> str | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tables")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tables/{n}/_SUCCESS"))]
        done = [n for n in done if below is None or n < below]
        return f"{path}/tables/{max(done)}" if done else None

    def write(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, F.desc("ts"), F.desc("event_id"))
        before = newest(batch.sparkSession, number)
        if before:
            new = merge_latest(batch.sparkSession.read.schema(batch.schema).parquet(before), new, keys)
        new.write.mode("overwrite").parquet(f"{path}/tables/{number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    return query, lambda: stream.sparkSession.read.schema(stream.schema).parquet(newest(stream.sparkSession))
