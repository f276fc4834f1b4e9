"""Streams that keep state of their own, against the batch operators after every micro-batch."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F
from tidemark.operators import queue
from tidemark.streaming import streams

MESSAGE = "email_id long, thread_id long, received_at timestamp, outline_points int"


def landed(spark, folder, rows):
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    spark.createDataFrame([(e, t, at(m), p) for e, t, m, p in rows], MESSAGE).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, idle=None):
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("has_outline", F.col("outline_points").isNotNull())
    with streams.keyed_state(spark):
        query = streams.stale_outlines(stream, idle).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("email_id long, thread_id long, overtaken long").parquet(f"{out}/rows")


def test_stale_outlines_equal_the_batch_after_every_landing(spark, tmp_path):
    """Each landing restarts the stream from its checkpoint; messages come out of order, and some of one time."""
    rng = random.Random(3)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for batch in range(3):
        rows = [(100 * batch + i, rng.randrange(5), rng.randrange(30), rng.choice([None, 0, 3])) for i in range(25)]
        seen += rows
        landed(spark, folder, rows)
        told = sorted((r.email_id, r.thread_id) for r in run(spark, folder, out).collect())
        batch_rows = queue.stale_outlines(spark.read.parquet(folder)).collect()
        assert told == sorted((r.email_id, r.thread_id) for r in batch_rows) and told
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert "RocksDB" not in before


def test_idle_threads_are_forgotten(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    hour = 60
    landed(spark, folder, [(1, 1, 0, 2), (2, 2, 0, 2)])
    run(spark, folder, out, idle=3_600_000)
    landed(spark, folder, [(3, 9, 50 * hour, None)])  # moves the watermark on
    run(spark, folder, out, idle=3_600_000)
    landed(spark, folder, [(4, 1, 51 * hour, None), (5, 9, 51 * hour, 1)])
    run(spark, folder, out, idle=3_600_000)
    landed(spark, folder, [(6, 9, 52 * hour, None)])
    assert [(r.email_id, r.thread_id) for r in run(spark, folder, out, idle=3_600_000).collect()] == [(5, 9)]
