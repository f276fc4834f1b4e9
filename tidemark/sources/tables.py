"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (one process, as in tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that what is used several times is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, per: int = 100_000) -> int:
    """Parts for that many rows, so that the rows of one task stay as many when a table grows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per))


def spread(df: DataFrame, per: int = 20_000) -> DataFrame:
    """A table of a small file dealt over all cores, for work that costs far more a row than reading it."""
    return df.repartition(parts(df.sparkSession, df.count(), per))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A saved table to join with: sent to every task where it has at most ``most`` rows, so that the other side is not shuffled and keeps its partitions; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def joined(df: DataFrame, other: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` and ``other`` joined by ``key``: where ``other`` is small it is sent to every task, else both are dealt to ``n`` parts, as the session's number of shuffle partitions does not grow with the tables."""
    few = small(other)
    return df.join(few, key) if few is not other else df.repartition(n, key).join(other.repartition(n, key), key)


def dealt(df: DataFrame) -> DataFrame:
    """A table to join with by shuffle whatever its size: Spark would collect one of up to 10 MB on the driver, in every round anew where rounds are made."""
    return df.hint("merge")


def placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``place``, every row's number (from 1) in ``order``, which must end in something unique.

    Ranges of the order are sorted in parallel, and the sizes of those before a range (one row a range) give its first number; a window over all rows would be one task.
    """
    ranges = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    block = F.shiftright("_at", 33)
    sizes = ranges.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    both = ranges.join(F.broadcast(before), block == F.col("_block"))
    return both.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_block", "_before")
