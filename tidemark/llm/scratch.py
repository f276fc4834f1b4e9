"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1
_FIRST = 256

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests in one process), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand text to Python workers in batches of ``rows`` instead of the default 10,000, so that two workers fit beside an executor's heap. A value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables written so far; call it once the results built on them have been written."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def semi(df: DataFrame, keys: DataFrame, on: str, bound: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among the distinct ``keys``; the keys are broadcast only when counted to be at most ``bound``."""
    few = keys.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(keys) if few else keys, on, "left_semi")


def numbered(docs: DataFrame) -> DataFrame:
    """(row, text, rid): the other columns of each row of ``docs`` (doc_id, text) as a struct, its text, and a number of its own that follows the order of doc_id, null last.

    Where no doc_id is repeated the number is doc_id itself, the largest long for null. Else the rows are put in order once and saved with their places: those of one
    doc_id by the first 256 characters of the text, then by a digest of it, then by their other columns. No range holds more than its share of equal rows.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    rows = docs.select(row, docs["text"].alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("rid"))
    if not rows.groupBy("rid").count().where("count > 1").limit(1).count():
        return rows
    keys = {"k0": F.col("rid"), "k1": F.col("row.doc_id").isNull(), "k2": F.left("text", F.lit(_FIRST)), "k3": F.sha2(F.col("text").cast("binary"), 256), "k4": F.xxhash64(F.to_json("row")), "k5": F.monotonically_increasing_id()}
    ranged = rows.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return save(ranged.select("row", "text", F.monotonically_increasing_id().alias("rid")), "numbered")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with the place (from 1) of every row in ``order``, written once: ranges are sorted in parallel, and the sizes of those before a range give its first place."""
    low = (1 << 33) - 1  # monotonically_increasing_id: the range above, the place in it below
    at = F.monotonically_increasing_id()
    placed = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), "ranked")
    block = F.shiftright("_at", 33)
    # one row a range
    sizes = placed.groupBy(block.alias("_block")).agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), block == F.col("_block")).withColumn("place", F.col("_before") + F.col("_at").bitwiseAND(low) + 1).drop("_at", "_block", "_before")
