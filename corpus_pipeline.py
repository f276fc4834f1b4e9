"""The corpus pipeline: toxic documents go, repeated lines go, one document of each near-duplicate group stays, sources are mixed, and the rest is tokenized."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, line_dedup, mixing, near_dup, queries, toxicity
from tidemark.llm.scratch import NO_ID, numbered, save

NEAR_PERCENT = 80


def _restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The document columns of ``row``, with its text and length replaced by those beside it."""
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the table's labels that aren't held out."""
    model = queries.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, queries.TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier documents have; those of which no words are left go."""
    kept = line_dedup.dedup_lines(docs).where("not emptied")
    return _restored(kept.withColumnRenamed("text", "new_text"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates, and every document without any; of rows that share a doc_id each counts by itself."""
    rows = numbered(docs)
    found = near_dup.near_duplicates(rows.select(F.col("rid").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    gone = found.where("not kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"))
    return rows.join(gone, "rid", "left_anti").select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).where("copies > 0")
    repeated = mixed.select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of every document of the mix."""
    coded = bpe.encode(docs, bpe.load(queries.tokenizer_path()), keep=("doc_id", "source"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: No stage but the first could be put in SQL that ends on whole tables; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
