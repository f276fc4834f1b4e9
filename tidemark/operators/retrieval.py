"""Text and vector search and their fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import nearness


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) by cosine, zero for vectors of zeros; the smaller vec_id of equal ones, never the query's own.

    Vectors and queries (vec_id, embedding) of one dimension meet in blocks of about ``block`` rows each, a product of two matrices a pair of blocks, of which only each query's best k go on.
    """
    numbered = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).where(F.size("vec") > 0).withColumn("dim", F.size("vec"))
    v, q = numbered(vectors), numbered(queries)
    parts = lambda df: -(-df.count() // block) or 1
    n_v, n_q = parts(v), parts(q)
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("v_part", part(n_v)).withColumn("q_part", every(n_q))
    q = q.withColumn("q_part", part(n_q)).withColumn("v_part", every(n_v))
    keys = ["dim", "v_part", "q_part"]
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def best(stored: pa.Table, asked: pa.Table) -> pa.Table:
        ids, wanted = stored.column("vec_id").combine_chunks(), asked.column("vec_id").combine_chunks()
        if not len(ids) or not len(wanted):
            return pa.table({"query_id": wanted.slice(0, 0), "vec_id": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        x, y = nearness._matrix(asked.column("vec")), nearness._matrix(stored.column("vec"))
        known, own = ids.to_numpy(zero_copy_only=False), wanted.to_numpy(zero_copy_only=False)
        place = np.empty(len(known), np.int64)
        place[np.argsort(known, kind="stable")] = np.arange(len(known))
        rows, columns, scores = [], [], []
        for at in range(0, len(x), block):
            s = np.round(x[at : at + block] @ y.T, 6) + 0.0  # no negative zeros
            s[own[at : at + block, None] == known[None, :]] = -np.inf
            bar = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -2.0)
            i, j = np.nonzero((s >= bar[:, None]) & np.isfinite(s))
            order = np.lexsort((place[j], -s[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)  # where each query's hits begin
            top = np.arange(len(i)) - first < k
            rows.append(i[top] + at)
            columns.append(j[top])
            scores.append(s[i[top], j[top]])
        take = lambda a, parts: a.take(pa.array(np.concatenate(parts)))
        return pa.table({"query_id": take(wanted, rows), "vec_id": take(ids, columns), "score": pa.array(np.concatenate(scores))})

    scored = v.select("vec_id", "vec", *keys).groupBy(*keys).cogroup(q.select("vec_id", "vec", *keys).groupBy(*keys)).applyInArrow(best, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fuse(channels: dict[str, DataFrame], k: int = 10, damp: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked channels (query_id, rank, chunk_id): (query_id, rank, chunk_id, score, channel)."""
    all_ = None
    for name, rows in channels.items():
        rows = rows.select("query_id", "chunk_id", "rank", F.lit(name).alias("channel"))
        all_ = rows if all_ is None else all_.unionByName(rows)
    fused = all_.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (damp + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channel"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score", "channel")


def budget_prefix(sections: DataFrame, budget: int) -> DataFrame:
    """Sections (anchor, priority, text) in order until ``budget`` characters are full; the last is cut to what is left."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("anchor").orderBy("priority").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sections.withColumn("before", before).where(F.col("before") < budget)
    return cut.select("anchor", "priority", F.left("text", (F.lit(budget) - F.col("before")).cast("int")).alias("text"))


def body_hits(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of ranked hits (query_id, rank, vec_id, score) those that are body chunks, ranked anew: a search takes its best vectors first, of chunks of any kind."""
    body = chunks.where("kind = 'body'").select("chunk_id")
    some = found.withColumnRenamed("vec_id", "chunk_id").join(body, "chunk_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return some.withColumn("rank", rank).select("query_id", "rank", "chunk_id", "score")


def match_vector(items: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity_id, score): the best entity of each item (id, kind, key, vec) by cosine, where it reaches its bar; the smaller id of equal ones."""
    from tidemark.operators import resolution

    return resolution.best(resolution.near(items, entities))
