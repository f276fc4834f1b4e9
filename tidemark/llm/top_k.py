"""Exact top-k inner products with vector-approximation files (Weber, Schek and Blott, 1998).

Each component x becomes the integer floor(scale * x). Vectors are dealt to chunks of about ``CHUNK`` rows, queries to blocks of
about ``BLOCK``; every chunk meets every block once, side by side with the others, so no side is broadcast or held whole anywhere.

In a chunk each dimension is cut into 256 cells between its least and greatest value, and a vector's approximation is one byte a
dimension. For a query the cell edges bound its score from below and above. The kth greatest lower bound rules out every vector whose upper bound is less; the
rest are read exactly, in order of upper bound, until the kth exact score is above the next bound. A chunk returns at most k rows a query, and the ranks of these
rows over all chunks are the result.

Vectors that are equal after scaling tie, and the smaller ids win: of equal vectors only the first k + 1 can appear in any result, and the
others are left out before the search. This is exact, and a group of equal vectors costs no more than k + 1.

Rows that repeat a vec_id with an equal scaled vector are one candidate, from before equal vectors are numbered. An id with several different vectors can be in a result
once for each of their scores; bounds allow for that, so that at least k distinct other ids are above them.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a query meets only vectors of its own dimension; a query's own row is left
out by vec_id, so are rows that repeat it; a null vec_id takes no part; scores beyond a long saturate; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 16_384
BLOCK = 2_048
CELLS = 256
_EXACT = float(1 << 53)


def _search(k: int, scale: float):
    def search(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(queries) or not len(vectors):
            return none
        ids, qids = vectors["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
        most = int(np.unique(ids, return_counts=True)[1].max())
        v, q = (np.floor(np.stack(x["vector"].to_numpy()).astype(np.float64) * scale) for x in (vectors, queries))
        if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * v.shape[1] >= _EXACT:
            return _plain(k, qids, q, ids, v)
        # the approximation file of this chunk: one byte a dimension, and the cell edges
        low, high = v.min(axis=0), v.max(axis=0)
        width = np.maximum((high - low) / CELLS, 1e-9)
        cells = np.minimum((v - low) / width, CELLS - 1).astype(np.uint8)
        slack = 1e-6 * (1 + np.abs(low).max(initial=0) + np.abs(high).max(initial=0))
        found = []
        for at in range(0, len(q), 64):
            part = q[at : at + 64]
            # score of the lower cell corner; the upper and lower bounds differ from it by the query's positive and negative parts
            base = (cells * width) @ part.T + low @ part.T
            up = (np.maximum(part, 0) @ width) + slack * np.abs(part).sum(axis=1) + 1
            down = (np.minimum(part, 0) @ width) - slack * np.abs(part).sum(axis=1) - 1
            for j in range(len(part)):
                # the query itself may be here, so the bounds of one id more than k are kept
                sure = min((k + 1) * most, len(ids))
                kth = np.partition(base[:, j], len(ids) - sure)[len(ids) - sure] + down[j]
                left = np.flatnonzero(base[:, j] + up[j] >= kth)
                left = left[np.argsort(-base[left, j], kind="stable")]
                found.append(_read(k, int(qids[at + j]), part[j], ids, v, left, base[left, j] + up[j]))
        return pd.concat(found, ignore_index=True) if found else none

    return search


def _read(k: int, qid: int, q: np.ndarray, ids: np.ndarray, v: np.ndarray, order: np.ndarray, bound: np.ndarray) -> pd.DataFrame:
    """Exact scores in order of upper bound, until the kth is certain."""
    rows, scores = np.zeros(0, np.int64), np.zeros(0)
    step = 4 * k
    for at in range(0, len(order), step):
        best = _best(k, ids[rows], scores)
        if len(best) >= k and bound[at] < scores[best[-1]]:
            break
        new = order[at : at + step]
        new = new[ids[new] != qid]
        rows, scores = np.append(rows, new), np.append(scores, v[new] @ q)
    best = _best(k, ids[rows], scores)
    return pd.DataFrame({"query_id": qid, "vec_id": ids[rows[best]], "score": scores[best].astype(np.int64)})


def _best(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places of the k greatest scores, smaller ids first among equal ones, an id with a score once."""
    at = np.lexsort((ids, -scores))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (ids[at[1:]] != ids[at[:-1]]) | (scores[at[1:]] != scores[at[:-1]])
    return at[fresh][:k]


def _plain(k: int, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """For components too large for exact floating-point sums: whole numbers without bound, saturated at the end."""
    edge = (1 << 63) - 1
    exact = [[int(x) for x in row] for row in v]
    out = []
    for qid, row in zip(qids.tolist(), q):
        row = [int(x) for x in row]
        scored = sorted({(-sum(a * b for a, b in zip(row, x)), i) for i, x in zip(ids.tolist(), exact) if i != qid})[:k]
        out += [(qid, i, max(-edge - 1, min(edge, -s))) for s, i in scored]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) with ``is_query`` the k other rows of the greatest score."""
    x = F.col("vector")
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")).where(usable)
    queries = rows.where("asks").dropDuplicates(["vec_id", "vector"])
    scaled = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("double"))
    # equal vectors in order of id: those after the first k + 1 can't be in a result
    same = Window.partitionBy("h1", "h2").orderBy("vec_id")
    hashed = rows.withColumn("h1", F.xxhash64(scaled)).withColumn("h2", F.md5(F.array_join(scaled.cast("array<string>"), " ")))
    first = hashed.dropDuplicates(["vec_id", "h1", "h2"]).withColumn("place", F.row_number().over(same)).where(f"place <= {k + 1}").select("vec_id", "vector")
    n, asked = rows.count(), queries.count()
    chunks, blocks = max(1, -(-n // CHUNK)), max(1, -(-asked // BLOCK))
    spread = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dim = F.size("vector").alias("dim")
    left = queries.select(dim, spread(1, blocks).alias("block"), every(chunks).alias("chunk"), "vec_id", "vector")
    right = first.select(dim, every(blocks).alias("block"), spread(2, chunks).alias("chunk"), "vec_id", "vector")
    key = ["dim", "block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k, scale), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
