"""Exact joins of unit vectors by cosine.

Angles obey the triangle inequality: if x and y are at most t apart, their angles to any third vector differ by t at most. A bounded number of stored vectors are pivots. Every stored vector belongs to the cell of its nearest
pivot; a cell knows the least and the greatest angle of its vectors to every pivot. An item is compared with the cells whose bounds, widened by t, hold all of its own angles, and with no other: none of their vectors
can be near enough. Cells and their items are dealt in blocks, so that no cell is one task, and a block is one product of matrices.

Names of which one contains the other have a lower bar. Such pairs meet by an equality join of the runs of words of the longer name with the shorter one, whatever their angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import dealt, keep

#: Pivots a dimension, rows a block, and what is added to angles for rounding.
PIVOTS, BLOCK, SLACK = 32, 2048, 1e-6
#: A name shorter than this doesn't count as part of another. Fixed value.
LEAST_PART = 4


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows; zeros stay zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(batch.column("vec").value_lengths())
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def _pivots(stored: DataFrame) -> dict[int, np.ndarray]:
    """``PIVOTS`` stored vectors of each dimension, those of the smallest hashes. A sample of this size is all that the driver sees of the vectors."""
    found: dict[int, np.ndarray] = {}
    for (dim,) in stored.select(F.size("vec").alias("dim")).distinct().orderBy("dim").limit(100).collect():
        some = stored.where(F.size("vec") == dim).select("vec", F.xxhash64("entity_id").alias("h")).orderBy("h").limit(PIVOTS).collect()
        found[dim] = _matrix(pa.array([list(map(float, r.vec)) for r in some], pa.list_(pa.float64())))
    return found


def _placed(df: DataFrame, key: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(key, kind, vec, dim, cell, angles): every vector's nearest pivot and its angles to all. Dimensions without pivots are left out."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                if dim not in shared.value:
                    continue
                angles = _angles(_matrix(part.column("vec")), shared.value[dim])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("kind"), part.column("vec"), pa.array(np.full(len(angles), dim, np.int32)), pa.array(angles.argmin(axis=1).astype(np.int32)), lists], [key, "kind", "vec", "dim", "cell", "angles"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "kind", F.col("vec").cast("array<double>").alias("vec")).where(F.size("vec") > 0).mapInArrow(run, f"{key} {kind}, kind string, vec array<double>, dim int, cell int, angles array<double>")


def by_angle(items: DataFrame, stored: DataFrame, bar: float) -> tuple[DataFrame, DataFrame]:
    """(id, entity_id, score) of all pairs of one kind and dimension whose cosine is ``bar`` or more after rounding to six digits, and (blocks, pairs): how many were compared.

    ``items``: (id, kind, vec); ``stored``: (entity_id, kind, vec). Null, empty and zero vectors take no part.
    """
    solid = lambda df: df.where(F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False)))
    items, stored = solid(items), solid(stored)
    pivots = _pivots(stored)
    most = float(np.arccos(max(-1.0, min(1.0, bar - SLACK))) + SLACK)
    known = keep(_placed(stored, "entity_id", pivots), "cells")
    # one row a kind, dimension and cell; lists of at most PIVOTS bounds
    edges = [f(F.get("angles", F.lit(j))).alias(f"{n}{j}") for j in range(PIVOTS) for n, f in (("lo", F.min), ("hi", F.max))]
    cells = known.groupBy("kind", "dim", "cell").agg(F.count("*").alias("n"), *edges)
    low, high = F.array(*[f"lo{j}" for j in range(PIVOTS)]), F.array(*[f"hi{j}" for j in range(PIVOTS)])
    cells = keep(cells.select("kind", "dim", "cell", "n", low.alias("low"), high.alias("high")), "cell_bounds")
    asked = _placed(items, "id", pivots).select("id", "kind", "dim", "vec", "angles")
    near = F.forall(F.arrays_zip("angles", "low", "high"), lambda z: z.angles.isNull() | ((z.angles >= z.low - most) & (z.angles <= z.high + most)))
    met = asked.join(cells, ["kind", "dim"]).where(near)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # the items of a cell in parts as well: as many as the cell has blocks, at least SALTS
    salt = F.pmod(F.xxhash64("id"), F.greatest(blocks, F.lit(8))).cast("int")
    met = met.withColumn("part", salt)
    sizes = cells.select("kind", "dim", "cell", blocks.alias("blocks"))
    split = known.join(F.broadcast(sizes) if cells.limit(10_001).count() <= 10_000 else sizes, ["kind", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("entity_id"), F.col("blocks")).cast("int"))
    split = split.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(8)) - 1)))
    keys = ["kind", "dim", "cell", "block", "part"]
    ids, entities = items.schema["id"].dataType.simpleString(), stored.schema["entity_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found_id, found_entity, score = [], [], []
        if left.num_rows and right.num_rows:
            x, y = _matrix(left.column("vec")), _matrix(right.column("vec"))
            for at in range(0, len(x), BLOCK):
                s = np.round(x[at : at + BLOCK] @ y.T, 6)
                i, j = np.nonzero(s >= bar)
                found_id.append(left.column("id").take(pa.array(i + at)))
                found_entity.append(right.column("entity_id").take(pa.array(j)))
                score.append(s[i, j])
        one = lambda parts, column: pa.chunked_array([c for p in parts for c in p.chunks], column.type)
        n = pa.nulls(0, pa.float64()) if not score else pa.array(np.concatenate(score))
        return pa.table({"id": one(found_id, left.column("id")), "entity_id": one(found_entity, right.column("entity_id")), "score": n})

    pairs = met.select("id", "vec", *keys).groupBy(*keys).cogroup(split.select("entity_id", "vec", *keys).groupBy(*keys)).applyInArrow(compare, f"id {ids}, entity_id {entities}, score double")
    work = met.groupBy("kind", "dim", "cell", "block").agg(F.count("*").alias("asked"), F.first("n").alias("n")).select((F.col("asked") * F.col("n") / F.ceil(F.col("n") / BLOCK)).alias("pairs"))
    return pairs, work.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("pairs"), F.lit(0.0)).cast("long").alias("pairs"))


def contained(items: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, entity_id) of all pairs of one kind (id, kind, key; entity_id, kind, key) where the words of one key, of ``LEAST_PART`` characters at least, are a run of the more numerous words of the other."""
    split = lambda df: df.withColumn("words", F.filter(F.split("key", r"\s+"), lambda w: w != "")).withColumn("n", F.size("words"))

    def parts(df: DataFrame, key: str) -> DataFrame:
        """Every shorter run of words of a name."""
        some = df.where("n > 1").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n"))))
        some = some.withColumn("size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("at") + 1))).where("size < n")
        return some.select(key, "kind", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("run")).distinct()

    i, e = split(items), split(stored)
    whole = lambda df, key: df.where(f"n > 0 and length(key) >= {LEAST_PART}").select(key, "kind", F.array_join("words", " ").alias("run"))
    inside = whole(i, "id").join(dealt(parts(e, "entity_id")), ["kind", "run"]).select("id", "entity_id")
    return inside.unionByName(parts(i, "id").join(dealt(whole(e, "entity_id")), ["kind", "run"]).select("id", "entity_id")).distinct()


def near(items: DataFrame, stored: DataFrame, bar: float, contained_bar: float) -> DataFrame:
    """(id, entity_id, score): the pairs of one kind and dimension whose cosine reaches ``bar``, or the lower one where one key contains the other.

    ``items``: (id, kind, key, vec); ``stored``: (entity_id, kind, key, vec).
    """
    items, stored = keep(items, "near_items"), keep(stored, "near_stored")
    pairs = by_angle(items, stored, bar)[0]
    nested = contained(items, stored).join(dealt(items.select("id", F.col("vec").alias("x"))), "id").join(dealt(stored.select("entity_id", F.col("vec").alias("y"))), "entity_id").where("size(x) > 0 and size(x) = size(y)")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col("x"), F.col("y")
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    told = nested.select("id", "entity_id", F.round(F.when(norm > 0, dot(x, y) / norm).otherwise(0.0), 6).alias("score")).where(F.col("score") >= min(bar, contained_bar))
    # a pair that both ways find may differ in the last digit
    return pairs.unionByName(told).groupBy("id", "entity_id").agg(F.max("score").alias("score"))
