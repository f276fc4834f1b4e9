"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import save


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node.

    Large-star then small-star steps (Kiveris et al., 2014) until the links stop changing: a number of rounds logarithmic
    in the longest path. Links stay distributed; each round is written to the shared folder, so no lineage builds up and
    no round is repeated when an executor is lost. Rows of one node are only ever reduced to a minimum, never gathered.
    """
    edges = save(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = save(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = save(small.where("u != v").distinct(), "edges")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == seen:
            break
        seen = state
    found = edges.groupBy("u").agg(F.min("v").alias("v"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
